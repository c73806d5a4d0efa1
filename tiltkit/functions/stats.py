"""Two-sided normal p-value, JVM-side.

Robust (HC1 / cluster) fits use the normal distribution for p. Spark SQL has
no erf, so erfc is evaluated from two classical expansions with plain
arithmetic and ``exp`` (relative error below 1e-13 against a library erfc for
arguments up to 26, where erfc underflows):

  x < 2   erfc(x) = 1 - 2/sqrt(pi) exp(-x^2) * x * sum_n (2x^2)^n / (1*3*...*(2n+1))
          (all terms positive, summed in Horner form, 32 terms)
  x >= 2  Laplace's continued fraction
          erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...))))
          (40 levels, evaluated from the bottom)

The expression is SQL text, so the same formula runs in Spark and in any SQL
engine; it only touches coefficient rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES_TERMS = 32
FRACTION_LEVELS = 40
SWITCH = 2.0


def _d(v: float) -> str:
    return f"{float(v)!r}E0" if "e" not in repr(float(v)) else repr(float(v))


def erfc_sql(x: str) -> str:
    """SQL text of erfc(x) for x >= 0 (``x`` is a column name or expression)."""
    h = "1.0E0"
    for k in range(SERIES_TERMS - 1, 0, -1):
        h = f"(1.0E0 + 2.0E0 * {x} * {x} / {_d(2 * k + 1)} * {h})"
    series = f"(1.0E0 - {_d(2 / math.sqrt(math.pi))} * exp(-({x}) * ({x})) * {x} * {h})"
    t = x
    for k in range(FRACTION_LEVELS, 0, -1):
        t = f"({x} + {_d(k / 2)} / {t})"
    fraction = f"(exp(-({x}) * ({x})) * {_d(1 / math.sqrt(math.pi))} / {t})"
    return f"(CASE WHEN {x} < {_d(SWITCH)} THEN {series} ELSE {fraction} END)"


def with_pvalue(df: DataFrame, z: str = "z", out: str = "pval") -> DataFrame:
    """Add the two-sided normal p-value of column ``z`` (NULL stays NULL):
    one SQL expression, parsed once, over a helper column |z|/sqrt 2."""
    x = "_pv_x"
    tmp = df.withColumn(x, F.abs(F.col(z)) / math.sqrt(2.0))
    return tmp.withColumn(out, F.expr(erfc_sql(f"`{x}`"))).drop(x)
