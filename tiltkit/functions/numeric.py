"""Numeric column helpers that keep NULL/inf rules explicit under ANSI mode.

All helpers return ``pyspark.sql.Column`` built from JVM-side expressions, so
they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ieee_ratio(num, den) -> Column:
    """num / den with float semantics: x/0 is +-inf for x != 0, 0/0 is NULL;
    NULL when either is NULL.

    ANSI mode raises on division by zero, so the zero case is branched out.
    NaN is represented as NULL throughout the library.
    """
    n, d = col(num), col(den)
    return (
        F.when(d != 0, n / d)
        .when((d == 0) & (n > 0), F.lit(float("inf")))
        .when((d == 0) & (n < 0), F.lit(float("-inf")))
    )


def safe_ratio(num, den) -> Column:
    """num / den, NULL when the denominator is zero or NULL."""
    n, d = col(num), col(den)
    return F.when(d != 0, n / d)


def round_half_away(c, decimals: int = 0) -> Column:
    """Round half away from zero on x * 10**decimals (then scale back).

    The study rounds with this rule (so does DuckDB's round on DOUBLE).
    Spark's ``round(x, d)`` with d > 0 works on the decimal text of x instead
    (round(1.005, 2) = 1.01 there, 1.0 here), so only the integer rounding
    step uses it: for d = 0 HALF_UP on the shortest decimal text of a double
    equals half-away on its exact value, because that text reads n.5 only
    when the double is exactly n.5. One expression node, generated code.
    NULL, NaN and +-inf pass through; a zero result is +0.0.
    """
    x = col(c)
    if decimals == 0:
        return F.round(x, 0) + 0.0
    if decimals < 0:  # to tens, hundreds, ...
        m = float(10 ** -decimals)
        return F.round(x / m, 0) * m + 0.0
    m = float(10**decimals)
    return F.round(x * m, 0) / m + 0.0


def ln_or_null(c) -> Column:
    """Natural log, NULL for x <= 0 (the study's -inf/NaN rows are dropped later)."""
    x = col(c)
    return F.when(x > 0, F.ln(x))


def finite_or_null(c) -> Column:
    """+-inf and NaN to NULL, for frames that come from foreign sources."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def linspace_point(start, stop, num, j) -> Column:
    """Point j of numpy.linspace(start, stop, num): j*step + start, last = stop."""
    start, stop, num, j = col(start), col(stop), col(num), col(j)
    step = (stop - start) / (num - 1).cast("double")
    return F.when(j == num - 1, stop).otherwise(j.cast("double") * step + start)


def ordered_key(c) -> Column:
    """Order-preserving 64-bit key of a double, split-free (no Python).

    For a = |x| the IEEE-754 bit pattern B(a) is rebuilt from the exponent
    and the fraction (both exact: powers of two are exact and a / 2**e is an
    exact division). Positive values map to B | sign bit, negative values to
    ~B, so unsigned order of the key equals numeric order. -0.0 maps with
    +0.0; NaN and NULL give NULL.
    """
    x = col(c) + 0.0
    a = F.abs(x)
    e0 = F.floor(F.log2(a))
    # log2 can be one off next to a power of two: correct against exact pow.
    e1 = F.when(F.pow(F.lit(2.0), e0) > a, e0 - 1).otherwise(e0)
    e = F.when(F.pow(F.lit(2.0), e1 + 1) <= a, e1 + 1).otherwise(e1)
    e_clamped = F.greatest(e, F.lit(-1022))
    frac_normal = ((a / F.pow(F.lit(2.0), e_clamped) - 1.0) * float(2**52)).cast("long")
    normal = F.shiftleft((e_clamped + 1023).cast("long"), 52) + frac_normal
    subnormal = (a * float(2**1022) * float(2**52)).cast("long")
    bits = (
        F.when(a == 0, F.lit(0).cast("long"))
        .when(a == float("inf"), F.lit(0x7FF0000000000000).cast("long"))
        .when(a < 2.2250738585072014e-308, subnormal)
        .otherwise(normal)
    )
    sign = F.lit(-(2**63)).cast("long")
    return (
        F.when(F.isnan(x), F.lit(None).cast("long"))
        .when(x >= 0, bits.bitwiseOR(sign))
        .otherwise(F.bitwise_not(bits.bitwiseOR(sign)))
    )
