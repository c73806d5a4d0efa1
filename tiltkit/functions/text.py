"""Text formatting of table cells, JVM-side.

``format_number`` rounds the exact binary value half-even, the same rule as
Python's ``'{:,.0f}'`` / ``'%.2f'`` (1.005 -> '1.00', 0.125 -> '0.12');
``format_string`` would round the decimal text half-up and differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Z_CRIT
from .numeric import col


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def fmt_thousands(c) -> Column:
    """'{:,.0f}': thousands separators, no decimals."""
    return F.format_number(col(c), 0)


def fmt_fixed(c, decimals: int) -> Column:
    """'%.{d}f' without separators."""
    return F.regexp_replace(F.format_number(col(c), decimals), ",", "")


def fmt_share_pct(c) -> Column:
    """Share in percent as '(NN\\%)'."""
    return F.concat(F.lit("("), fmt_thousands(c), F.lit("\\%)"))


def stars(pval) -> Column:
    """Significance stars from a p-value: <.01 ***, <.05 **, <.1 *, else ''."""
    p = col(pval)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def stars_from_z(z) -> Column:
    """The same stars from |z| against the normal critical values."""
    a = F.abs(col(z))
    out = None
    for crit, s in Z_CRIT:
        out = F.when(a > crit, s) if out is None else out.when(a > crit, s)
    return out.otherwise("")


def fmt_coef(coef, marks, decimals: int = 3) -> Column:
    """Coefficient with its stars (a column); '' when missing."""
    c = col(coef)
    return F.when(_missing(c), "").otherwise(F.concat(fmt_fixed(c, decimals), col(marks)))


def fmt_bse(bse, decimals: int = 3) -> Column:
    """Standard error in parentheses; '' when missing."""
    b = col(bse)
    return F.when(_missing(b), "").otherwise(F.concat(F.lit("("), fmt_fixed(b, decimals), F.lit(")")))


def fmt_tstat(t) -> Column:
    return F.concat(F.lit("["), fmt_fixed(t, 2), F.lit("]"))


def fmt_rsquared(r) -> Column:
    return fmt_fixed(r, 2)


def fmt_nobs(n) -> Column:
    return fmt_thousands(col(n).cast("double"))
