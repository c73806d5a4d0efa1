"""Column-level expressions (classification, rounding, formats, p-values)."""

from .buckets import delta_moneyness, forward_moneyness, maturity_bucket
from .numeric import (
    finite_or_null,
    ieee_ratio,
    linspace_point,
    ln_or_null,
    ordered_key,
    round_half_away,
    safe_ratio,
)
from .text import (
    fmt_bse,
    fmt_coef,
    fmt_fixed,
    fmt_nobs,
    fmt_rsquared,
    fmt_share_pct,
    fmt_thousands,
    fmt_tstat,
    stars,
    stars_from_z,
)

__all__ = [
    "delta_moneyness", "forward_moneyness", "maturity_bucket",
    "finite_or_null", "ieee_ratio", "linspace_point", "ln_or_null", "ordered_key",
    "round_half_away", "safe_ratio",
    "fmt_bse", "fmt_coef", "fmt_fixed", "fmt_nobs", "fmt_rsquared", "fmt_share_pct",
    "fmt_thousands", "fmt_tstat", "stars", "stars_from_z",
]
