"""DataFrame operators of the study (DataFrame in, DataFrame out)."""

from .cutoff_effects import cutoff_effects
from .imbalance import (
    duplicate_keys, imbalance_by_ticker, imbalance_curve, join_stock_panel, short_dated,
    unique_keys, with_delta_moneyness,
)
from .joins import KeySet, join_null_safe, semi_join_keys
from .panel import (
    aggregate_panel, class_volumes, classify_options, panel_sums, universe_rows, with_volume, yearly_panel,
)
from .quantile import approx_quantiles, bracket_quantiles, exact_quantiles, target_rank, wide_quantiles
from .rdd import coefficients, cutoff_curve, fit_wide, fitted_line, optimal_cutoff
from .report import distribution_panel, header_spans, model_comparison, regression_table, tstat_lines
from .tables import (
    avg_moneyness_share, avg_volume_by_moneyness, daily_totals, maturity_table,
    moneyness_share_by_year, moneyness_share_daily, share_distribution, volume_distribution,
    year_table,
)

__all__ = [
    "KeySet", "bracket_quantiles", "cutoff_effects", "header_spans", "panel_sums", "tstat_lines", "unique_keys",
    "with_volume",
    "duplicate_keys", "imbalance_by_ticker", "imbalance_curve", "join_stock_panel", "short_dated",
    "with_delta_moneyness", "join_null_safe", "semi_join_keys", "aggregate_panel",
    "class_volumes", "classify_options", "universe_rows", "yearly_panel", "approx_quantiles",
    "exact_quantiles", "target_rank", "wide_quantiles", "coefficients", "cutoff_curve", "fit_wide",
    "fitted_line", "optimal_cutoff", "distribution_panel", "model_comparison", "regression_table",
    "avg_moneyness_share", "avg_volume_by_moneyness", "daily_totals", "maturity_table",
    "moneyness_share_by_year", "moneyness_share_daily", "share_distribution", "volume_distribution",
    "year_table",
]
