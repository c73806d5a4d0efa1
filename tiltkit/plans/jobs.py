"""The study's three entry points as library calls.

``build_yearly_panel``    monthly option files + stock panel -> yearly panel on disk
``distribution_tables``   yearly panel -> distribution, share, year and maturity tables
``discontinuity_study``   yearly panel + stock panel -> curves, fits, cut-off search, reports

Each returns DataFrames (or writes), nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imbalance as imb
from ..operators import panel as pnl
from ..operators import rdd, report
from ..operators import tables as tb
from ..schema import (
    RDD_CLASSES, RDD_CUTOFFS, RDD_MCAP_CUTOFF, RDD_MCAP_GRID, RDD_PRICE_GRID, SHORT_MATURITIES,
    dollar_col,
)
from ..session import materialize
from ..sources import io


def build_yearly_panel(spark: SparkSession, option_paths: Sequence[str] | str, stock_path: str,
                      out_path: str | None = None) -> DataFrame:
    """Stage A: all monthly files in one scan -> panel; written partitioned by year
    when ``out_path`` is given (then the written panel is returned)."""
    panel = pnl.yearly_panel(io.read_months(spark, option_paths), io.read_stock_daily(spark, stock_path))
    if out_path is None:
        return panel
    io.write_panel(panel, out_path)
    return io.read_panel(spark, out_path)


def distribution_tables(panel: DataFrame) -> dict[str, DataFrame]:
    """Stage B: the tables of the distribution study."""
    daily = tb.daily_totals(panel)
    shares = tb.moneyness_share_daily(panel)
    dist = tb.volume_distribution(daily)
    return {
        "daily_totals": daily,
        "volume_distribution": dist,
        "volume_distribution_panel": report.distribution_panel(dist),
        "moneyness_share_daily": shares,
        "avg_moneyness_share": tb.avg_moneyness_share(shares),
        "moneyness_share_by_year": tb.moneyness_share_by_year(shares),
        "year_table": tb.year_table(shares),
        "avg_volume_by_moneyness": tb.avg_volume_by_moneyness(daily),
        "maturity_table": tb.maturity_table(panel),
    }


def _cutoff_column(cutoffs: dict[str, float]) -> F.Column:
    c = None
    for cls, v in cutoffs.items():
        c = F.when(F.col("investor") == cls, F.lit(float(v))) if c is None else \
            c.when(F.col("investor") == cls, F.lit(float(v)))
    return c


def discontinuity_study(panel: DataFrame, stock: DataFrame,
                        maturities: Sequence[str] = SHORT_MATURITIES,
                        cutoffs: dict[str, float] | None = None, price_grid=RDD_PRICE_GRID,
                        mcap_cutoff: float = RDD_MCAP_CUTOFF, mcap_grid=RDD_MCAP_GRID) -> dict[str, DataFrame]:
    """Stage C/D: imbalance curves, fits per class and flag (class cut-offs),
    MSE-optimal cut-offs, the market-cap models (calls) and the comparison table."""
    cutoffs = dict(cutoffs or RDD_CUTOFFS)
    classes = {c: dollar_col(c) for c in RDD_CLASSES}
    joined = imb.join_stock_panel(imb.with_delta_moneyness(panel), stock)
    short = materialize(imb.short_dated(joined, maturities=maturities))
    keys = ["cp_flag", "investor"]
    price = materialize(imb.imbalance_curve(short, "ln_prc", classes))
    mcap = materialize(imb.imbalance_curve(short.where(F.col("cp_flag") == "C"), "ln_mcap", classes))
    fit = rdd.fit_wide(price, "itm_otm", "ln_prc", _cutoff_column(cutoffs), keys, checkpoint_input=False)
    coef = rdd.coefficients(fit, keys).withColumn("model", F.concat_ws("_", "investor", "cp_flag"))
    curve = rdd.cutoff_curve(price, "itm_otm", "ln_prc", price_grid, keys, checkpoint_input=False)
    mfit = rdd.fit_wide(mcap, "itm_otm", "ln_mcap", mcap_cutoff, keys, checkpoint_input=False)
    models = {f"{c}_{f}": f"{c}_{f}" for f in ("C", "P") for c in RDD_CLASSES}
    return {
        "short_dated": short,
        "imbalance_by_price": price,
        "imbalance_by_mcap": mcap,
        "imbalance_by_volatility": imb.imbalance_curve(short, "impl_volatility", classes),
        "coefficients": coef,
        "fitted_line": rdd.fitted_line(fit, keys),
        "cutoff_mse_curve": curve,
        "optimal_cutoff": rdd.optimal_cutoff(curve, keys),
        "mcap_coefficients": rdd.coefficients(mfit, keys),
        "mcap_optimal_cutoff": rdd.optimal_cutoff(
            rdd.cutoff_curve(mcap, "itm_otm", "ln_mcap", mcap_grid, keys, checkpoint_input=False), keys),
        "model_comparison": report.model_comparison(coef, models),
    }
