"""Stage B: distribution tables over the yearly panel.

Five investor classes x two flags are never run as ten jobs: measures are
unpivoted into (investor, value) rows and the class is a group key. Pivots
to itm/otm/atm columns are conditional aggregations over an explicit value
list (no extra distinct job).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_ratio
from ..schema import (
    CONTRACT_MULTIPLIER, MATURITIES, MEASURES, MONEYNESS, QUANTILES,
    TABLE_CLASSES, UNCLASSIFIED, dollar_col, trade_col,
)
from .quantile import approx_quantiles, bracket_quantiles, wide_quantiles

DAY_KEYS = ("date", "ticker", "f_k_moneyness", "cp_flag")
FLAGS = ("C", "P")
QCOLS = ("p05", "p25", "p50", "p75", "p95")


def scaled(panel: DataFrame, factor: float = CONTRACT_MULTIPLIER,
           measures: Sequence[str] = MEASURES) -> DataFrame:
    """Volumes in contracts x multiplier (row level, before any sum)."""
    return panel.withColumns({m: F.col(m) * float(factor) for m in measures})


def _sums(measures: Sequence[str], suffix: str = "") -> list:
    return [F.coalesce(F.sum(m), F.lit(0.0)).alias(f"{m}{suffix}") for m in measures]


def daily_totals(panel: DataFrame, factor: float = CONTRACT_MULTIPLIER) -> DataFrame:
    """Per (date, ticker, moneyness, flag): sums of the 12 scaled measures."""
    return scaled(panel, factor).groupBy(*DAY_KEYS).agg(*_sums(MEASURES))


def class_long(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str],
               name: str = "investor", value: str = "value") -> DataFrame:
    """Unpivot measure columns into (name, value) rows, labelled by class."""
    renamed = df.select(*ids, *[F.col(src).alias(lbl) for lbl, src in columns.items()])
    return renamed.unpivot(list(ids), list(columns), name, value)


def dollar_classes(classes: Sequence[str] = TABLE_CLASSES, suffix: str = "") -> dict[str, str]:
    return {c: dollar_col(c) + suffix for c in classes}


def volume_distribution(daily: DataFrame, columns: Mapping[str, str] | None = None,
                        exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Mean, quantiles, total and share of total per (investor, flag, moneyness).

    Tables are per flag (C, P). Only positive values enter (per class). The
    share's denominator is the
    class-and-flag total over all moneyness groups, including the
    unclassified one, which is then not shown. Quantiles are exact nearest
    rank (``exact``) or ``percentile_approx``.
    """
    columns = dict(columns or dollar_classes())
    long = class_long(daily.where(F.col("cp_flag").isin(*FLAGS)), ["cp_flag", "f_k_moneyness"],
                      columns).where(F.col("value") > 0)
    g = ["investor", "cp_flag", "f_k_moneyness"]
    if exact:
        # groups: classes x {C, P} x moneyness labels -> a small closed domain
        ql = bracket_quantiles(long, g, "value", QUANTILES, with_stats=True)
        wide = wide_quantiles(ql, g, QUANTILES, QCOLS, extra=("n", "total"))
    else:
        ql = approx_quantiles(long, g, "value", QUANTILES, accuracy, with_stats=True)
        wide = wide_quantiles(ql, g, QUANTILES, QCOLS, extra=("n", "total"))
    w = Window.partitionBy("investor", "cp_flag")
    out = wide.select(
        *g, "n",
        (F.col("total") / F.col("n")).alias("mean"),
        *QCOLS, "total",
        (safe_ratio(F.col("total"), F.sum("total").over(w)) * 100.0).alias("share_pct"),
    )
    return out.where(F.col("f_k_moneyness").isin(*MONEYNESS))


SIDE_STATS = ("mean", *QCOLS, "total", "share_pct")


def side_by_side(dist: DataFrame, classes: Sequence[str] = TABLE_CLASSES) -> DataFrame:
    """The class tables side by side: one row per (flag, statistic), one column
    per class and moneyness. The columns are a closed list, so this is one
    conditional aggregation over a table of a few rows per class."""
    stats = F.inline(F.array(*[F.struct(F.lit(i).alias("stat_order"), F.lit(c).alias("stat"), F.col(c).alias("v"))
                               for i, c in enumerate(SIDE_STATS)]))
    long = dist.select("cp_flag", "investor", "f_k_moneyness", stats)
    at = lambda c, m: F.max(F.when((F.col("investor") == c) & (F.col("f_k_moneyness") == m), F.col("v")))
    return long.groupBy("cp_flag", "stat_order", "stat").agg(
        *[at(c, m).alias(f"{c}_{m}") for c in classes for m in MONEYNESS])


def share_distribution(shares: DataFrame, classes: Sequence[str] = TABLE_CLASSES) -> DataFrame:
    """The distribution table over daily moneyness shares (in place of volumes)."""
    return volume_distribution(shares, dollar_classes(classes, "_f_k_pct"))


def moneyness_share_daily(panel: DataFrame, factor: float = CONTRACT_MULTIPLIER) -> DataFrame:
    """Share of each moneyness group in the (date, flag) total, per measure.

    Sub-totals per (date, moneyness, flag) come from one aggregation; the
    (date, flag) totals are a window sum over those few sub-total rows (no
    second aggregation and no join back). A NULL date or flag gets a NULL
    total, as an equi-join would give. Zero totals give NULL shares.
    """
    s = scaled(panel, factor).withColumn("Year", F.date_format("date", "yyyy"))
    sub = s.groupBy("date", "Year", "f_k_moneyness", "cp_flag").agg(*_sums(MEASURES, "_f_k_total"))
    w = Window.partitionBy("date", "cp_flag")
    keyed = F.col("date").isNotNull() & F.col("cp_flag").isNotNull()
    pct = {
        f"{m}_f_k_pct": safe_ratio(F.col(f"{m}_f_k_total"),
                                   F.when(keyed, F.sum(f"{m}_f_k_total").over(w)))
        for m in MEASURES
    }
    return sub.select("date", "Year", "f_k_moneyness", "cp_flag", *[v.alias(k) for k, v in pct.items()])


PCT = tuple(f"{m}_f_k_pct" for m in MEASURES)


def avg_moneyness_share(shares: DataFrame) -> DataFrame:
    """Mean daily share per (moneyness, flag), each measure."""
    return shares.groupBy("f_k_moneyness", "cp_flag").agg(*[F.avg(c).alias(c) for c in PCT])


def moneyness_share_by_year(shares: DataFrame) -> DataFrame:
    """Mean daily share per (Year, moneyness, flag), each measure."""
    return shares.groupBy("Year", "f_k_moneyness", "cp_flag").agg(*[F.avg(c).alias(c) for c in PCT])


def _pivot_mean(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    m, v = F.col("f_k_moneyness"), F.col("value")
    return long.groupBy(*keys).agg(*[F.avg(F.when(m == lbl, v)).alias(lbl) for lbl in MONEYNESS])


def year_table(shares: DataFrame, classes: Sequence[str] = TABLE_CLASSES) -> DataFrame:
    """Mean positive share by Year as itm/otm/atm columns, per class and flag."""
    cols = dollar_classes(classes, "_f_k_pct")
    long = class_long(shares, ["Year", "cp_flag", "f_k_moneyness"], cols).where(
        (F.col("value") > 0) & (F.col("f_k_moneyness") != UNCLASSIFIED))
    return _pivot_mean(long, ["investor", "cp_flag", "Year"])


def avg_volume_by_moneyness(daily: DataFrame) -> DataFrame:
    """Mean of means: per (ticker, moneyness, flag) over days, then over tickers."""
    per_ticker = daily.groupBy("ticker", "f_k_moneyness", "cp_flag").agg(
        *[F.avg(m).alias(m) for m in MEASURES])
    return per_ticker.groupBy("f_k_moneyness", "cp_flag").agg(*[F.avg(m).alias(m) for m in MEASURES])


def maturity_table(panel: DataFrame, classes: Sequence[str] = TABLE_CLASSES) -> DataFrame:
    """Mean positive daily volume by maturity as itm/otm/atm columns (unscaled).

    Rows are completed to the six maturity buckets in display order for every
    (measure, flag); the unclassified bucket is left out.
    """
    measures = [m for c in classes for m in (trade_col(c), dollar_col(c))]
    day = panel.where(F.col("cp_flag").isin(*FLAGS)) \
        .groupBy("date", "maturity", "f_k_moneyness", "cp_flag").agg(*_sums(measures))
    long = class_long(day, ["maturity", "f_k_moneyness", "cp_flag"], {m: m for m in measures},
                      name="measure").where(
        (F.col("value") > 0) & (F.col("f_k_moneyness") != UNCLASSIFIED))
    means = _pivot_mean(long, ["measure", "cp_flag", "maturity"])
    spark = panel.sparkSession
    domain = (
        spark.range(1)
        .select(F.explode(F.array(*[F.lit(m) for m in measures])).alias("measure"))
        .select("measure", F.explode(F.array(F.lit("C"), F.lit("P"))).alias("cp_flag"))
        .select("measure", "cp_flag",
                F.posexplode(F.array(*[F.lit(m) for m in MATURITIES])).alias("maturity_order", "maturity"))
    )
    # means has at most measures x {C, P} x 7 maturity labels rows
    # measures x flags x the closed list of maturities
    means = means.where(F.col("maturity").isin(*MATURITIES))
    return domain.join(F.broadcast(means), ["measure", "cp_flag", "maturity"], "left").select(
        "measure", "cp_flag", "maturity", F.col("maturity_order").cast("int").alias("maturity_order"),
        *MONEYNESS)
