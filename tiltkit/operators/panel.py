"""Stage A: monthly option quotes -> yearly panel of class volumes.

One scan of all months, one projection for every derived column, the
ticker-universe semi join *below* the aggregation, one partial/final hash
aggregate on the eight panel keys and the HAVING filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import forward_moneyness, maturity_bucket
from ..functions.numeric import ieee_ratio, round_half_away
from ..schema import CLASS_SOURCES, MEASURES, PANEL_KEYS, dollar_col, trade_col
from .joins import KeySet, semi_join_keys


def class_volumes(options: DataFrame, mid=None) -> list:
    """Per investor class, trade and dollar (mid price x volume) volume columns."""
    mid = (F.col("best_offer") + F.col("best_bid")) / 2.0 if mid is None else mid
    cols = []
    for cls, (buy, sell) in CLASS_SOURCES.items():
        vol = F.col(buy) + F.col(sell)
        cols.append(vol.alias(trade_col(cls)))
        cols.append((mid * vol).alias(dollar_col(cls)))
    return cols


def classify_options(options: DataFrame) -> DataFrame:
    """Row-level derivations of the monthly option file (one projection).

    The moneyness class uses the unrounded forward/strike ratio; the ratio,
    implied volatility and delta are rounded afterwards to become coarse
    group keys (1, 0 and 0 decimals, half away from zero).
    """
    # ratio and mid price are named once, so later expressions reference
    # them instead of inlining (and re-evaluating) them
    base = options.withColumns({
        "_f_k": ieee_ratio("forward_price", "strike_price"),
        "_mid": (F.col("best_offer") + F.col("best_bid")) / 2.0,
    })
    f_k = F.col("_f_k")
    return base.select(
        "date",
        "ticker",
        round_half_away(f_k, 1).alias("f_k"),
        forward_moneyness(f_k, F.col("cp_flag")).alias("f_k_moneyness"),
        maturity_bucket("dtm").alias("maturity"),
        "cp_flag",
        round_half_away(F.col("impl_volatility") * 100.0, 0).alias("impl_volatility"),
        round_half_away(F.col("delta") * 100.0, 0).alias("delta"),
        *class_volumes(base, F.col("_mid")),
    )


def panel_sums(classified: DataFrame) -> DataFrame:
    """8-key sums of the 12 measures, of classified rows or of such sums: sums
    of parts merge to the sums of all. A group whose values are all NULL sums
    to 0 (not NULL)."""
    return classified.groupBy(*PANEL_KEYS).agg(*[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in MEASURES])


def with_volume(sums: DataFrame) -> DataFrame:
    """HAVING customer + professional + firm > 0; only whole sums may be judged."""
    return sums.where(F.col(trade_col("customer")) + F.col(trade_col("professional")) + F.col(trade_col("firm")) > 0)


def aggregate_panel(classified: DataFrame) -> DataFrame:
    """8-key sum of the 12 measures, then HAVING customer+professional+firm > 0."""
    return with_volume(panel_sums(classified))


def yearly_panel(options: DataFrame, universe: DataFrame | KeySet | None = None) -> DataFrame:
    """Monthly option rows -> yearly panel restricted to the stock universe.

    ``universe`` is any frame with a ``ticker`` column (e.g. the daily stock
    panel) or its ``KeySet``; its distinct tickers filter the options before
    the aggregation, which is equivalent because ticker is a group key. Raw
    rows are never moved for it: a small set is broadcast, a larger one is a
    broadcast filter below the aggregation and an exact join above it.
    """
    if universe is None:
        return aggregate_panel(classify_options(options))
    keys = universe if isinstance(universe, KeySet) else KeySet(universe, "ticker")
    if keys.small:
        return aggregate_panel(classify_options(keys.semi_join(options)))
    panel = aggregate_panel(classify_options(keys.might_hold(options)))
    return panel.join(keys.keys, "ticker", "left_semi").select(*PANEL_KEYS, *MEASURES)


def universe_rows(options: DataFrame, universe: DataFrame) -> DataFrame:
    """Option rows that survive the universe filter, counted per ticker."""
    kept = semi_join_keys(options, universe, "ticker")
    return kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))
