"""Stage C (data side): stock-panel join, short-dated selection, ITM-OTM curves.

All classes and both flags are computed by one grouped job: the investor
measures are unpivoted into rows and carried as a key, so six curves cost
the same shuffles as one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import delta_moneyness
from ..functions.numeric import ln_or_null, round_half_away, safe_ratio
from ..schema import MAX_PRICE, SHORT_MATURITIES, dollar_col


def with_delta_moneyness(panel: DataFrame) -> DataFrame:
    return panel.withColumn("delta_moneyness", delta_moneyness("delta", "cp_flag"))


def stock_values(stock: DataFrame) -> DataFrame:
    """date, ticker, comnam, mcap = shares * 1000 * price, prc."""
    return stock.select(
        "date", "ticker", "comnam",
        (F.col("shrout") * 1000.0 * F.col("prc")).alias("mcap"),
        "prc",
    )


def unique_keys(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df``, or an error that names a key which occurs more than once.

    The check is part of the plan: rows are grouped by the keys, the count is
    asserted by a filter, and the values come out of the same aggregate, so
    ``df`` is read once and a join on the keys finds it partitioned already.
    Rows with a null key match nothing and are not checked (one of them stays).
    """
    values = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(*[F.first(c).alias(c) for c in values], F.count(F.lit(1)).alias("_copies"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    fault = F.raise_error(F.concat(F.lit(f"{what}: more than one row for "), name)).cast("boolean")
    return one.where(F.when(known & (F.col("_copies") > 1), fault).otherwise(F.lit(True))).select(*df.columns)


def join_stock_panel(panel: DataFrame, stock: DataFrame) -> DataFrame:
    """Left join of the option panel to the stock panel on (date, ticker).

    Both sides grow with the data, so no broadcast is forced: the planner
    (AQE) picks sort-merge or broadcast from runtime sizes, and AQE splits a
    skewed (date, ticker) partition. A stock panel that is not unique on the
    key, so that panel rows would fan out, is an error when the plan runs (a
    plan that uses no stock value drops the join, and rows cannot fan out).
    """
    return panel.join(unique_keys(stock_values(stock), ["date", "ticker"], "stock panel"), ["date", "ticker"], "left")


def duplicate_keys(stock: DataFrame) -> DataFrame:
    """(date, ticker) keys that occur more than once; empty for a valid panel."""
    return stock.groupBy("date", "ticker").count().where(F.col("count") > 1)


def short_dated(joined: DataFrame, maturities: Sequence[str] = SHORT_MATURITIES,
                flags: Sequence[str] = ("C", "P"), max_price: float = MAX_PRICE) -> DataFrame:
    """Selection of the discontinuity study, both flags at once (flag kept as a column).

    Keeps the given maturities, price below ``max_price`` (drops unmatched
    rows too) and itm/otm; buckets price to the nearest 5 (after rounding to
    a unit), market cap to billions, and adds the logs of the bucketed
    values (NULL for values <= 0, which later drop out).
    """
    df = joined.where(
        F.col("maturity").isin(*maturities)
        & F.col("cp_flag").isin(*flags)
        & (F.col("prc") < max_price)
        & F.col("f_k_moneyness").isin("itm", "otm")
    )
    prc_b = round_half_away(round_half_away(F.col("prc"), 0) / 5.0, 0) * 5.0
    mcap_b = round_half_away(F.col("mcap") / 1e9, 0)
    return df.withColumns({"prc": prc_b, "mcap": mcap_b}).withColumns({
        "ln_prc": ln_or_null("prc"),
        "ln_mcap": ln_or_null("mcap"),
        "ln_impl_volatility": ln_or_null("impl_volatility"),
    })


def imbalance_by_ticker(df: DataFrame, x: str, investors: Mapping[str, str] | Sequence[str],
                        moneyness: str = "f_k_moneyness", by: Sequence[str] = ("cp_flag",)) -> DataFrame:
    """Per (by, investor, ticker, x): mean over days of (itm-otm)/(itm+otm).

    ``investors`` maps label -> measure (a plain sequence labels each measure
    by its own name). Day cells of all investors are summed per moneyness in
    one aggregation (conditional sums) and only the aggregated rows become
    one row per investor; missing cells count as 0, and cells with
    itm+otm = 0 are dropped.
    """
    cols = dict(investors) if isinstance(investors, Mapping) else {m: m for m in investors}
    m = F.col(moneyness)
    total = lambda side, src: F.coalesce(F.sum(F.when(m == side, F.col(src))), F.lit(0.0))
    sums = {f"_{side}{k}": total(side, src) for k, src in enumerate(cols.values()) for side in ("itm", "otm")}
    days = df.groupBy(*by, "date", x, "ticker").agg(*[v.alias(c) for c, v in sums.items()])
    cell = days.select(*by, "date", x, "ticker", F.inline(F.array(*[
        F.struct(F.lit(lbl).alias("investor"), F.col(f"_itm{k}").alias("itm"), F.col(f"_otm{k}").alias("otm"))
        for k, lbl in enumerate(cols)])))
    tot = F.col("itm") + F.col("otm")
    cell = cell.where(tot > 0).withColumn("itm_otm", safe_ratio(F.col("itm") - F.col("otm"), tot))
    return cell.groupBy(*by, "investor", "ticker", x).agg(F.avg("itm_otm").alias("itm_otm"))


def imbalance_curve(df: DataFrame, x: str, investors: Mapping[str, str] | Sequence[str],
                    moneyness: str = "f_k_moneyness", by: Sequence[str] = ("cp_flag",)) -> DataFrame:
    """ITM-OTM imbalance against ``x``: mean over tickers of the per-ticker means.

    The mean of means is unweighted across tickers on purpose. Rows with a
    missing x (log of a non-positive value) are dropped, as the study does
    before fitting.
    """
    per_ticker = imbalance_by_ticker(df, x, investors, moneyness, by)
    curve = per_ticker.groupBy(*by, "investor", x).agg(F.avg("itm_otm").alias("itm_otm"))
    return curve.where(F.col(x).isNotNull() & F.col("itm_otm").isNotNull())


def investor_measures(classes: Sequence[str]) -> list[str]:
    return [dollar_col(c) for c in classes]


__all__ = [
    "with_delta_moneyness", "join_stock_panel", "duplicate_keys", "unique_keys", "short_dated",
    "imbalance_by_ticker", "imbalance_curve", "investor_measures", "stock_values",
]
