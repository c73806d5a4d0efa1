"""Option-like views over the generated star-schema tables.

The test data is a TPC-H-like star schema; these views give it the shape of
the monthly option file and of the daily stock panel, so that every query of
the library runs on the given tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import safe_ratio

# --------------------------------------------------------------------------
# Fixed values of the test-data mapping.
# --------------------------------------------------------------------------
# Market segment -> investor class that receives the line quantity.
SEGMENT_CLASS = {
    "BUILDING": "customer_100",
    "AUTOMOBILE": "customer_100_199",
    "FURNITURE": "customer_199",
    "HOUSEHOLD": "professional",
    "MACHINERY": "firm",
}
# Line status -> option flag.
STATUS_FLAG = {"F": "C", "O": "P"}
# Return flags that count as buys / sells.
BUY_FLAGS = ("A", "N")
SELL_FLAGS = ("R",)
# Brands left out of the stock panel, so the left and semi joins have misses.
STOCK_EXCLUDED_BRANDS = ("Brand#5", "Brand#10", "Brand#15", "Brand#20", "Brand#25")
# Every so many order keys / part keys have a day to maturity of -1, no
# volume, or no strike price, so that the 'nan' labels, HAVING and NULL ratios
# have rows.
NO_MATURITY_EVERY, NO_VOLUME_EVERY, NO_STRIKE_EVERY = 97, 13, 89
# Stock months (12 * year + month + brand number) left out, and with prices
# above any limit, so that the left join has misses and the price filter drops.
STOCK_GAP_EVERY, STOCK_HIGH_EVERY, STOCK_HIGH_FACTOR = 11, 17, 1000.0
# Days to maturity wrap at this modulus.
DTM_MODULUS = 181
STRIKE_FACTOR = 2.2
DELTA_FACTOR = 10.0
IV_FACTOR = 10.0


# Read schemas of the generated tables (only the columns the views use). A
# declared schema skips the footer-inference job of every read.
_LONG, _INT, _DBL, _STR, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()
READ_SCHEMAS = {
    "lineitem": [("l_orderkey", _LONG), ("l_partkey", _LONG), ("l_quantity", _DBL),
                 ("l_extendedprice", _DBL), ("l_discount", _DBL), ("l_tax", _DBL),
                 ("l_returnflag", _STR), ("l_linestatus", _STR), ("l_shipdate", _TS)],
    "orders": [("o_orderkey", _LONG), ("o_custkey", _LONG), ("o_orderdate", _TS)],
    "customer": [("c_custkey", _LONG), ("c_mktsegment", _STR)],
    "part": [("p_partkey", _LONG), ("p_brand", _STR), ("p_retailprice", _DBL)],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in READ_SCHEMAS:
        reader = reader.schema(T.StructType([T.StructField(c, t) for c, t in READ_SCHEMAS[name]]))
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _month(ts) -> F.Column:
    """First day of the month as a DATE, without any time-zone conversion
    (the generated timestamps have no zone)."""
    return F.trunc(F.to_date(ts), "month")


def _class_volume(segment: F.Column, side: F.Column, cls: str) -> F.Column:
    segs = [s for s, c in SEGMENT_CLASS.items() if c == cls]
    return F.when(segment.isin(segs), side).otherwise(F.lit(0.0))


def option_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders x customer x part as monthly option quotes and volumes."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    j = (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .join(cu, od.o_custkey == cu.c_custkey)
        .join(pa, li.l_partkey == pa.p_partkey)
    )
    j = j.withColumns({
        "_cp": F.when(F.col("l_linestatus") == "F", "C").when(F.col("l_linestatus") == "O", "P"),
        "_fwd": safe_ratio("l_extendedprice", "l_quantity"),
    })
    cp, fwd = F.col("_cp"), F.col("_fwd")
    disc = F.col("l_discount") * DELTA_FACTOR
    traded = F.col("l_orderkey") % NO_VOLUME_EVERY != 0
    buy = F.when(traded & F.col("l_returnflag").isin(*BUY_FLAGS), F.col("l_quantity")).otherwise(F.lit(0.0))
    sell = F.when(traded & F.col("l_returnflag").isin(*SELL_FLAGS), F.col("l_quantity")).otherwise(F.lit(0.0))
    seg = F.col("c_mktsegment")

    def pair(cls):
        return _class_volume(seg, buy, cls), _class_volume(seg, sell, cls)

    c100, c100_199, c199, prof, firm = (pair(c) for c in
                                        ("customer_100", "customer_100_199", "customer_199",
                                         "professional", "firm"))
    return j.select(
        _month(F.col("l_shipdate")).alias("date"),
        F.col("p_brand").alias("ticker"),
        cp.alias("cp_flag"),
        F.when(F.col("l_orderkey") % NO_MATURITY_EVERY == 0, F.lit(-1)).otherwise(
            F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))) % DTM_MODULUS).cast("int").alias("dtm"),
        fwd.alias("forward_price"),
        F.when(F.col("p_partkey") % NO_STRIKE_EVERY != 0, F.col("p_retailprice") * STRIKE_FACTOR).alias("strike_price"),
        (F.col("l_tax") * IV_FACTOR).alias("impl_volatility"),
        F.when(cp == "C", disc).when(cp == "P", -disc).alias("delta"),
        (fwd * (1.0 - F.col("l_discount"))).alias("best_bid"),
        (fwd * (1.0 + F.col("l_tax"))).alias("best_offer"),
        (c100[0] + c100_199[0] + c199[0]).alias("customer_open_buy_volume"),
        (c100[1] + c100_199[1] + c199[1]).alias("customer_open_sell_volume"),
        c100[0].alias("customer_open_buy_volume_100"),
        c100[1].alias("customer_open_sell_volume_100"),
        c100_199[0].alias("customer_open_buy_volume_100_199"),
        c100_199[1].alias("customer_open_sell_volume_100_199"),
        c199[0].alias("customer_open_buy_volume_199"),
        c199[1].alias("customer_open_sell_volume_199"),
        prof[0].alias("professional_customer_open_buy_volume"),
        prof[1].alias("professional_customer_open_sell_volume"),
        firm[0].alias("firm_open_buy_volume"),
        firm[1].alias("firm_open_sell_volume"),
    )


def stock_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock panel per (month, brand): price = mean unit price, shares = quantity.
    Some months are missing, some have a price above any limit."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_brand") \
        .where(~F.col("p_brand").isin(*STOCK_EXCLUDED_BRANDS))
    j = li.join(pa, li.l_partkey == pa.p_partkey)
    months = j.groupBy(_month(F.col("l_shipdate")).alias("date"), F.col("p_brand").alias("ticker")).agg(
        F.avg(safe_ratio("l_extendedprice", "l_quantity")).alias("prc"), F.sum("l_quantity").alias("shrout"))
    turn = 12 * F.year("date") + F.month("date") + F.substring("ticker", 7, 4).cast("int")
    high = F.when(turn % STOCK_HIGH_EVERY == 0, F.lit(STOCK_HIGH_FACTOR)).otherwise(F.lit(1.0))
    return months.where(turn % STOCK_GAP_EVERY != 0).select(
        "date", "ticker", F.col("ticker").alias("comnam"), (F.col("prc") * high).alias("prc"), "shrout")
