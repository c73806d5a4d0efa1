"""Registered queries over stored data: round trips through the sources and
sinks, the stream of files, and stored layouts that save shuffles and reads.

Each writes what it reads from the star schema to a folder of its own beside
the checkpoints (a shared folder on a cluster), left to that folder's retention.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_away
from ..operators import imbalance as imb
from ..operators import panel as pnl
from ..schema import MEASURES, PANEL_KEYS
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..streaming import panel_stream, read_stream_panel
from . import catalog as C
from . import oracle as orc

#: Deliveries that the months of the stream are dealt to, whatever their dates.
DELIVERIES = 4
#: Years of the round trip, and the ticker and price of the years that are looked up.
YEARS = (1996, 1998)
LISTED, LISTED_PRICE = "Brand#11", 100000.0


def _folder(spark: SparkSession, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _measures_by(df: DataFrame, *keys) -> DataFrame:
    sums = df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("n_rows"))
    return C.rounded(sums, C.DOLLARS, C.RAW_DP)


def q_panel_stream(spark, sf):
    """Files that split every date, as a stream; the parts of a date merge."""
    folder = _folder(spark, "panel-stream")
    dealt = C.options(spark, sf).withColumn("delivery", F.pmod(F.xxhash64("dtm", "strike_price"), F.lit(DELIVERIES)))
    dealt.write.partitionBy("delivery").parquet(f"{folder}/months")
    n_files = len(spark.read.parquet(f"{folder}/months").inputFiles())
    query = panel_stream(spark, f"{folder}/months/*", C.stock(spark, sf), f"{folder}/parts", f"{folder}/progress",
                         files_per_trigger=max(1, n_files // DELIVERIES))
    query.awaitTermination()
    return C.rounded(read_stream_panel(spark, f"{folder}/parts"), C.DOLLARS, C.RAW_DP)


def q_panel_roundtrip(spark, sf):
    """Panel written by year in sorted files, two years read back."""
    path = _folder(spark, "panel")
    io.write_panel(C.panel(spark, sf), path)
    back = io.read_panel(spark, path, years=YEARS)
    return _measures_by(back, F.col("year").cast("int").alias("year"), "cp_flag", "f_k_moneyness")


def q_monthly_files(spark, sf):
    """Monthly option files written and read back in one scan of all paths."""
    folder = _folder(spark, "months")
    io.write_months(C.options(spark, sf).withColumn("month", F.month("date")), folder)
    paths = [f"{folder}/month={m}" for m in range(1, 13)]
    files = io.read_months(spark, paths)
    return C.rounded(pnl.yearly_panel(files, C.stock(spark, sf)), C.DOLLARS, C.RAW_DP)


def q_csv_roundtrip(spark, sf):
    """Year table written as CSV with a header and read back."""
    path = _folder(spark, "csv")
    table = C.q_year_table(spark, sf)
    io.write_csv(table, path)
    return spark.read.option("header", True).schema(table.schema).csv(path)


def q_panel_of_listed_years(spark, sf):
    """Panel of the years in which a ticker traded at a high price: the years
    are found in the stock panel, and prune the panel's folders as the query runs."""
    path = _folder(spark, "panel")
    io.write_panel(C.panel(spark, sf), path)
    stock = C.stock(spark, sf).where((F.col("ticker") == LISTED) & (F.col("prc") >= LISTED_PRICE))
    found = io.read_panel_of_years(spark, path, stock.select(F.year("date").alias("year")))
    return _measures_by(found, F.col("year").cast("int").alias("year"), "cp_flag")


def bucketed_stock_join(spark: SparkSession, panel: DataFrame, stock: DataFrame) -> DataFrame:
    """The stock panel join over stored buckets of (date, ticker): the join,
    and the check that stock keys are unique, move no row."""
    folder, name = _folder(spark, "buckets"), uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["date", "ticker"]
    panel = io.write_bucketed(panel, f"panel_{name}", keys, buckets, f"{folder}/panel")
    stock = io.write_bucketed(stock, f"stock_{name}", keys, buckets, f"{folder}/stock")
    return imb.join_stock_panel(imb.with_delta_moneyness(panel).hint("merge"), stock)


def q_bucketed_stock_join(spark, sf):
    j = bucketed_stock_join(spark, C.panel(spark, sf), C.stock(spark, sf))
    j = j.select(*PANEL_KEYS, "delta_moneyness", "comnam", "mcap", "prc", *MEASURES)
    return C.rounded(C.rounded(j.withColumn("mcap", round_half_away(F.col("mcap"), C.MCAP_DP)), ["prc"], C.RATIO_DP), C.DOLLARS, C.RAW_DP)


# ------------------------------------------------------------------ oracles

def _sums_sql(keys: str, where: str) -> str:
    cols = ", ".join((C.R(f"sum({m})", C.RAW_DP) if m in C.DOLLARS else f"sum({m})") + f" AS {m}" for m in MEASURES)
    return f"SELECT {keys}, {cols}, count(*) AS n_rows FROM panel WHERE {where} GROUP BY ALL"


def o_panel_roundtrip():
    years = ", ".join(map(str, YEARS))
    return orc.with_ctes(orc.base_ctes(), _sums_sql("CAST(year(date) AS INTEGER) AS year, cp_flag, f_k_moneyness", f"year(date) IN ({years})"))


def o_panel_of_listed_years():
    listed = f"SELECT year(date) FROM stock_daily WHERE ticker = '{LISTED}' AND prc >= {LISTED_PRICE!r}"
    return orc.with_ctes(orc.base_ctes(), _sums_sql("CAST(year(date) AS INTEGER) AS year, cp_flag", f"year(date) IN ({listed})"))


QUERIES = {
    "panel_stream": q_panel_stream,
    "panel_roundtrip": q_panel_roundtrip,
    "monthly_files": q_monthly_files,
    "csv_roundtrip": q_csv_roundtrip,
    "panel_of_listed_years": q_panel_of_listed_years,
    "bucketed_stock_join": q_bucketed_stock_join,
}

ORACLES = {
    "panel_stream": C.o_yearly_panel,
    "panel_roundtrip": o_panel_roundtrip,
    "monthly_files": C.o_yearly_panel,
    "csv_roundtrip": C.o_year_table,
    "panel_of_listed_years": o_panel_of_listed_years,
    "bucketed_stock_join": C.o_stock_panel_join,
}
