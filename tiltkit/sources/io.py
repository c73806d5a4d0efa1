"""Parquet / CSV sources and sinks (one multi-path scan, partitioned writes)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, NullType, NumericType, StructType

from ..schema import OPEN_VOLUME, OPTION_MONTH, STOCK_DAILY, check_columns


def month_paths(prefix: str, year: int, months: Iterable[int] = range(1, 13)) -> list[str]:
    """Paths of the monthly option files '<prefix><year>_<month>.parquet'."""
    return [f"{prefix}{year}_{m}.parquet" for m in months]


def typed(df: DataFrame, schema: StructType, what: str) -> DataFrame:
    """Declared columns cast to their declared types, NaN as NULL (Spark sorts
    NaN above every number, so it would pass any ``>`` filter). A type that
    cannot hold the values is an error; other columns pass unchanged."""
    check_columns(df, schema, what)
    declared = {f.name: f.dataType for f in schema.fields}
    for c, want in declared.items():
        have = df.schema[c].dataType
        if isinstance(want, NumericType) != isinstance(have, NumericType) and not isinstance(have, NullType):
            raise ValueError(f"{what}: column {c} is {have.simpleString()}, not {want.simpleString()}")

    def cast(c: str) -> F.Column:
        x = F.col(c)
        if isinstance(df.schema[c].dataType, FractionalType) and not isinstance(df.schema[c].dataType, DecimalType):
            x = F.when(~F.isnan(x), x)
        return x.cast(declared[c]).alias(c)

    return df.select(*[cast(c) if c in declared else F.col(c) for c in df.columns])


def read_months(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All monthly option files, typed. Files of one physical schema are one
    scan; months that differ in types (their footers are read) are cast each
    and united."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    by_schema: dict[str, list[str]] = {}
    for p in paths:
        by_schema.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
    months = [typed(spark.read.parquet(*group), OPTION_MONTH, "option_month") for group in by_schema.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), months)


def write_months(options: DataFrame, path: str, month: str = "month") -> None:
    """Write options as a folder of files per value of ``month``. Rows meet by
    month, and a month of more than a partition's advised size is dealt to
    several tasks (a rebalance), so no task sorts or writes a whole month."""
    options.hint("rebalance", F.col(month)).write.partitionBy(month).parquet(path)


def read_panel(spark: SparkSession, path: str, years: Iterable[int] | None = None) -> DataFrame:
    """The yearly panel; a year filter prunes partitions when written by ``write_panel``."""
    df = typed(spark.read.parquet(path), OPEN_VOLUME, "open_volume")
    if years is not None and "year" in df.columns:
        df = df.where(F.col("year").isin(list(years)))
    return df


def read_stock_daily(spark: SparkSession, path: str) -> DataFrame:
    return typed(spark.read.parquet(path), STOCK_DAILY, "stock_daily")


PANEL_SORT = ("date", "ticker", "f_k_moneyness", "cp_flag")


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the panel partitioned by year, globally sorted like the study's output.

    ``orderBy`` range-partitions on year and the sort keys, so every task
    writes a contiguous date range (no task holds a whole year). The year
    leads the order: the partitioned write needs rows sorted by it, and
    would replace an order that does not start with it.
    """
    (
        panel.withColumn("year", F.year("date"))
        .orderBy("year", *PANEL_SORT)
        .write.mode(mode)
        .partitionBy("year")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header (summary tables)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_panel_of_years(spark: SparkSession, path: str, years: DataFrame) -> DataFrame:
    """The yearly panel of the years in a frame (column ``year``), pruned while
    the query runs: the distinct years are broadcast (a panel has one folder
    per year, so they are few) and the same broadcast selects the folders that
    the scan lists (dynamic partition pruning)."""
    return read_panel(spark, path).join(F.broadcast(years.select("year").distinct()), "year", "left_semi")


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, path: str, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as a table of hash buckets of ``keys``, each sorted by
    them, and return the table. Tables with equal keys and buckets meet in a
    join or a grouping on the keys without a shuffle, however often. One task
    writes a bucket, so each bucket is one file. Bucket by all keys of the
    join: a hot ticker then spreads over its dates."""
    (
        df.repartition(buckets, *keys).write.mode(mode)
        .bucketBy(buckets, keys[0], *keys[1:]).sortBy(*keys)
        .option("path", path).saveAsTable(table)
    )
    return df.sparkSession.table(table)
