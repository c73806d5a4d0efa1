"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(df: DataFrame, name: str) -> Column:
    """The column ``name``, also when it holds dots or other special signs."""
    return df[f"`{name}`"]


def packed(df: DataFrame, name: str = "row_") -> Column:
    """The whole input row as one struct, so that no working column can clash
    with a column of the input; ``unpacked`` gives the columns back."""
    return F.struct(*[col(df, c) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, name: str = "row_") -> DataFrame:
    return df.select(f"{name}.*")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row. Inside a
    higher-order function a captured expression would be evaluated again for
    every element; a lambda variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


class Rounds:
    """Tables of an iteration, written to the shared checkpoint folder and
    read again. Unlike a checkpointed frame, a table that is read again has no
    constraints inferred from its past, which would grow from round to round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{ensure_checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that travel to Python at a time.
BATCH_ROWS = 500


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs run inside send at most so many rows to Python at a time, so a
    worker's memory is bounded by few texts; the session's setting returns."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


@contextlib.contextmanager
def sized_shuffles(spark: SparkSession, rows: int, task_rows: int) -> Iterator[None]:
    """Jobs run inside shuffle to as many partitions as so many rows need, at
    most to the session's own number; the session's setting returns."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(was), -(-rows // task_rows)))))
    try:
        yield
    finally:
        spark.conf.set(name, was)
