"""Monthly option files as a stream: each new file becomes a part of the panel.

The study turns months into the yearly panel one file at a time and appends
the result. Here a Structured Streaming file source picks up new monthly
files (``maxFilesPerTrigger`` files per micro-batch) and ``foreachBatch``
runs the batch job on each micro-batch as far as it can be merged: universe
semi join, derived columns, 8-key sums. Sums of micro-batch ``n`` go to
``<output>/batch_id=n`` in overwrite mode, so a batch replayed after a failure
(the source and the progress are in the checkpoint) replaces its own part
instead of doubling it.

A date may come in several files. The HAVING filter is therefore not applied
to a part, whose sums need not be whole; ``read_stream_panel`` adds up the
parts by the eight keys and filters then, so the panel equals the batch panel
over all files. ``compact_stream_panel`` writes it as the yearly panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import KeySet
from ..operators.panel import classify_options, panel_sums, with_volume
from ..schema import MEASURES, OPTION_MONTH, PANEL_KEYS
from ..sources.io import write_panel


def month_stream(spark: SparkSession, source_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Streaming DataFrame over the monthly option parquet files of a folder
    (or of the folders that a pattern names)."""
    return (
        spark.readStream.schema(OPTION_MONTH)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source_dir)
    )


def panel_stream(spark: SparkSession, source_dir: str, universe: DataFrame, output_dir: str,
                 checkpoint_dir: str, files_per_trigger: int = 1,
                 available_now: bool = True) -> StreamingQuery:
    """Start the stream; returns the running query (``awaitTermination`` it).

    ``universe`` (a frame with ``ticker``) is reduced to its distinct names,
    written and counted once; each batch is filtered by them as in the batch
    panel. ``checkpoint_dir`` must be on a shared file system on a cluster.
    """
    tickers = KeySet(universe, "ticker")

    def write_part(batch: DataFrame, batch_id: int) -> None:
        part = panel_sums(classify_options(tickers.semi_join(batch))).withColumn("year", F.year("date"))
        (part.write.mode("overwrite").partitionBy("year")
         .parquet(f"{output_dir}/batch_id={batch_id}"))

    writer = (
        month_stream(spark, source_dir, files_per_trigger).writeStream
        .foreachBatch(write_part)
        .option("checkpointLocation", checkpoint_dir)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_stream_panel(spark: SparkSession, output_dir: str) -> DataFrame:
    """The panel of all batches written by ``panel_stream``: parts merged by
    the eight keys (they combine before the shuffle), then HAVING."""
    return with_volume(panel_sums(spark.read.parquet(output_dir).select(*PANEL_KEYS, *MEASURES)))


def compact_stream_panel(spark: SparkSession, output_dir: str, panel_dir: str) -> None:
    """The merged panel as files by year, as ``write_panel`` leaves them."""
    write_panel(read_stream_panel(spark, output_dir), panel_dir)
