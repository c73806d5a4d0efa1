"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, source
mix and BPE encoding, each a stage over what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the
columns of ``documents``. The last gives the training rows: doc_id, lang,
source, n_tokens and ids (little-endian unsigned 32-bit integers). A document
that the mix takes twice has two rows.

Cases, by stage: a null or empty text has no words and goes with the quality
rules, so the later stages meet texts of 50 words or more; each still takes
null and empty texts as its module says. A null language is judged by its own
documents or by all; a null source is a source of its own, last in the order; a
null id can stay, and loses a tie for the id that is kept. Repeated rows are
copies: one stays. Very long texts are read whole in every stage. Columns that
``documents`` has beside its own are kept up to the mix, whatever their names,
and left out by the last stage. An empty table gives empty stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tiltkit.llm import bpe, exact_dedup, mixing, ngram_join, quality
from tiltkit.llm.common import BATCH_ROWS, table
from tiltkit.session import ensure_checkpoint_dir


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _few_texts(spark: SparkSession) -> None:
    """Python workers get few whole texts at a time, so their memory stays
    small beside the JVM's. A stage's rows are computed when they are written,
    so a stage leaves the setting behind; ``run`` puts it back."""
    spark.conf.set(BATCH, str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    _few_texts(spark)
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8."""
    _few_texts(spark)
    return ngram_join.keep_one(docs, k=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights."""
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    _few_texts(spark)
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), drop_text=True)
    return tokens.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage),
          ("source mix", mix_stage), ("BPE encoding", encode_stage)]

#: Encoding has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written to the
    shared checkpoint folder and read again, so a lost executor never costs
    more than one stage, and the session's settings are as before."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, was = table(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for i, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    finally:
        spark.conf.set(BATCH, was)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
