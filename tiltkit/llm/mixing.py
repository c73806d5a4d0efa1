"""Mixing sources to target weights by systematic sampling, with DataFrame
expressions only.

A document's size is its number of words. Every source has a weight and a
target number of words (``targets``); target / source size is the number of
copies expected of each of its documents. The expected copies are prefix-summed
over the source's documents in order of (size, id), one random offset per
source is added, and a document is emitted once per integer boundary that its
interval crosses. As neighbours in that order have like sizes, the words taken
stay within about one document of the target.

Scale: the position of a document in its source is the sum of three counts,
of smaller sizes, of earlier id blocks of its size, and of earlier rows of its
block, so no window ever holds a source, however large: the windows run over
the distinct sizes of a source, the id blocks of a size and the rows of a block
(``BLOCK_BITS`` low bits of the id). Only the sources themselves are ranked in
one task; more than ``MAX_SOURCES`` raise an error.

Cases: a null text has size 0; a null source is a source of its own, last in
order; null ids come first in their size; rows with the same id and text are
alike, so it does not matter which of them is emitted; an empty table gives an
empty result; columns of the input cannot clash with working columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, col, packed, unpacked

#: Weights by order of source names, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its size.
MAX_COPIES = 3
#: Seed of the offsets.
SEED = "mix"
BLOCK_BITS = 14
MAX_SOURCES = 1_000_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Sorts as the names by code point, null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _block(i: Column, tie: Column) -> Column:
    """Blocks of ids; null ids are spread over blocks before all others."""
    return F.coalesce(F.shiftright(i.cast("long"), BLOCK_BITS), F.lit(-(1 << 62)).cast("long") + F.pmod(tie, F.lit(4096)))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = col(docs, text_col)
    rows = docs.select(*more, col(docs, id_col).alias("id"), size_of(text).alias("size"),
                       _source_key(col(docs, source_col)).alias("source"), F.xxhash64(text).alias("tie"))
    return rows.withColumn("block", _block(F.col("id"), F.col("tie")))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also ``target`` and ``rate``, the copies
    expected of a document. All sizes are shared by weight; a source's target
    stops at MAX_COPIES times its size and the excess is shared again by weight
    among the others. In order of size per weight the sources that stop come
    first, so one pass finds them: a source stops if its limit is below its
    share of what those before it leave."""
    if sizes.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sizes.withColumn("weight", F.get(weights, (F.row_number().over(Window.orderBy("source")) - 1) % len(WEIGHTS)))
    ranked = ranked.withColumn("most", MAX_COPIES * F.col("source_size"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "source")
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    stopped = ranked.withColumns({"left": left.cast("double"), "weight_left": weight_left.cast("double")}).withColumn(
        "stops", F.col("most") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    kept = F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0)).over(everything)
    total = F.sum("source_size").over(everything)
    open_weight = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(
        F.col("weight") * (total - kept).cast("double") / F.nullif(open_weight, F.lit(0)).cast("double"))
    found = stopped.withColumn("target", target)
    return found.select("source", "source_size", "target", F.when(
        F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def _offset(source: Column) -> Column:
    """The random offset of a source, in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), source)), 1, 8), 16, 10).cast("long") / float(1 << 32)


def plan(rows: DataFrame) -> DataFrame:
    """Per (source, size, block): documents before it in its source, and the
    source's size, target, rate and offset."""
    blocks = materialize(rows.groupBy("source", "size", "block").agg(F.count(F.lit(1)).alias("n")))
    per_size = blocks.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = materialize(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_size = per_size.select("source", "size", earlier(Window.partitionBy("source").orderBy("size")).alias("smaller"))
    in_size = blocks.select("source", "size", "block",
                            earlier(Window.partitionBy("source", "size").orderBy("block")).alias("earlier"))
    found = in_size.join(per_size, ["source", "size"]).join(
        targets(sources).withColumn("offset", _offset(F.col("source"))), "source")
    return found.select("source", "size", "block", (F.col("smaller") + F.col("earlier")).alias("before"),
                        "source_size", "target", "rate", "offset")


def _copies(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Adds ``copies``: integer boundaries in the document's interval."""
    in_block = Window.partitionBy("source", "size", "block").orderBy("id", "tie")
    placed = rows.withColumn("r", F.row_number().over(in_block)).join(at, ["source", "size", "block"])
    reach = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    k = F.col("before") + F.col("r")
    return placed.withColumn("copies", F.least(reach(k) - reach(k - 1), F.lit(MAX_COPIES).cast("long")))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: id, size, source_size, target and taken (words)."""
    rows = materialize(_rows(docs, id_col, text_col, source_col))
    return _copies(rows, plan(rows)).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, one row per copy, with the input's columns."""
    at = materialize(plan(_rows(docs, id_col, text_col, source_col)))
    chosen = _copies(_rows(docs, id_col, text_col, source_col, packed(docs)), at).where("copies > 0")
    return unpacked(chosen.select("row_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row_"))


def sql(documents: str = "documents") -> str:
    """DuckDB SQL for the rows of ``mix_sizes``."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source FROM {documents}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source) - 1) % 3 AS weight, 3 * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (
                   ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
             (sum(weight) OVER (ORDER BY most / weight, source
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weight_left FROM w),
t AS (SELECT *, most * weight_left <= weight * rest AS stops FROM l),
g AS (SELECT source, source_size,
             CASE WHEN stops THEN most::DOUBLE ELSE
               weight * (sum(source_size) OVER () - sum(CASE WHEN stops THEN most ELSE 0 END) OVER ())::DOUBLE
               / (sum(CASE WHEN stops THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('{SEED}:' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM g),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS k FROM d)
SELECT k.doc_id, k.size, r.source_size, r.target,
       CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), {MAX_COPIES}) AS BIGINT) * k.size AS taken
FROM k JOIN r USING (source)
"""
