"""Exact dedup with two passes over a Bloom filter.

Pass 1 sets bits: every text's hash names one 64-bit word of the filter and
three bits in it, and a bit counts only once two rows have set it. Pass 2
probes: a row whose three bits are all set twice may be repeated, and only
those rows shuffle, to be grouped by the exact digest. The others pass
straight through. The filter holds at most ``MAX_WORDS`` words by construction
(an empty word is not stored), so it is broadcast; over more rows it fills up
and lets more rows take the exact path, with the same result.

Texts are equal when identical after lower-casing A-Z; the row with the
largest id stays. Cases: a null text counts as empty, and all empty texts are
equal to each other; a null id is smaller than any other; of rows with the
same id and the same text one stays; other columns pass unchanged; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import materialize
from .common import col, packed, unpacked

#: Filter bits per row, bits set by a row, and the filter's largest size.
BITS_PER_ROW = 16
PROBES = 3
MAX_WORDS = 1 << 20


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with A-Z lower-cased, null as empty."""
    @F.arrow_udf(StringType())
    def sha(texts):
        import hashlib

        import pyarrow as pa

        # bytes.lower() changes A-Z only
        return pa.array([hashlib.sha256((t.as_py() or b"").lower()).hexdigest() for t in texts.cast(pa.binary())],
                        pa.string())

    return sha(F.coalesce(text, F.lit("")))


def filter_words(rows: int) -> int:
    """64-bit words of a filter for so many rows, a power of two."""
    need = max(1, rows * BITS_PER_ROW // 64)
    return min(MAX_WORDS, 1 << (need - 1).bit_length())


def _word(sha: Column, n_words: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(n_words))


def _mask(sha: Column) -> Column:
    """The bits of a row within its word."""
    out = None
    for j in range(PROBES):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(sha, j))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _bit(sha: Column, j: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(j)), F.lit(64)).cast("int")


def repeat_filter(shas: DataFrame, n_words: int) -> DataFrame:
    """(word, mask): the bits that at least two rows have set."""
    bits = shas.select(_word(F.col("sha"), n_words).alias("word"),
                       F.explode(F.array_distinct(F.array(*[_bit(F.col("sha"), j) for j in range(PROBES)]))).alias("bit"))
    twice = bits.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"))


def probe(rows: DataFrame, twice: DataFrame, n_words: int) -> DataFrame:
    """Adds ``maybe``: all bits of the row are set twice."""
    marked = rows.withColumns({"word": _word(F.col("sha"), n_words), "need": _mask(F.col("sha"))})
    # at most MAX_WORDS rows of two longs
    found = marked.join(F.broadcast(twice), "word", "left")
    return found.withColumn("maybe", F.coalesce(F.col("mask").bitwiseAND(F.col("need")) == F.col("need"), F.lit(False))
                            ).drop("word", "need", "mask")


def _hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return materialize(docs.select(col(docs, id_col).alias("id"), digest(col(docs, text_col)).alias("sha")))


def _stays(rows: DataFrame) -> DataFrame:
    """Per repeated digest: id that stays, number of rows, rows with that id.
    Written, so that the join with the rows can split a hot digest."""
    return materialize(rows.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
                       .groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    hashes = _hashes(docs, id_col, text_col)
    n_words = filter_words(hashes.count())
    rows = probe(hashes, repeat_filter(hashes, n_words), n_words)
    alone = rows.where(~F.col("maybe")).select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    maybe = rows.where("maybe")
    # equal rows in every column of the result, so they may be counted first
    counted = maybe.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.join(_stays(maybe), "sha").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return alone.unionByName(grouped.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    hashes = _hashes(docs, id_col, text_col)
    n_words = filter_words(hashes.count())
    twice = materialize(repeat_filter(hashes, n_words))
    stays = _stays(probe(hashes, twice, n_words).where("maybe"))
    rows = probe(docs.select(packed(docs), col(docs, id_col).alias("id"), digest(col(docs, text_col)).alias("sha")),
                 twice, n_words)
    alone = rows.where(~F.col("maybe")).select("row_")
    maybe = rows.where("maybe").join(stays, "sha").where(F.col("id").eqNullSafe(F.col("keep_id")))
    # more than one row is left of a digest only where rows repeat their id too
    return unpacked(alone.unionByName(maybe.groupBy("sha").agg(F.first("row_").alias("row_")).select("row_")))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY sha ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz')) AS sha FROM documents)
WINDOW w AS (PARTITION BY sha)
"""
