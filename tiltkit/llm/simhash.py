"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the
hashes of its 3-word shingles, repeats included. Two fingerprints link when
they differ in ``RADIUS`` = 2 bits or fewer. Copies of a fingerprint are one
entry, whatever their number, and only entries are searched:

1. A fingerprint has two segments of 32 bits. If two differ in 2 bits at most,
   their upper segments differ in one bit at most, or their lower segments are
   equal. So an entry looks into the table of upper segments with the ball of
   radius 1 around its own (of two segments that differ in a bit, the one with
   a 0 there looks) and into the table of lower segments with its own.
2. Entries met in a bucket are verified by their whole distance.
3. A bucket of more than ``MOST`` entries (many near copies, or a segment that
   texts of one kind share) is not searched entry by entry. Its entries, and
   those that look into it, go into a table of the balls of radius 1 around
   whole fingerprints instead, 65 rows each: two entries are at most 2 bits
   apart exactly when their balls share a point, so all entries at a point
   link with the least of them. No link is lost, and no point has more than 65.
4. ``components`` connects the links.

Rows per entry are bounded (18 lookups, 2 table rows, 65 ball points), so are
pairs (``MOST`` per lookup), and everything is a shuffle on 64-bit values.

Cases: a text without words, or a null text, has fingerprint zero and links as
any other; copies, ties and repeated rows each give a result row; a null id is
ignored in a smallest id unless all are null; an empty table gives an empty
result; other columns cannot clash, as only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import col, small_batches
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Most entries of a bucket that is searched entry by entry.
MOST = 32
#: Bytes of text whose words a task holds at a time.
BLOCK_BYTES = 1 << 20
_LOW = 0xFFFFFFFF


def word_blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``size`` bytes."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes) -> int:
    """The fingerprint of a whole text, in memory bounded by a block."""
    import numpy as np
    import xxhash

    digest, held, n = xxhash.xxh64_intdigest, [], 0
    ones = np.zeros(64, dtype=np.int64)

    def add(words: list[bytes], k: int) -> int:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=len(words) - k + 1)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        return len(hashes)

    for words in word_blocks(text.lower()):  # of bytes: A-Z only
        held = held[1 - SHINGLE:] + words if n else held + words
        if len(held) >= SHINGLE:
            n += add(held, SHINGLE)
    if not n and held:
        n = add(held, len(held))
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp) of (id, text), fp as the signed 64-bit number of its bits."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp bigint")


def _upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(_LOW))


def _table(entries: DataFrame) -> DataFrame:
    """(seg, key, fp): every entry under its two segments."""
    fp = F.col("fp")
    pair = F.array(F.struct(F.lit(0).alias("seg"), _upper(fp).alias("key")), F.struct(F.lit(1).alias("seg"), _lower(fp).alias("key")))
    return entries.select(F.explode(pair).alias("s"), "fp").select("s.*", "fp")


def _lookups(entries: DataFrame) -> DataFrame:
    """(seg, key, x, own): where an entry looks; ``own`` tells its own bucket."""
    fp = F.col("fp")
    own = _table(entries).select("seg", "key", F.col("fp").alias("x"), F.lit(True).alias("own"))
    zeros = F.filter(F.array(*[F.lit(1 << j) for j in range(32)]), lambda bit: _upper(fp).bitwiseAND(bit) == 0)
    ball = entries.select(F.explode(F.transform(zeros, lambda bit: _upper(fp).bitwiseOR(bit))).alias("key"), F.col("fp").alias("x"))
    return own.unionByName(ball.select(F.lit(0).alias("seg"), "key", "x", F.lit(False).alias("own")))


def _ball_links(entries: DataFrame) -> DataFrame:
    """(a, b): links by shared points of the balls of radius 1."""
    points = [F.lit(0), *[F.lit(1 << j if j < 63 else -1 << 63) for j in range(64)]]
    fp = F.col("fp")
    rows = entries.select(F.explode(F.transform(F.array(*[p.cast("long") for p in points]), lambda bit: fp.bitwiseXOR(bit))).alias("point"), "fp")
    # at most 65 entries lie at a point
    met = rows.groupBy("point").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b").distinct()


def links(entries: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links that connect the same distinct fingerprints ``fp`` as all
    links within ``RADIUS`` bits do."""
    table = _table(entries)
    sizes = materialize(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1 OR seg = 0"))
    looks = _lookups(entries)
    small = table.join(sizes.where(F.col("m") <= most), ["seg", "key"])
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("fp"))) <= RADIUS
    met = looks.join(small, ["seg", "key"]).where(near & (~F.col("own") | (F.col("x") < F.col("fp"))))
    hot = looks.join(sizes.where(F.col("m") > most), ["seg", "key"], "left_semi").select(F.col("x").alias("fp")).distinct()
    return materialize(met.select(F.col("x").alias("a"), F.col("fp").alias("b")).unionByName(_ball_links(materialize(hot))))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id (smallest
    id reachable by links, the own one included)."""
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).alias("text"))
    with small_batches(docs.sparkSession):
        info = materialize(fingerprints(rows))
    entries = materialize(info.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(entries.select("fp"), most))
    known = entries.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    known = materialize(known)
    best = known.groupBy("group").agg(F.min("least").alias("component_id"))
    told = info.join(known.join(best, "group").select("fp", "component_id"), "fp")
    return told.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
