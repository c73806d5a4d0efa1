"""Packing of token ids into rows of fixed length, best fit decreasing.

Documents are encoded (strings of special tokens as ordinary text) and cut losslessly into pieces of at most ``length``
tokens. The pieces are dealt to shards of bounded size by a hash of document
and piece, so neither a very long document nor a hot source makes a large
shard. Within a shard the pieces go, longest first, into the open row with the
least room that still takes them; a segment tree over the room 0..length finds
that row in log(length) steps. Each row is one packed matrix row: ids padded to
the length, cumulative segment lengths, and position resets (positions restart
at 0 with every segment).

Cases: a null or empty text has no tokens and no piece; repeated rows, and rows
with the same or a null id, are packed each; equal lengths go in order of id,
piece and text digest, so reruns agree; other columns cannot clash; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .common import col

LENGTH = 2048
#: Bytes of text per shard; a token has a byte at least.
SHARD_BYTES = 8 << 20
#: Ids that a task gathers before it gives them on.
FLUSH_BYTES = 4 << 20
PAD = 50256


class Rooms:
    """Open rows by room left, with a segment tree of which rooms occur."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _set(self, room: int) -> None:
        i = self.size + room
        self.any[i] = bool(self.rows[room])
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        if len(self.rows[room]) == 1:
            self._set(room)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, and its room."""
        i = self.size + need
        if not self.any[i]:
            # up to the first left child whose right sibling holds a room
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._set(room)
        return row, room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of positions of ``sizes`` (given longest first), best fit."""
    rooms, rows = Rooms(length), []
    for i, n in enumerate(sizes):
        found = rooms.take(n)
        if found is None:
            rows.append([i])
            row, room = len(rows) - 1, length
        else:
            row, room = found
            rows[row].append(i)
        if room > n:
            rooms.put(row, room - n)
    return rows


class _Vocabulary:
    """A vocabulary of ranks, sent as text and built once per worker."""

    built: dict[int, object] = {}

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.sent = spark.sparkContext.broadcast(f.read())  # under 1 MB
        self.id = id(self.sent)

    def encoding(self):
        import base64

        import tiktoken

        if self.id not in self.built:
            self.built.clear()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.sent.value.splitlines())}
            self.built[self.id] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return self.built[self.id]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pieces(docs: DataFrame, length: int, vocabulary: _Vocabulary) -> DataFrame:
    """(id, piece, start, tie, ids) of (id, text): pieces of at most
    ``length`` ids, as 16-bit numbers (the vocabulary has fewer ids)."""
    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np

        encode = vocabulary.encoding().encode_ordinary
        for batch in batches:
            out = {"id": [], "start": [], "tie": [], "ids": []}
            size = 0
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = np.array(encode(text.as_py()), dtype="<u2")
                tie = zlib.crc32(ids.tobytes())
                for at in range(0, len(ids), length):
                    piece = ids[at:at + length].tobytes()
                    for k, v in zip(out, (i, at, tie, piece)):
                        out[k].append(v)
                    size += len(piece)
                if size > FLUSH_BYTES:
                    yield _batch(out)
                    out, size = {k: [] for k in out}, 0
            yield _batch(out)

    def _batch(out):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return docs.mapInArrow(run, "id bigint, start bigint, tie bigint, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         pad: int = PAD, vocabulary: str | None = None) -> DataFrame:
    """Encodes, cuts and packs (the vocabulary is a file of fewer than 2^16
    ranks). One row per packed row: shard, row_no, doc_ids, starts (of each segment
    in its document, in tokens), cu_seqlens, n_tokens, ids (``length``
    little-endian unsigned 32-bit integers) and position_ids (as ids)."""
    rows = docs.select(col(docs, id_col).cast("long").alias("id"), F.coalesce(col(docs, text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_shards = 1 + size // SHARD_BYTES
    pieces = _pieces(rows, length, _Vocabulary(docs.sparkSession, vocabulary or default_ranks()))
    shard = F.pmod(F.xxhash64("id", "start", "tie"), F.lit(n_shards))
    dealt = pieces.withColumn("shard", shard).repartition(F.col("shard")).sortWithinPartitions(
        "shard", F.desc(F.octet_length("ids")), "id", "start", "tie")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows_of(shard, ids, starts, grams):
            """grams: ids of the pieces, longest first."""
            made = best_fit([len(g) for g in grams], length)
            for at in range(0, len(made), 256):
                out = {k: [] for k in ("doc_ids", "starts", "cu_seqlens", "n_tokens", "ids", "position_ids")}
                for row in made[at:at + 256]:
                    sizes = [len(grams[i]) for i in row]
                    room = length - sum(sizes)
                    out["doc_ids"].append([ids[i] for i in row])
                    out["starts"].append([starts[i] for i in row])
                    out["cu_seqlens"].append([0, *np.cumsum(sizes).tolist()])
                    out["n_tokens"].append(length - room)
                    out["ids"].append(np.concatenate([*(grams[i] for i in row), np.full(room, pad, dtype="<u4")]).astype("<u4").tobytes())
                    out["position_ids"].append(np.concatenate([np.arange(n, dtype="<u4") for n in [*sizes, room]]).tobytes())
                n = len(out["ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()),
                     pa.array(out["doc_ids"], pa.list_(pa.int64())), pa.array(out["starts"], pa.list_(pa.int64())),
                     pa.array(out["cu_seqlens"], pa.list_(pa.int32())), pa.array(out["n_tokens"], pa.int64()),
                     pa.array(out["ids"], pa.binary()), pa.array(out["position_ids"], pa.binary())],
                    names=["shard", "row_no", *out])

        now, ids, starts, grams = None, [], [], []
        for batch in batches:
            for s, i, a, g in zip(batch.column("shard").to_pylist(), batch.column("id").to_pylist(),
                                  batch.column("start").to_pylist(), batch.column("ids")):
                if s != now:
                    if grams:
                        yield from rows_of(now, ids, starts, grams)
                    now, ids, starts, grams = s, [], [], []
                ids.append(i), starts.append(a), grams.append(np.frombuffer(g.as_py(), dtype="<u2"))
        if grams:
            yield from rows_of(now, ids, starts, grams)

    schema = ("shard bigint, row_no bigint, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, "
              "n_tokens bigint, ids binary, position_ids binary")
    return dealt.select("shard", "id", "start", "ids").mapInArrow(run, schema)


def digests(packs: DataFrame) -> DataFrame:
    """The packed rows with digests in place of the two matrices."""
    return packs.select("shard", "row_no", "doc_ids", "starts", "cu_seqlens", "n_tokens",
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def write_packs(packs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes the packed rows as Parquet: ids and position_ids are rows of
    uint32 matrices, cu_seqlens their cumulative segment lengths."""
    packs.write.mode(mode).parquet(path)
