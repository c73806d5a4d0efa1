"""BPE encoding and decoding by a contiguous rank array per word.

The text is cut into words by the vocabulary's own pattern. A word keeps its
part boundaries and the merge ranks of adjacent parts in two plain arrays; the
smallest rank is scanned for, its boundary deleted and the two neighbouring
ranks refreshed, until no pair can merge. Words above ``SHORT`` bytes use a
heap with the same merge order, as scanning is quadratic in the word's length.

Parts are known by their ids and a pair of ids, as one number, has its rank, so
no bytes are cut. Spark partitions the documents and each task encodes its rows
one by one, so memory is bounded by one Arrow batch plus a cache of encoded words
bounded in bytes.

Cases: a null text counts as empty; an empty text has no ids and decodes to an
empty text; repeated rows are encoded each; other columns pass unchanged
(columns named as a result column are replaced); an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import BATCH_ROWS

#: Words above this many bytes merge with a heap instead of array scans.
SHORT = 96
#: Bytes of encoded words a task remembers at most, in each of two generations
#: (some 150,000 words).
CACHE_BYTES = 24 << 20
#: Bytes that a remembered word takes beside its letters and ids.
ENTRY_BYTES = 140
#: Bits of an id in a pair.
PAIR = 24
#: The pre-tokeniser's pattern of the byte-level vocabulary.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
           r"|\s+(?!\S)|\s+")
NO_RANK = 1 << 60


def default_vocabulary() -> str:
    """Path of the installed byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes stand for themselves, the others follow from code point
    256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and byte strings of a byte-level BPE file."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        # a pair of ids, as one number -> its rank; the id that a rank makes
        self.ranks, self.made = {}, []
        for i, (x, y) in enumerate((raw(a), raw(b)) for a, b in pairs):
            self.ranks[self.ids[x] << PAIR | self.ids[y]] = i
            self.made.append(self.ids[x + y])
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for name, i in self.special.items():
            self.pieces[i] = name.encode()
        # \s of the pattern means Unicode white space
        self.words = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}")
                                   .replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.cuts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.cache: dict[str, bytes] = _Encoded(self)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known = self.cache.__getitem__
        if not self.cuts or not any(s in text for s in self.special):
            return b"".join(map(known, self.words.findall(text)))
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += map(known, self.words.findall(text[at:m.start()]))
            out.append(self.special[m.group()].to_bytes(4, "little"))
            at = m.end()
        out += map(known, self.words.findall(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, _numbers(ids))).decode("utf-8", "replace")


class _Encoded(dict):
    """Ids of words, made when first asked for. Of words that are no entries
    of the vocabulary, the bytes remembered are bounded, also within one text:
    when full, the words become the old generation, from which those asked for
    again come back. What entries become is settled once."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.old, self.entries, self.held = vocabulary, {}, {}, 0

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            piece = word.encode()
            out = array("I", (merge_short if len(piece) <= SHORT else merge_long)(piece, self.v))
            if sys.byteorder == "big":
                out.byteswap()
            out = out.tobytes()
            if piece in self.v.ids:
                self[word] = self.entries[word] = out
                return out
            if len(piece) > SHORT:
                return out
        self.held += ENTRY_BYTES + 2 * len(word) + len(out)
        if self.held > CACHE_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()
            self.update(self.entries)
        self[word] = out
        return out


def _numbers(ids: bytes) -> array:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a


def merge_short(piece: bytes, v: Vocabulary) -> list[int]:
    """The ids of a word by repeated scans of one contiguous rank array: part
    i is known by its id, and around[i] is the rank of parts i and i + 1."""
    ids = [v.bytes[b] for b in piece]
    rank = v.ranks.get
    around = [rank(a << PAIR | b, NO_RANK) for a, b in zip(ids, ids[1:])]
    while around and (least := min(around)) < NO_RANK:
        i = around.index(least)
        made = ids[i] = v.made[least]
        del ids[i + 1], around[i]
        if i < len(around):
            around[i] = rank(made << PAIR | ids[i + 1], NO_RANK)
        if i:
            around[i - 1] = rank(ids[i - 1] << PAIR | made, NO_RANK)
    return ids


def merge_long(piece: bytes, v: Vocabulary) -> list[int]:
    """The same merges in the same order (least rank, then leftmost) in
    O(n log n), by a heap over linked part starts."""
    n = len(piece)
    ids = [v.bytes[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = v.ranks.get
    heap = [(r, a, x, y) for a, (x, y) in enumerate(zip(ids, ids[1:])) if (r := rank(x << PAIR | y, NO_RANK)) < NO_RANK]
    heapq.heapify(heap)
    while heap:
        r, a, x, y = heapq.heappop(heap)
        b = after[a]
        if ids[a] != x or b >= n or ids[b] != y:
            continue  # one of its parts has merged meanwhile
        ids[a], ids[b], c = v.made[r], -1, after[b]
        after[a] = c
        if c < n:
            before[c] = a
        for s in (before[a], a):
            if s >= 0 and (t := after[s]) < n and (r := rank(ids[s] << PAIR | ids[t], NO_RANK)) < NO_RANK:
                heapq.heappush(heap, (r, s, ids[s], ids[t]))
    return [i for i in ids if i >= 0]


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The vocabulary of a broadcast file, built once per worker process."""
    if shared.id not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.id] = Vocabulary(shared.value)
    return _LOADED[shared.id]


class _Shared:
    """A vocabulary file's text, sent to the executors once (about 2 MB)."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.sent = spark.sparkContext.broadcast(f.read())
        self.id = self.sent._jbroadcast.id() if self.sent._jbroadcast else hash(path)

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self) -> str:
        return self.sent.value


def _map_column(df: DataFrame, source: str, added: list[StructField], fn, drop: bool) -> DataFrame:
    """Replace or add columns computed from one column, an Arrow batch at a
    time and a row at a time within it."""
    names = [f.name for f in added]
    keep = [f for f in df.schema.fields if f.name not in names and not (drop and f.name == source)]
    schema = StructType([*keep, *added])
    kept = [f.name for f in keep]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            rows = batch.column(batch.schema.get_field_index(source))
            out = fn(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + out, names=[*kept, *names])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None,
           drop_text: bool = False) -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``."""
    shared = _Shared(docs.sparkSession, vocabulary or default_vocabulary())

    def fn(texts):
        import pyarrow as pa

        v = _vocabulary(shared)
        ids = [v.encode(t.as_py() or "") for t in texts]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return _map_column(docs, text_col, [StructField("ids", BinaryType()), StructField("n_tokens", LongType())],
                       fn, drop_text)


def decode(tokens: DataFrame, ids_col: str = "ids", vocabulary: str | None = None,
           out_col: str = "decoded") -> DataFrame:
    """Adds the text that an ``ids`` column stands for."""
    shared = _Shared(tokens.sparkSession, vocabulary or default_vocabulary())

    def fn(ids):
        import pyarrow as pa

        v = _vocabulary(shared)
        return [pa.array([v.decode(x.as_py() or b"") for x in ids], pa.string())]

    return _map_column(tokens, ids_col, [StructField(out_col, StringType())], fn, False)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            vocabulary: str | None = None) -> DataFrame:
    """Per document: id, number of tokens, digest of the ids and of the text
    that decoding them gives (encoded and decoded a row at a time)."""
    shared = _Shared(docs.sparkSession, vocabulary or default_vocabulary())

    def fn(texts):
        import hashlib

        import pyarrow as pa

        v, rows = _vocabulary(shared), []
        for t in texts:
            ids = v.encode(t.as_py() or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()))
        n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    added = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _map_column(docs.select(id_col, text_col), text_col, added, fn, True)
