"""Prefix trie of conversations: what they share, and what sharing saves.

Every distinct sequence of first d turns of the conversations is a node. The
work is dealt to tasks by ranges of the sorted distinct conversations:

1. A turn is known by a 128-bit digest of role and text and by its text's
   bytes; texts do not travel. Equal conversations become one row with their
   number, least id and the hash of their ids. Their ids are sorted by a range
   shuffle and joined into strings of bounded size before one task per
   conversation streams them through the hash (a SHA-256 has no parallel form).
2. Distinct conversations are sorted by their digests over all tasks, so each
   task has a run of neighbours. It inserts them in batches into a z-fast trie
   (``zfast``) and expands the trie's edges to nodes. A trie that has many
   steps is written out and a new one begun, so memory is bounded.
3. Two tries can share only nodes on the path between the last conversation of
   one and the first of the next. Sums over members and subtrees are additive
   but for what both tries count on that path, which is subtracted; so only
   nodes on first and last paths are merged in a shuffle, all others are final.

Any prefix may be hot (a first turn that all share): ranges split it.

Cases: a null role or text is empty; a null turn comes first; rows with the
same turn are ordered by digest, and repeated rows are turns of their own; rows
without conv_id belong to no conversation and are left out; a conversation
without turns ends at the root; an empty table has no node; other columns are
not read. A conversation's digests (24 bytes a turn) are held as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import col, small_batches

#: Ids that are joined into one string.
CHUNK_IDS = 1_000
#: Conversations inserted as a batch, and steps of a trie that is written out.
BATCH = 1_000
MOST_STEPS = 400_000
_WIDTH = 16
_NO_TURN = bytes(_WIDTH)


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of (conv_id, turn, role, text) rows: the turns' digests
    and text bytes in order."""
    role, text = (F.coalesce(col(rows, c).cast("string"), F.lit("")) for c in ("role", "text"))
    sign = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(col(rows, "turn").alias("turn"), F.unhex(F.substring(sign, 1, 2 * _WIDTH)).alias("d"),
                    F.octet_length(text).cast("long").alias("w"))
    one = rows.select(col(rows, "conv_id").alias("conv_id"), turn.alias("t")).where("conv_id IS NOT NULL")
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w")))
    return one.groupBy("conv_id").agg(turns.alias("turns"))


def with_shared_starts(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) where each conversation c begins with the first h turns
    of conversation c - c % 5 in place of its own, h = crc32(c) % 9."""
    own = materialize(conversations_of(rows))
    base = own.select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, 8).alias("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    both = own.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % 5).join(base, "base_id", "left")
    first = F.slice(F.coalesce("base", F.slice("turns", 1, 0)), F.lit(1), h)
    return both.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _keyed(convs: DataFrame) -> DataFrame:
    """(seq, conv_id, steps, weights): a digest of the whole sequence, its
    turns' digests and their text bytes (as 8-byte numbers) in a row."""
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            steps, weights = [], []
            for turns in batch.column("turns").to_pylist():
                steps.append(b"".join(t["d"] for t in turns))
                weights.append(np.array([t["w"] for t in turns], dtype="<i8").tobytes())
            seq = [hashlib.blake2b(s, digest_size=_WIDTH).digest() for s in steps]
            columns = [pa.array(x, pa.binary()) for x in (seq, steps, weights)]
            yield pa.RecordBatch.from_arrays([columns[0], batch.column("conv_id"), *columns[1:]], names=["seq", "conv_id", "steps", "weights"])

    return convs.mapInArrow(run, "seq binary, conv_id bigint, steps binary, weights binary")


def _rows(batches: Iterator, names: tuple) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _batches(rows: Iterator[tuple], schema, size: int = 1_000) -> Iterator:
    """Arrow batches of rows."""
    import itertools

    import pyarrow as pa

    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def distinct_sequences(convs: DataFrame, chunk: int = CHUNK_IDS) -> DataFrame:
    """(steps, weights, n, least, ends): each distinct sequence with number,
    least and hash of the ids of its conversations."""
    keyed = materialize(_keyed(convs))

    def chunks(batches: Iterator) -> Iterator:
        import itertools

        import pyarrow as pa

        def told():
            for seq, run in itertools.groupby(_rows(batches, ("seq", "conv_id", "steps", "weights")), key=lambda r: r[0]):
                steps = None
                while part := list(itertools.islice(run, chunk)):
                    # the sequence itself goes with the first chunk of a run
                    steps, weights = (part[0][2], part[0][3]) if steps is None else (b"", None)
                    yield seq, part[0][1], len(part), ",".join(str(r[1]) for r in part), steps if weights is not None else None, weights

        yield from _batches(told(), pa.schema([("seq", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string()),
                                               ("steps", pa.binary()), ("weights", pa.binary())]))

    def ends(batches: Iterator) -> Iterator:
        import hashlib
        import itertools

        import pyarrow as pa

        def told():
            for _, run in itertools.groupby(_rows(batches, ("seq", "first", "n", "ids", "steps", "weights")), key=lambda r: r[0]):
                sha, n, least, whole = hashlib.sha256(), 0, None, None
                for _, first, more, ids, steps, weights in run:
                    sha.update((ids if least is None else "," + ids).encode())
                    n, least = n + more, first if least is None else least
                    whole = whole or (None if weights is None else (steps, weights))
                yield *whole, n, least, sha.hexdigest()

        yield from _batches(told(), pa.schema([("steps", pa.binary()), ("weights", pa.binary()), ("n", pa.int64()), ("least", pa.int64()),
                                               ("ends", pa.string())]))

    sorted_ids = keyed.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    joined = sorted_ids.mapInArrow(chunks, "seq binary, first bigint, n bigint, ids string, steps binary, weights binary")
    dealt = joined.repartition("seq").sortWithinPartitions("seq", "first")
    return dealt.mapInArrow(ends, "steps binary, weights binary, n bigint, least bigint, ends string")


def _path(steps: bytes) -> list[bytes]:
    """The hashes of all prefixes of a sequence."""
    from hashlib import blake2b

    path = [_NO_TURN]
    for at in range(0, len(steps), _WIDTH):
        path.append(blake2b(path[-1] + steps[at:at + _WIDTH], digest_size=_WIDTH).digest())
    return path


def _weights(raw: bytes) -> list[int]:
    import numpy as np

    return [0, *np.frombuffer(raw, dtype="<i8").tolist()]


def _shared(last: list, weights: list, first: list) -> Iterator[tuple]:
    """What two neighbouring tries both count, to be subtracted: (prefix,
    depth, children, leaves, once) of the nodes on the path that the last
    sequence of one and the first of the next share."""
    depth = 0
    while depth + 1 < min(len(last), len(first)) and last[depth + 1] == first[depth + 1]:
        depth += 1
    leaf, once = depth == len(last) - 1, 0
    for d in range(depth, -1, -1):
        once += weights[d]
        yield last[d], d, int(d < depth), int(leaf), once


#: kind: 0 a final node, 1 a part of a node on a first or last path, 2 what is
#: counted twice, 3 the first and last sequence of a task.
_PARTS = ("kind int, prefix binary, depth bigint, parent binary, least bigint, n bigint, children bigint, leaves bigint, copies bigint, "
          "once bigint, ends string, parent_least bigint, last binary, weights binary")


def _parts(sequences: DataFrame, most: int = MOST_STEPS, batch_size: int = BATCH) -> DataFrame:
    """The tries of all tasks, expanded."""
    def run(batches: Iterator) -> Iterator:
        import itertools

        import pyarrow as pa

        from .zfast import ZFastTrie

        schema = pa.schema([(c.split()[0], {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[c.split()[1]])
                            for c in _PARTS.split(", ")])

        def nodes(trie, first, last):
            edge = {*first, *last}
            for path, depth, children, label, total, up in trie.expanded():
                parent = path[depth - 1] if depth else None
                yield (int(path[depth] in edge), path[depth], depth, parent, total.least, total.n, children, total.leaves, total.copies, total.once,
                       label, up.least if depth and parent not in edge else None, None, None)

        def told():
            rows = _rows(batches, ("steps", "weights", "n", "least", "ends"))
            trie, steps = ZFastTrie(_NO_TURN), 0
            task_first = first = last = None
            while part := list(itertools.islice(rows, batch_size)):
                if steps >= most:
                    yield from nodes(trie, first, last[0])
                    trie, steps, first = ZFastTrie(_NO_TURN), 0, None
                items = [(_path(s), _weights(w), n, least, ends) for s, w, n, least, ends in part]
                if first is None:
                    first = items[0][0]
                    if last is not None:
                        for prefix, d, children, leaves, once in _shared(*last, first):
                            yield (2, prefix, d, None, None, 0, -children, -leaves, 0, -once, None, None, None, None)
                task_first = part[0][0] if task_first is None else task_first
                trie.insert(items)
                steps += sum(len(i[0]) for i in items)
                last, raw = items[-1][:2], part[-1][:2]
            if first is not None:
                yield from nodes(trie, first, last[0])
                yield (3, task_first, *[None] * 10, *raw)

        yield from _batches(told(), schema)

    return sequences.repartitionByRange("steps").sortWithinPartitions("steps").mapInArrow(run, _PARTS)


def _twice(parts: DataFrame) -> DataFrame:
    """What tries of neighbouring tasks both count; one row per task is read."""
    from pyspark.sql import Window

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told():
            for first, last, weights in _rows(batches, ("first", "last", "weights")):
                for prefix, d, children, leaves, once in _shared(_path(last), _weights(weights), _path(first)):
                    yield prefix, d, -children, -leaves, -once

        yield from _batches(told(), pa.schema([("prefix", pa.binary()), *((c, pa.int64()) for c in ("depth", "children", "leaves", "once"))]))

    ends = parts.where("kind = 3").select("prefix", "last", "weights")
    follows = ends.select("last", "weights", F.lead("prefix").over(Window.orderBy("prefix")).alias("first")).where("first IS NOT NULL")
    return follows.mapInArrow(run, "prefix binary, depth bigint, children bigint, leaves bigint, once bigint")


def trie_nodes(convs: DataFrame, most: int = MOST_STEPS, batch_size: int = BATCH, chunk: int = CHUNK_IDS) -> DataFrame:
    """The nodes of the trie of (conv_id, turns): conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (text bytes that
    members after the first repeat, over the subtree), ends_sha256."""
    with small_batches(convs.sparkSession, 1_000):
        sequences = materialize(distinct_sequences(convs, chunk))
        parts = materialize(_parts(sequences, most, batch_size))
    shared = parts.where("kind IN (1, 2)").unionByName(_twice(parts), allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "copies", "once")]
    edges = shared.groupBy("prefix").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("least").alias("least"),
                                         *sums, F.max("ends").alias("ends"))
    edges = materialize(edges)
    up = edges.select(F.col("prefix").alias("parent"), F.col("least").alias("parent_least"))
    inner = parts.where("kind = 0")
    named = inner.where("parent_least IS NOT NULL").unionByName(inner.where("parent_least IS NULL").drop("parent_least").join(up, "parent"))
    named = named.unionByName(edges.join(up, "parent", "left"), allowMissingColumns=True)
    return named.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("copies") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: crc32 is computed from its table; a node is the list of its turns.
SQL = """
WITH RECURSIVE bits AS (
  SELECT range AS i, range::BIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce("text", '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, x: xor(a // 256, crc[(xor(a, x) % 256) + 1])), 4294967295) % 9 AS h
  FROM own, tab),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.turns, [])[1:s.h], s.turns[s.h + 1:]) AS turns
  FROM sized s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 5),
steps AS (SELECT conv_id, len(turns) AS n_turns, d, turns[1:d] AS node FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n_turns = d), '')) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * any_value(strlen(node[d].t)) END AS saved
  FROM steps GROUP BY node, d),
children AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT x.*, coalesce(c.n, 0) AS n_children FROM nodes x LEFT JOIN children c ON c.node = x.node),
subtree AS (
  SELECT w.node[1:k] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM whole w, LATERAL (SELECT unnest(range(0, w.d + 1)) AS k) GROUP BY ALL)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN subtree s ON s.node = w.node LEFT JOIN whole p ON w.d > 0 AND p.node = w.node[1:w.d - 1]
"""
