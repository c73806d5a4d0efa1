"""N-gram Jaccard join: sets of word n-grams that overlap by a given percent.

A document's set are its distinct k-word shingles (``shingles``); documents
with the same set form a class, and only classes are joined. Two sets link when
100 * |intersection| >= percent * |union|. No link between unlike sets is lost:

1. Cutting down. A set that links with another shares at least ``percent`` of
   its own n-grams, so a class with too many n-grams that no other class has
   links with nothing. Counting the n-grams of one range of hash values is
   enough to drop most classes; a second range is counted among those left.
2. Prefixes. The n-grams of the classes left are ordered globally, rare first.
   Two sets that link share an n-gram in their prefixes of
   size - ceil(percent * size) + 1, so classes meet in buckets, one per n-gram
   that two prefixes hold. The smaller of the two has it in a shorter prefix
   still, and their sizes are near, so a class leaves the buckets where no other
   fits so. Buckets are then cut into parts between which no two sets link, as
   their parity bitmaps tell (``bitmaps``): sets that meet by chance, the more
   the larger the table, part before any set travels. Buckets with the same
   members count once.
3. Prefix trees. A bucket's sets are stored in a radix trie, ordered by their
   frequency in the bucket, common first. Each set walks the trie, carrying the
   overlap with the path, which all sets below share; a subtree is left when
   the overlap plus what remains of either set is below what a link needs.
   Members that are connected already are not compared again, so a bucket gives
   at most one link per member, never all pairs. A class of many buckets meets
   others in two of them first, which connects most copies that differ a
   little; buckets are then cut again, into parts between which all that may
   link is connected. What is left of more than ``BLOCK`` members meets block
   by block, which leaves out the pairs within the largest component.
4. ``components`` connects the links.

Numbers of hash ranges, blocks and rounds depend on the data's size only in
speed. Sets travel through Spark's shuffle only for classes left after step 1;
texts do not travel.

Cases: a null text counts as empty; an empty set links with nothing and is its
own component; copies of one set, however many, are one class; a null id is
ignored in a smallest id unless all are null; repeated rows give repeated
result rows; an empty table gives an empty result; other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import col, packed, small_batches, unpacked
from .components import components

#: Most members of a block of a bucket.
BLOCK = 256
#: Most members, and n-grams of all members, of a bucket that is cut into parts.
PARTED, PARTED_GRAMS = 4096, 4_000_000
#: Most n-grams of a group that has all classes which a chain of buckets reaches.
WHOLE_GRAMS = 100_000
#: Documents whose sets a task holds at a time.
ROWS = 500
#: Width of a hash range of step 1, as a multiple of 1 - percent / 100.
RANGE_FACTOR = 2.0
LEAST_RANGE = 0.02
#: Words of the filter of classes left (4 bits of a 64-bit word each).
MAX_WORDS = 1 << 19


def _sets(batches: Iterator, k: int) -> Iterator:
    """(batch, its sets, their 16-byte digests) for Arrow batches with a
    column ``text``."""
    import hashlib

    import pyarrow as pa

    from .shingles import shingle_sets

    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        texts = batch.column("text").cast(pa.binary())
        sets = list(shingle_sets((t.as_py() or b"" for t in texts), k))
        yield batch, sets, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, sig) of (id, text): size and digest of each set."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, sets, sigs in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())],
                names=["id", "n", "sig"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n bigint, sig binary")


def _key(sig: Column) -> Column:
    """A class's short name: 8 bytes of its digest."""
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("long")


def _in_range(rows: DataFrame, low: float, high: float, read) -> DataFrame:
    """(h, key): the n-grams whose hash lies in a part of all hash values."""
    least, most = int(low * 2**64), int(high * 2**64) - 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for sets, keys in read(batches):
            cut = [s[np.searchsorted(s, np.uint64(least)):np.searchsorted(s, np.uint64(most), side="right")] for s in sets]
            if cut:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cut).view(np.int64)), pa.array(np.repeat(keys, [len(c) for c in cut]))],
                    names=["h", "key"])

    return rows.mapInArrow(run, "h bigint, key bigint")


def _from_texts(k: int):
    def read(batches: Iterator) -> Iterator:
        import numpy as np

        for _, sets, sigs in _sets(batches, k):
            yield sets, np.array([int.from_bytes(s[:8], "big", signed=True) for s in sigs], dtype=np.int64)

    return read


def _from_sets(batches: Iterator) -> Iterator:
    import numpy as np

    for batch in batches:
        yield ([np.frombuffer(s.as_py(), dtype=np.uint64) for s in batch.column("grams")],
               batch.column("key").to_numpy(zero_copy_only=False))


def _left(classes: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Of (key, n, alone), where ``alone`` counts n-grams known to be in no
    other class: those that can still link, with the new count. Grams of one
    class are told by the least and greatest key, which combine early."""
    owners = grams.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    alone = owners.where("a = b").groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    found = classes.join(alone, "key", "left").withColumn("alone", F.col("alone") + F.coalesce("more", F.lit(0))).drop("more")
    return materialize(found.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")))


def _possible(keys: DataFrame):
    """A filter of the keys, as the words of a bounded bit table."""
    import numpy as np

    n_words = min(MAX_WORDS, 1 << max(4, (keys.count() // 4).bit_length()))
    word = F.pmod(F.shiftrightunsigned("key", 24), F.lit(n_words))
    mask = None
    for j in range(4):
        at = F.shiftrightunsigned("key", 6 * j).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    found = keys.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
    words = np.zeros(n_words, dtype=np.uint64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return words


def _sets_of(docs: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """(key, n, alone, grams) of the classes left: a task gives the sets that
    a filter lets pass, and one of each class stays."""
    sent = docs.sparkSession.sparkContext.broadcast(_possible(left.select("key")))  # 8 * MAX_WORDS bytes at most
    read = _from_texts(k)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for sets, keys in read(batches):
            u = keys.view(np.uint64)
            bits = np.zeros(len(u), dtype=np.uint64)
            for j in range(4):
                bits |= np.uint64(1) << ((u >> np.uint64(6 * j)) & np.uint64(63))
            may = (sent.value[(u >> np.uint64(24)) % np.uint64(len(sent.value))] & bits) == bits
            # of a batch's copies one is enough
            first = {int(keys[i]): i for i in np.flatnonzero(may)[::-1]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(first), pa.int64()), pa.array([sets[i].tobytes() for i in first.values()], pa.binary())],
                names=["key", "grams"])

    sets = docs.select("text").mapInArrow(run, "key bigint, grams binary")
    return materialize(sets.join(left, "key", "left_semi").groupBy("key").agg(F.first("grams").alias("grams")).join(left, "key"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(h, key, n, short): the n-grams in each class's prefix that another
    class has too. N-grams of one class come first in the order, so they only
    use up the prefix. ``short`` tells those that a set as large or larger can
    be met by: two sets of a and b n-grams share percent * (a + b) / (100 +
    percent) at least, so the first one they share is in the smaller's short part."""
    grams = _in_range(sets.select("key", "grams"), 0.0, 1.0, _from_sets)
    shared = materialize(grams.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    own = grams.join(shared, "h").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("g"))
    n = F.col("n")
    used = n - F.size("g")  # by n-grams of this class only
    take = lambda part: (n - F.ceil(n * part - F.lit(1e-9)) + 1 - used).cast("int")
    own = own.join(sets.select("key", "n"), "key").withColumns(
        {"take": take(percent / 100), "short": take(2 * percent / (100 + percent))}).where("take > 0")
    each = own.select("key", "n", "short", F.posexplode(F.transform(F.slice("g", F.lit(1), F.col("take")), lambda x: x["h"])).alias("at", "h"))
    return each.select("h", "key", "n", (F.col("at") < F.col("short")).alias("short"))


def _with_partner(prefixes: DataFrame, percent: int) -> DataFrame:
    """(h, key) of the prefixes where another class of the bucket may link: one
    of the two holds the n-gram in its short part and is the smaller. Sizes
    are told by steps, and sets that link lie in one step or in neighbours."""
    step = max(math.log(100 / percent), 1e-3) * (1 + 1e-9)
    kept = materialize(prefixes.select("h", "key", F.floor(F.log(F.col("n")) / step).alias("step"), "short"))
    counts = kept.groupBy("h", "step").agg(F.count(F.lit(1)).alias("all"), F.count_if("short").alias("short"))
    none = F.lit(0).cast("long")
    at = lambda d, partners, shorts: F.struct((F.col("step") + d).alias("step"), partners.alias("all"), shorts.alias("short"))
    near = counts.select("h", F.explode(F.array(
        at(0, F.col("all"), F.col("short")), at(1, F.col("short"), F.col("short")), at(-1, F.col("all"), none))).alias("c"))
    near = near.groupBy("h", F.col("c.step").alias("step")).agg(F.sum("c.all").alias("all"), F.sum("c.short").alias("shorts"))
    met = kept.join(near, ["h", "step"])
    return met.where(F.when(F.col("short"), F.col("all") > 1).otherwise(F.col("shorts") > 0)).select("h", "key")


def _buckets(prefixes: DataFrame) -> DataFrame:
    """(h, key, m, least): members of the buckets, their number and the least
    of them. Of buckets with the same members one is left."""
    kept = materialize(prefixes)
    members = kept.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("least"), F.bit_xor(F.xxhash64("key")).alias("x"),
                                    F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    once = members.where("m > 1").groupBy("m", "least", "x", "y").agg(F.min("h").alias("h"))
    return materialize(kept.join(materialize(once.select("h", "m", "least")), "h"))


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(key, n, map): the bitmap of each class's set, one or two bits an n-gram."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .bitmaps import bitmap

        for batch in batches:
            (grams, keys), = _from_sets([batch])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array([len(g) for g in grams], pa.int64()), pa.array([bitmap(g) for g in grams], pa.binary())],
                names=["key", "n", "map"])

    return sets.select("key", "grams").mapInArrow(run, "key bigint, n bigint, map binary")


def _parts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(h, key) of (h, key, root, m): the members of buckets, each part of a
    bucket a bucket of its own. Members with equal roots are connected already.
    Buckets that are too large to be cut stay whole."""
    dealt = members.where(F.col("m") <= PARTED).select("h", "key", "root").join(_bitmaps(sets), "key")
    dealt = dealt.repartition("h").sortWithinPartitions("h")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .bitmaps import parts

        def told(h, keys, roots, sizes, maps):
            whole = len(maps) < len(keys)
            part = np.zeros(len(keys), dtype=np.int64) if whole else parts(np.array(sizes), maps, np.array(roots), percent)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), h)), pa.array(part), pa.array(keys, pa.int64())], names=["h", "part", "key"])

        now, grams, held = None, 0, ([], [], [], [])
        for batch in batches:
            for h, *row, m in zip(*(batch.column(c).to_pylist() for c in ("h", "key", "root", "n", "map"))):
                if h != now:
                    if held[0]:
                        yield told(now, *held)
                    now, grams, held = h, 0, ([], [], [], [])
                for store, v in zip(held, row):
                    store.append(v)
                grams += row[2]
                if grams <= PARTED_GRAMS:
                    held[3].append(m)
                else:
                    held[3].clear()
        if held[0]:
            yield told(now, *held)

    cut = dealt.mapInArrow(run, "h bigint, part bigint, key bigint")
    return cut.select(F.xxhash64("h", "part").alias("h"), "key").unionByName(members.where(F.col("m") > PARTED).select("h", "key"))


def _blocks(m: Column) -> Column:
    return F.ceil(m / BLOCK)


def _block(n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(seed)), n)


def _split(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of buckets whose chain of buckets reaches little in all
    (with ``root``, the least class reached), and the other members."""
    reach = components(members.select(F.col("key").alias("a"), F.col("least").alias("b")))
    reach = reach.unionByName(reach.select(F.col("root").alias("node"), "root").distinct())
    reach = reach.join(sets.select(F.col("key").alias("node"), "n"), "node")
    small = reach.groupBy("root").agg((F.sum("n") <= WHOLE_GRAMS).alias("small"))
    named = materialize(members.join(reach.join(small, "root").select(F.col("node").alias("key"), "root", "small"), "key"))
    return named.where("small"), named.where("NOT small")


def _first_groups(small: DataFrame, rest: DataFrame) -> DataFrame:
    """(kind, i, j, key, right, buckets): groups that hold every class with
    candidates. All that a small chain of buckets reaches is one group of
    several buckets, so a set travels once. Any other class is in two of its
    buckets, chosen by hash so that copies that differ a little choose alike;
    of those larger than a block, in a block each, by two hashes."""
    # the buckets of a class are n-grams of its prefix, so they are few
    whole = small.groupBy("root", "key").agg(F.collect_list("h").alias("buckets")).select(
        F.lit(0).alias("kind"), F.col("root").alias("i"), F.lit(0).cast("long").alias("j"), "key", "buckets")
    deals = [rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("h", F.lit(d)).alias("x"), "h", "m")).alias("b")).select(
        F.lit(d).alias("kind"), F.col("b.h").alias("i"), _block(_blocks(F.col("b.m")), d).alias("j"), "key", _one()) for d in (1, 2)]
    return whole.unionByName(deals[0]).unionByName(deals[1]).withColumn("right", F.lit(False))


def _one() -> Column:
    return F.array(F.lit(0).cast("long")).alias("buckets")


def _with_root(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, key, root, m): members of the buckets that are not yet connected."""
    named = materialize(members.select("h", "key", "m").join(roots, F.col("key") == F.col("node"), "left").select(
        "h", "key", F.coalesce("root", "key").alias("root"), "m"))
    apart = named.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("h")
    return named.join(apart, "h")


def _rest_groups(members: DataFrame) -> DataFrame:
    """Groups for what the first ones have not connected, of (h, key, root, m):
    a bucket, or if larger than a block, members outside its largest component
    so far (right) with all members (left), block by block."""
    whole = members.where(F.col("m") <= BLOCK).select(
        F.lit(1).alias("kind"), F.col("h").alias("i"), F.lit(0).cast("long").alias("j"), "key", F.lit(False).alias("right"), _one())
    named = members.where(F.col("m") > BLOCK)
    parts = named.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("h").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"))
    main = main.select("h", F.col("main.root").alias("main"), (F.col("all") - F.col("main.n")).alias("out"))
    named = named.join(main, "h")
    lefts, rights = _blocks(F.col("m")), _blocks(F.col("out"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = named.select("h", _block(lefts, 3).alias("l"), each(rights).alias("r"), "key", F.lit(False).alias("right"))
    right = named.where("root <> main").select("h", each(lefts).alias("l"), _block(rights, 4).alias("r"), "key", F.lit(True).alias("right"))
    return whole.unionByName(left.unionByName(right).select(
        F.lit(3).alias("kind"), F.col("h").alias("i"), (F.col("l") * (1 << 31) + F.col("r")).alias("j"), "key", "right", _one()))


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the same classes as all links do."""
    members = _buckets(_with_partner(_prefixes(sets, percent), percent))
    members = _buckets(_parts(members.withColumn("root", F.col("key")), sets, percent))
    small, rest = _split(members, sets)
    found = materialize(_compared(_first_groups(small, rest), sets, percent))
    if rest.isEmpty():
        return found
    roots = components(found)
    more = _buckets(_parts(_with_root(rest, roots), sets, percent))
    more = materialize(_with_root(more, roots))
    return found if more.isEmpty() else found.unionByName(materialize(_compared(_rest_groups(more), sets, percent)))


def _compared(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the classes of each group."""
    dealt = groups.join(sets.select("key", "grams"), "key").repartition("kind", "i", "j").sortWithinPartitions("kind", "i", "j")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .trie import linked, linked_buckets

        def told(keys, rights, buckets, grams):
            sets = [np.frombuffer(g, dtype=np.uint64) for g in grams]
            alike = all(b == buckets[0] for b in buckets)
            pairs = linked(sets, rights, percent) if alike else linked_buckets(sets, buckets, percent)
            return pa.RecordBatch.from_arrays([pa.array([keys[p[i]] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        now, held = None, ([], [], [], [])
        for batch in batches:
            group = zip(*(batch.column(c).to_pylist() for c in ("kind", "i", "j")))
            columns = (batch.column(c).to_pylist() for c in ("key", "right", "buckets"))
            for g, key, right, buckets, s in zip(group, *columns, batch.column("grams")):
                if g != now:
                    if len(held[0]) > 1:
                        yield told(*held)
                    now, held = g, ([], [], [], [])
                for store, v in zip(held, (key, right, buckets, s.as_py())):
                    store.append(v)
        if len(held[0]) > 1:
            yield told(*held)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _linked_classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, sig) per row of (id, text), and (sig key, root key) of the
    classes that link. All its jobs run here."""
    with small_batches(docs.sparkSession):
        return _found(docs, k, percent)


def _found(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    info = materialize(_classes(docs, k))
    classes = info.where("n > 0").groupBy(_key(F.col("sig")).alias("key")).agg(F.first("n").alias("n"), F.lit(0).cast("long").alias("alone"))
    width = min(1.0, max(LEAST_RANGE, RANGE_FACTOR * (1 - percent / 100)))
    texts = docs.select("text")
    left = _left(classes, _in_range(texts, 0.0, width, _from_texts(k)), percent)
    sets = _sets_of(docs, left, k)
    if width < 1:
        more = _in_range(sets.select("key", "grams"), width, min(1.0, 2 * width), _from_sets)
        again = _left(sets.select("key", "n", "alone"), more, percent)
        sets = materialize(sets.drop("alone").join(again.select("key", "alone"), "key"))
    return info, components(links(sets, percent))


def join_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by
    links, the own one included)."""
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).alias("text"))
    info, roots = _linked_classes(rows, k, percent)
    found = _with_group(info, roots)
    least = materialize(found.where("n > 0").groupBy("group").agg(F.min("id").alias("least")))
    out = found.join(least, "group", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def _with_group(info: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds ``group``: the key of the smallest class reachable."""
    keyed = info.withColumn("node", _key(F.col("sig")))
    return keyed.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root", "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group: that of the smallest id (then
    the smallest text hash). Documents with an empty set all stay."""
    row = F.struct(col(docs, id_col).alias("i"), F.xxhash64(col(docs, text_col)).alias("t"))
    rows = docs.select(row.alias("id"), col(docs, text_col).alias("text"))
    info, roots = _linked_classes(rows, k, percent)
    found = _with_group(info, roots).where("n > 0")
    best = found.groupBy("group").agg(F.min("id").alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1")
    best = materialize(best)
    goes = materialize(found.join(best, "group").select("id", (F.col("id") != F.col("best")).alias("goes")).distinct())
    wide = docs.select(packed(docs), row.alias("id"))
    judged = wide.join(goes, "id", "left")  # structs with null fields are equal where their fields are
    alone = judged.where(F.col("goes").isNull()).select("row_")
    # repeated rows of the one that stays are alike: one of them stays
    chosen = judged.where(~F.col("goes")).groupBy("id").agg(F.first("row_").alias("row_")).select("row_")
    return unpacked(alone.unionByName(chosen))
