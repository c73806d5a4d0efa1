"""SimHash groups against all pairs by brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tiltkit.llm import queries
from tiltkit.llm import simhash as S

from .conftest import SF001, frame, odd_rows

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    w = WORD.findall((text or "").encode().lower())
    grams = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else ([w] if w else [])
    h = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_groups(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 2):
            parent[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups([d for d, _ in rows], fps)
    return sorted(((d, f"{f:016x}", g) for (d, _), f, g in zip(rows, fps, groups)), key=repr)


def test_odd_rows(odd):
    got = sorted((tuple(r) for r in S.near_groups(odd).collect()), key=repr)
    assert got == expected([(d, t) for d, t, *_ in odd_rows()])


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    text = "one two three"
    got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64
    assert f"{got:064b}" == f"{S.fingerprint(text.encode()):064b}"


def test_blocks_of_a_long_text_change_nothing():
    r = random.Random(3)
    text = " ".join(str(r.randrange(500)) for _ in range(3000)).encode()
    was = S.fingerprint(text)
    for size in (1, 7, 1000):
        joined = [w for b in S.word_blocks(text, size) for w in b]
        assert joined == text.split()
    S_size = S.word_blocks.__defaults__
    try:
        S.word_blocks.__defaults__ = (50,)
        assert S.fingerprint(text) == was
        assert S.fingerprint(b"  a \n b  ") == brute_fingerprint("a b")
    finally:
        S.word_blocks.__defaults__ = S_size


@pytest.mark.parametrize("most", [0, 1, 3, 32])
def test_links_of_dense_and_sparse_fingerprints(spark, most):
    """Random walks of 1 to 3 bits around few centres; buckets of all sizes."""
    r = random.Random(most)
    fps = {0, 1, 1 << 63, (1 << 64) - 1}
    for _ in range(6):
        at = r.getrandbits(64)
        for _ in range(60):
            now = at
            for _ in range(r.randrange(4)):
                now ^= 1 << (r.randrange(64) if r.random() < 0.6 else r.randrange(32, 40))
            fps.add(now)
            at = now if r.random() < 0.3 else at
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    entries = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    from tiltkit.llm.components import components

    pairs = S.links(entries, most)
    assert all(bin((p.a ^ p.b) % 2**64).count("1") <= 2 for p in pairs.collect())
    roots = {r.node: r.root for r in components(pairs).collect()}
    want = brute_groups(list(range(len(fps))), fps)
    got = [roots.get(f, f) for f in signed]
    first = {}
    for i, g in enumerate(got):
        first.setdefault(g, i)
    assert [first[g] for g in got] == want


def test_empty_table(empty):
    assert S.near_groups(empty).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in queries.op13_simhash(spark, SF001).collect()), key=repr)
    assert got == expected([tuple(d) for d in docs])


def test_hot_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(300)}" for _ in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        words[r.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(words), "en", "a"))
    got = sorted((tuple(x) for x in S.near_groups(frame(spark, rows), most=8).collect()), key=repr)
    assert got == expected([(d, t) for d, t, *_ in rows])
