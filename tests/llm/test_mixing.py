"""Mixing: targets by plain resharing, copies by plain prefix sums."""

import hashlib
import math
import re

import pytest

from tiltkit.llm import mixing as M

from .conftest import SF01, frame, odd_rows


def plain_targets(sizes):
    """Share by weight; cut what is above 3 times a source; reshare the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not above:
            return share | fixed
        fixed |= {s: 3 * sizes[s] for s in above}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs):
    """Against targets and copies computed without Spark."""
    rows = docs.select("doc_id", "text", "source").collect()
    got = M.mix_sizes(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want = plain_targets(sizes)
    taken = {}
    for s in sizes:
        key = "1" if s is None else "0" + s
        u = int(hashlib.md5(f"{M.SEED}:{key}".encode()).hexdigest()[:8], 16) / 2**32
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        own = sorted(((words(r.text), r.doc_id is not None, r.doc_id or 0) for r in rows if r.source == s))
        for k, (n, known, i) in enumerate(own, 1):
            copies = min(3, math.floor(k * rate + u) - math.floor((k - 1) * rate + u))
            taken.setdefault((i if known else None, n), []).append(copies * n)
    for r in got:
        assert r.taken <= 3 * r.size
        assert any(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == sizes[s] for s in sizes)
    by_row = {}
    for r in got:
        by_row.setdefault((r.doc_id, r.size), []).append(r.taken)
    assert {k: sorted(v) for k, v in by_row.items()} == {k: sorted(v) for k, v in taken.items()}
    return rows, got, sizes, want


def test_whole_table(spark):
    rows, got, sizes, want = check(spark.read.parquet(f"{SF01}/documents.parquet"))
    source = {r.doc_id: r.source for r in rows}
    longest, took = {}, {}
    for r in got:
        s = source[r.doc_id]
        longest[s] = max(longest.get(s, 0), r.size)
        took[s] = took.get(s, 0) + r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= 1.5 * longest[s]


def test_capped_sources_and_ties(spark):
    rows = [(i, "a b c", "x", "big") for i in range(3000)] + [(5000 + i, "a b", "x", f"s{i}") for i in range(7)]
    check(frame(spark, rows))


def test_odd_rows(odd, empty):
    check(odd)
    assert M.mix_sizes(empty).count() == 0
    assert M.mix(empty).count() == 0


def test_mix_emits_the_copies(spark, odd):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    copies = {r.doc_id: (r.taken // r.size if r.size else None) for r in M.mix_sizes(docs).collect()}
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    found = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(M.F.count("*").alias("n")).collect()}
    assert all(found.get(i, 0) == n for i, n in copies.items() if n is not None)
    assert M.mix(odd).columns == odd.columns


def test_blocks_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    want = sorted(map(tuple, M.mix_sizes(docs).collect()))
    monkeypatch.setattr(M, "BLOCK_BITS", 3)
    assert sorted(map(tuple, M.mix_sizes(docs).collect())) == want


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        M.mix_sizes(frame(spark, [(i, "a", "x", f"s{i}") for i in range(3)]))
