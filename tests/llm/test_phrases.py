"""Collocations against plain counting, and the HAT-trie alone."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tiltkit.llm import phrases as P
from tiltkit.llm import queries
from tiltkit.llm.hat_trie import HatTrie, packed_rest, word_at

from .conftest import SF001, frame, odd_rows


def brute(rows, least, top=P.TOP):
    """Sorted result rows of (text, lang)."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = (text or "").encode().lower()
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", folded):
            w = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i:i + n])] += 1
    cand = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        covered = any(x[0] == lang and len(x[1]) > len(p) and 100 * b >= 80 * a and any(x[1][i:i + len(p)] == p for i in range(len(x[1])))
                      for x, b in cand.items())
        if not covered:
            out.setdefault(lang, []).append((-score, -a, b" ".join(p), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
                  for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def told(df):
    return sorted(tuple(r) for r in df.collect())


def sample(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["New", "YORK", "été", "\x01", "\x85x"]
    def text():
        out = []
        for _ in range(r.randrange(60)):
            out.append(r.choice(words) if r.random() < 0.7 else "new york city hall")
            out.append(r.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\x0b", " ? ", ""]))
        return "".join(out)
    return [(i, text() if i % 11 else None, r.choice(["en", "en", "fr", None]), "s") for i in range(n)]


@pytest.mark.parametrize("seed,least,top", [(1, 3, 2000), (2, 8, 2000), (3, 2, 7)])
def test_equals_brute_force(spark, seed, least, top):
    rows = sample(seed)
    got = told(P.collocations(frame(spark, rows), least=least, top=top))
    assert got == brute([(t, lang) for _, t, lang, _ in rows], least, top) and len(got) > 5


@pytest.mark.parametrize("max_words,share", [(16, 1000), (1 << 20, 3), (16, 10**6)])
def test_full_filters_and_many_splits_change_nothing(spark, max_words, share):
    rows = sample(5)
    docs = frame(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "text")
    counts, totals = P.phrase_counts(docs, 3, max_words, share)
    want, _ = P.phrase_counts(docs, 3)
    assert told(counts) == told(want)


def counted(text, **limits):
    """Phrases of one text counted by a task, without filters of words."""
    out, was = Counter(), {k: getattr(P, k) for k in limits}
    defaults = P.segments.__defaults__
    try:
        for k, v in limits.items():
            setattr(P, k, v)
        P.segments.__defaults__ = (limits.get("SEGMENT", P.SEGMENT),)
        full = np.full(16, 2**64 - 1, dtype=np.uint64)
        rows = lambda c: (*c.read("en", text), *c.read("de", b"a b c d"), *c.read("en", b"a b"), *c.rest())
        for c in (P._Counter((1,)), P._Counter((2, 3, 4), full, full, {("en", b"a"): 5})):
            for batch in rows(c):
                phrases = batch.column("phrase").to_pylist()
                assert None in phrases or phrases == sorted(phrases, key=str.encode)  # each run is sorted
                for lang, phrase, n in zip(batch.column("lang").to_pylist(), phrases, batch.column("n").to_pylist()):
                    out[lang, phrase] += n
        for batch in rows(P._Counter((), full, parts=7)):
            for part, h, n in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "counts"))):
                h, n = np.frombuffer(h, dtype=np.uint64), np.frombuffer(n, dtype=np.int64)
                assert all(int(x) * 7 >> 64 == part for x in h.tolist()) and len(h) == len(n)
                for x, k in zip(h.tolist(), n.tolist()):
                    out["pair", x] += k
    finally:
        for k, v in was.items():
            setattr(P, k, v)
        P.segments.__defaults__ = defaults
    return out


def test_segments_blocks_spills_and_new_vocabularies_change_nothing():
    r = random.Random(4)
    text = "".join(r.choice(["a", "bb", "c", "dd", "e1", "E2", "f" * 40]) + r.choice([" ", " ", " ", " ", "\t", ". ", "\n", "     "]) for _ in range(4000)).encode()
    for t in (text, text.replace(b".", b"").replace(b"\n", b" "), b" " * 500 + b"x y z" + b" " * 300 + b"w. q"):
        want = counted(t)
        pairs = [k for k in want if isinstance(k[1], str) and k[1].count(" ") == 1]
        assert sum(want[k] for k in pairs) == sum(n for k, n in want.items() if k[0] == "pair")
        for segment, block, most, vocabulary in ((30, 10, 5, 3), (7, 1, 10**6, 10**6), (10**6, 50, 20, 10**6), (1, 13, 300, 2)):
            assert counted(t, SEGMENT=segment, BLOCK_WORDS=block, MOST_PHRASES=most, MOST_WORDS=vocabulary, MOST_HASHES=most) == want


def test_trie_counts_and_spills_sorted_subtrees():
    r = random.Random(8)
    ids = np.array([min(int(r.expovariate(0.3)), 30) for _ in range(20_000)])
    want, got = Counter(), Counter()
    trie = HatTrie(burst=20)

    def keep(spilled):
        for first, rests, counts in spilled:
            after = np.stack([word_at(np.array(rests), p) for p in (1, 2, 3)], axis=1)
            for rest, n in zip(after.tolist(), counts):
                got[(first, *(i for i in rest if i >= 0))] += n

    for width in (2, 3, 4):
        for a in range(0, len(ids) - width, 997):
            starts = np.arange(a, min(a + 997, len(ids) - width + 1))
            for s, rest in zip(starts.tolist(), packed_rest(ids, starts, width).tolist()):
                trie.add(int(ids[s]), [rest], [1])
                want[tuple(ids[s:s + width].tolist())] += 1
            if trie.size > 500:
                keep(trie.spill(250))
                assert trie.size <= 250 and trie.size == sum(trie.sizes.values())
    keep(trie.spill())
    assert got == want and trie.size == 0


def test_odd_rows(odd):
    rows = [(t, lang) for _, t, lang, *_ in odd_rows()]
    assert told(P.collocations(odd, least=2)) == brute(rows, 2)


def test_empty_tables(spark, empty):
    assert P.collocations(empty).count() == 0
    assert P.collocations(frame(spark, [(1, "", "en", "a"), (2, None, None, "a")])).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text", "lang").collect()
    assert told(queries.op11_collocations(spark, SF001)) == brute([tuple(d) for d in docs], 30)


def test_large_counts_are_exact(spark):
    """Products that pass 64 bits."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**13 + 1, 10**13 + 1, 3 * 10**13)], "a bigint, l bigint, r bigint")
    got = df.select(F.expr("CAST(a AS DECIMAL(30,0)) * 2000000BD div (CAST(l AS DECIMAL(30,0)) + CAST(r AS DECIMAL(30,0)))").alias("s")).first().s
    assert got == 2_000_000 * (10**13 + 1) // (4 * 10**13 + 1)
