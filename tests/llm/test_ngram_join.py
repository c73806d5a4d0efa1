"""N-gram Jaccard join against all pairs by brute force."""

import random
import re

import numpy as np
import pytest

from tiltkit.llm import ngram_join as N
from tiltkit.llm.bitmaps import bitmap, parts
from tiltkit.llm.shingles import shingle_sets
from tiltkit.llm.trie import linked

from .conftest import SF001, frame, odd_rows

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def gram_set(text, k):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """[(id, set size, smallest id of the component)], sorted by row."""
    sets = [gram_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return " ".join(out)


def near_copies(seed):
    """Groups of copies with few edits, a passage that all hold, and chains."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(12):
        words = [f"g{g}w{r.randrange(400)}" for _ in range(r.randrange(3, 300))]
        if g % 2:
            words += passage
        now = words
        for _ in range(r.randrange(1, 9)):
            rows.append(edited(r, now, r.randrange(4)))
            if g % 3 == 0:
                now = rows[-1].split()
    rows += ["", None, "one", "ONE", "one two", "one two three", "one two three four"]
    return list(enumerate(rows, 100))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 100)])
def test_components_match_brute_force(spark, k, percent):
    rows = near_copies(k)
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted(tuple(r) for r in N.join_groups(docs, k=k, percent=percent).collect())
    assert got == sorted(brute(rows, k, percent))


def test_hot_bucket_in_blocks(spark, monkeypatch):
    """One group of unlike near copies over many blocks: no link is lost."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "WHOLE_GRAMS", 1000)
    r = random.Random(1)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, edited(r, words, r.randrange(5))) for i in range(90)]
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted(tuple(x) for x in N.join_groups(docs, k=3, percent=80).collect())
    assert got == sorted(brute(rows, 3, 80))


def test_sets_travel_only_with_a_possible_partner(spark, monkeypatch):
    """Classes that share n-grams by chance, but with none of a near size, are not sent to be compared."""
    r = random.Random(3)
    sent = []
    compared = N._compared
    monkeypatch.setattr(N, "_compared", lambda groups, *a: (sent.append(sorted({x.key for x in groups.select("key").collect()})), compared(groups, *a))[1])
    rows, n = [], 40
    for g in range(8):  # a passage of each set is in the next one, which is a third longer
        words = [f"g{g}w{i}" for i in range(n)]
        rows += [" ".join([f"t{g} t{g} t{g}", *words, f"t{g + 1} t{g + 1} t{g + 1}"]), " ".join([*words, f"t{g + 1} t{g + 1} t{g + 1} x{g}"])][:2 if g == 3 else 1]
        n = n * 4 // 3
    rows.append(rows[-1] + " end")
    rows = list(enumerate(rows))
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted(tuple(x) for x in N.join_groups(docs, k=3, percent=90).collect())
    assert got == sorted(brute(rows, 3, 90))
    assert 2 <= len(sent[0]) <= 4


@pytest.mark.parametrize("limits", [{}, {"PARTED": 20}, {"PARTED_GRAMS": 3000}])
def test_sets_of_a_large_group_travel_few_times(spark, monkeypatch, limits):
    """Near copies that meet in many buckets, and as many unlike texts that share a word or two with each other:
    no link is lost, and the sets sent to be compared do not grow with the buckets."""
    for name, value in {"BLOCK": 30, "WHOLE_GRAMS": 1000, **limits}.items():
        monkeypatch.setattr(N, name, value)
    sent = []
    compared = N._compared
    monkeypatch.setattr(N, "_compared", lambda groups, *a: (sent.append(groups.count()), compared(groups, *a))[1])
    r = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [edited(r, words, r.randrange(4)) for _ in range(60)]
    # every run of 8 words is in two texts, so each meets others by chance
    runs = [" ".join(f"c{j}x{i}" for i in range(8)) for j in range(600)] * 2
    r.shuffle(runs)
    rows = list(enumerate(rows + [" ".join(runs[i:i + 20]) for i in range(0, 1200, 20)]))
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted(tuple(x) for x in N.join_groups(docs, k=3, percent=80).collect())
    assert got == sorted(brute(rows, 3, 80))
    if not limits:
        assert sum(sent) <= 4 * 60


@pytest.mark.parametrize("percent", [30, 50, 80, 100])
def test_parts_hold_all_links(percent):
    """Sets that link are in one part unless connected already, also with bitmaps of unlike sizes; unlike sets part."""
    r = np.random.default_rng(percent)
    base = [r.integers(0, 2**64, 700, dtype=np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([b[:r.integers(30, 700)], r.integers(0, 2**64, r.integers(0, 60), dtype=np.uint64)])) for b in base for _ in range(25)]
    sizes, maps = np.array([len(x) for x in sets]), [bitmap(x) for x in sets]
    assert len({len(m) for m in maps}) > 1
    over = lambda a, b: 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
    for roots in (np.arange(75), np.arange(75) % 4, np.zeros(75, dtype=np.int64)):
        part = parts(sizes, maps, roots, percent)
        assert all(part[a] == part[b] for a in range(75) for b in range(a) if roots[a] != roots[b] and over(sets[a], sets[b]))
        assert len(set(part)) == 75 or roots.any()
    unlike = [r.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(20)]
    if percent >= 80:
        assert len(set(parts(np.full(20, 500), [bitmap(np.unique(x)) for x in unlike], np.arange(20), percent))) == 20


@pytest.mark.parametrize("percent", [40, 95])
def test_small_sets_that_share_much_match_brute_force(spark, percent):
    """Sets of every size over few n-grams, so links lie at every place of a prefix and at every ratio of sizes."""
    r = random.Random(percent)
    words = [f"w{i}" for i in range(30)]
    rows = list(enumerate(" ".join(words[:r.randrange(1, 31)] if r.random() < 0.5 else r.sample(words, r.randrange(1, 31))) for _ in range(120)))
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    got = sorted(tuple(x) for x in N.join_groups(docs, k=1, percent=percent).collect())
    assert got == sorted(brute(rows, 1, percent))


def test_odd_rows(odd, empty):
    got = N.join_groups(odd, k=3, percent=90).collect()
    want = brute([(i, t) for i, t, *_ in odd_rows()], 3, 90)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert N.join_groups(empty).count() == 0
    assert N.keep_one(empty).count() == 0


def test_keep_one_of_each_group(spark, odd):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {c for _, n, c in brute(rows, 5, 80)}
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want)
    # repeated rows of one id leave one row; empty texts all stay
    left = N.keep_one(odd)
    assert left.columns == odd.columns
    assert left.where("doc_id = 8").count() == 0 and left.where("doc_id = 6").count() == 1
    assert left.where("doc_id IN (1, 2, 3)").count() == 3


def test_shingles_count_like_tuples():
    texts = [(t or "") for _, t, *_ in odd_rows()]
    for k in (1, 3, 5):
        sets = list(shingle_sets((t.encode() for t in texts), k))
        assert [len(s) for s in sets] == [len(gram_set(t, k)) for t in texts]


def test_trie_finds_all_links():
    r = random.Random(2)
    for percent in (30, 50, 80, 100):
        sets = [np.unique(np.array([r.randrange(25) for _ in range(r.randrange(1, 30))], dtype=np.uint64)) for _ in range(25)]
        rights = [bool(r.randrange(2)) for _ in sets] if percent != 50 else [False] * 25
        pairs = linked(sets, rights, percent)
        over = lambda a, b: 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
        cross = any(rights)
        def classes(edges):
            p = list(range(25))
            for a, b in edges:
                x, y = p[a], p[b]
                p = [x if v == y else v for v in p]
            return [p.index(v) for v in p]
        want = [(a, b) for a in range(25) for b in range(a) if over(sets[a], sets[b]) and (not cross or rights[a] != rights[b])]
        assert classes(pairs) == classes(want)
        assert all(over(sets[a], sets[b]) for a, b in pairs)


def test_words_that_a_power_sum_confuses(spark):
    """A Thue-Morse word and its complement agree in every polynomial hash
    modulo 2^64; here they must not."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    short, both = word[:64], other[:64]
    a, b, c, d = (s[0] for s in shingle_sets(iter(t.encode() for t in (word, other, short, both)), 3))
    assert len({int(a), int(b), int(c), int(d)}) == 4
    got = {r.doc_id: r.component_id for r in N.join_groups(frame(spark, [(1, word, "", ""), (2, other, "", ""), (3, word, "", "")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_lanes_of_words_of_every_length():
    words = ["x" * n for n in range(1, 200)] + ["x" * n + "y" for n in range(200)] + ["y" + "x" * n for n in range(1, 200)]
    hashes = [int(s[0]) for s in shingle_sets(iter(w.encode() for w in words), 3)]
    assert len(set(hashes)) == len(set(words))
    joined = next(shingle_sets(iter([" ".join(words).encode()]), 1))
    alone = {int(s[0]) for s in shingle_sets(iter(w.encode() for w in words), 1)}
    assert alone == {int(h) for h in joined}
