"""Quality rules against plain Python."""

import math
import re
from collections import Counter

import pytest

from tiltkit.llm import quality as Q

from .conftest import SF001, SF01, frame, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def classes(text):
    t = text or ""
    import unicodedata

    n = Counter()
    for c in t:
        kind = unicodedata.category(c)
        n["u" if kind == "Lu" else "d" if kind == "Nd" else "p" if c in ".,;:!?'\"()-" else "s" if c in "#*$%&|<>" else
          "l" if c == "\n" else "w" if c in " \t\x0b\x0c\r" else "o"] += 1
    return [float(n[k]) for k in "udpslwo"]


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in a if x > 0)
    return math.sqrt(max(0.0, (kl(zip(p, q)) + kl(zip(q, p))) / 2))


def judged(rows):
    """{position: (class distance, word distance)} by plain counting."""
    sums, counts, total = {}, {}, Counter()
    for _, t, lang, _ in rows:
        w = WORD.findall(t or "")
        total[lang] += len(w)
        counts.setdefault(lang, Counter()).update(w)
        sums[lang] = [a + b for a, b in zip(sums.get(lang, [0.0] * 7), classes(t))]
    pooled = [sum(s[i] for lang, s in sums.items() if total[lang]) for i in range(7)]
    out = []
    for _, t, lang, _ in rows:
        w = WORD.findall(t or "")
        top = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0].encode()))[:Q.COMMON]
        if not w:
            out.append(None)
            continue
        if total[lang] < Q.MIN_REFERENCE:  # judged by the characters of all
            out.append((distance(classes(t), pooled), None))
            continue
        own = Counter(w)
        mine = [own[x] for x, _ in top]
        ref = [n for _, n in top]
        out.append((distance(classes(t), sums[lang]), distance([*mine, len(w) - sum(mine)], [*ref, total[lang] - sum(ref)])))
    return out


def check(docs, rows):
    got = {}
    for r in Q.judge(docs).collect():
        got.setdefault((r.doc_id, r.text, r.lang), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for (i, t, lang, _), far in zip(rows, judged(rows)):
        r = got[i, t, lang][0]
        want = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, i
        bad = False
        if far:
            assert r.class_distance == pytest.approx(far[0], abs=1e-9)
            assert r.word_distance is None if far[1] is None else r.word_distance == pytest.approx(far[1], abs=1e-9)
            bad = far[0] > Q.MAX_CLASS_DISTANCE or (far[1] or 0) > Q.MAX_WORD_DISTANCE + Q.SHORT_SLACK / math.sqrt(want[0])
        assert r.kept == (not want[5] and not bad)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    check(docs, [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])


def test_odd_rows(odd, empty, monkeypatch):
    check(odd, odd_rows())
    monkeypatch.setattr(Q, "MIN_REFERENCE", 10)
    monkeypatch.setattr(Q, "MAX_BROADCAST_LANGUAGES", 0)
    check(odd, odd_rows())
    assert Q.judge(empty).count() == 0
    assert Q.keep_good(empty).columns == empty.columns


def test_repeated_windows_of_every_kind(spark):
    texts = ["a b c a b c", "a a a a", "a b c", "a b", "a b c d a b c d e", "x " * 5000, " ".join(map(str, range(9000))) + " 0 1 2"]
    check(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), [(i, t, "en", "a") for i, t in enumerate(texts)])


def test_pair_sort_counts_alike(spark):
    """The exact path of texts whose short hashes clash."""
    from pyspark.sql import functions as F

    from tiltkit.llm.common import let, words

    df = frame(spark, odd_rows())
    both = df.select("text", let(words(F.col("text")), lambda w: Q.repeated_words(w)).alias("a"),
                     let(words(F.col("text")), lambda w: Q.repeated_words(w, exact=True)).alias("b")).collect()
    assert all(r.a == r.b for r in both) and any(r.a for r in both)


def test_good_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = Q.judge(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert all(r.kept for r in good)
    assert sum(r.kept for r in rows if r.quality == 0) <= 0.02 * sum(r.quality == 0 for r in rows)
    kept = {r.doc_id for r in Q.keep_good(docs).collect()}
    assert {r.doc_id for r in rows if r.kept} <= kept


def test_small_languages_are_judged(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")  # de, es and fr have 7,000 to 11,000 words
    kept = {r.doc_id: r.kept for r in Q.judge(docs).collect()}
    assert not any(kept[i] for i in (14, 17, 47, 48, 83, 148, 179))
    good = {r.doc_id for r in spark.read.parquet(f"{SF001}/labels.parquet").where("quality = 1").collect()}
    assert all(r.kept or r.base_failed for r in Q.judge(docs).collect() if r.doc_id in good)


def test_languages_of_few_words_are_judged_by_all(spark):
    prose = lambda n: " ".join(f"wort{'abcdefgh'[i % 8]}{'klmnopqr'[i * 5 % 7]}{'stuvw'[i * 3 % 5]}" for i in range(n))
    rows = [(1, prose(3000), "en", "a"), (2, prose(200), "xx", "a"), (3, " ".join(f"#{i}$%|" for i in range(200)), "yy", "a")]
    got = {r.doc_id: r for r in Q.judge(frame(spark, rows)).collect()}
    assert got[2].class_distance < 0.3 and got[2].word_distance is None
    assert not got[3].base_failed and got[3].class_distance > 0.3 and not got[3].kept
