"""Toxicity: the composed grammar, and held-out accuracy."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tiltkit.llm import toxicity as T

from .conftest import odd_rows

SF1 = "/root/testdata/sf0.1"


def walk(machine, symbols):
    """(symbol out, multiplier) for each symbol."""
    state, out = 0, []
    for s in symbols:
        state, o, w = T.step(machine, state, s)
        out.append((o, w))
    return out


def test_composition_is_one_after_the_other():
    a, b, c = T.window_after("negation", 2, 0.5), T.rest_after("report", 0.25), T.window_after("target", 3, 2.0)
    whole = T.compose(T.compose(a, b), c)
    for symbols in itertools.product(T.SYMBOLS, repeat=5):
        by_steps = [(s, 1.0) for s in symbols]
        for m in (a, b, c):
            by_steps = [(o, w * w0) for (o, w), (_, w0) in zip(walk(m, [s for s, _ in by_steps]), by_steps)]
        assert walk(whole, symbols) == by_steps


@pytest.fixture(scope="module")
def scorer():
    return T.Scorer([("idiot$", 4.0), ("blöd", 3.0)])


@pytest.mark.parametrize(("clause", "want"), [
    ("that idiot there", 4.0), ("you idiot", 4.0 * T.TARGETED), ("not an idiot", 4.0 * T.NEGATED), ("not a b idiot", 4.0),
    ("he said idiot", 4.0 * T.REPORTED * T.TARGETED), ("they said a b c d idiot", 4.0 * T.REPORTED), ("idiots", 0.0), ("blödes", 3.0),
    ("verblödet", 0.0), ("kill it", T.THREAT_WEIGHT), ("kill you", T.THREAT_WEIGHT * T.TARGETED), ("idiot, you are", 4.0 * T.TARGETED),
    ("you idiot you", 4.0 * T.TARGETED), ("idiot a b c you", 4.0), ("not an idiot you", 4.0 * T.NEGATED * T.TARGETED), ("i'll shoot you", T.THREAT_WEIGHT * T.TARGETED),
    ("killing a", T.THREAT_WEIGHT), ("er tötet", T.THREAT_WEIGHT * T.TARGETED), ("je te tuerai", T.THREAT_WEIGHT * T.TARGETED), ("voy a matarte", T.THREAT_WEIGHT), ("", 0.0), ("\"idiot", 4.0 * T.REPORTED)])
def test_clauses(scorer, clause, want):
    assert scorer.clause(clause) == pytest.approx(want)
    assert scorer.sums(clause)[0] == pytest.approx(want)


@pytest.mark.parametrize(("clause", "want"), [
    ("d'idiot", 4.0), ("l’idiot", 4.0), ("'idiot'", 4.0), ("‘idiot’", 4.0), ("'d'idiot'", 4.0), ("the idiot's", 4.0), ("qu'il idiot", 4.0 * T.TARGETED),
    ("lorsqu'il a b idiot", 4.0 * T.TARGETED), ("isn't idiot", 4.0 * T.NEGATED), ("isn’t an idiot", 4.0 * T.NEGATED), ("'not' an idiot", 4.0 * T.NEGATED),
    ("you're an idiot", 4.0 * T.TARGETED), ("'kill'", T.THREAT_WEIGHT), ("d'idiots", 0.0), ("ce n'est pas l'idiot", 4.0 * T.NEGATED)])
def test_words_at_apostrophes(scorer, clause, want):
    assert scorer.clause(clause) == pytest.approx(want)
    assert scorer.sums(clause)[0] == pytest.approx(want)


def test_learning_and_scoring_split_alike(spark):
    near = [a + b for a in "bcfgk" for b in "aeiouyäö"]  # contexts count once
    texts = [(f"{w} d'imbécile {w} isn’t {w}" if i % 2 else f"{w} calm {w} fine {w}", i % 2) for i, w in enumerate(near)]
    lex = dict(T.lexicon(spark.createDataFrame(texts, "text string, toxic int")))
    starts = {w.rstrip("$") for w in lex}
    assert any("imbécile".startswith(w) for w in starts) and not {*lex} & {"d$", "isn$", "t$"}
    assert T.Scorer(list(lex.items())).sums("il est d'imbécile")[0] > 0


def plain_sums(scorer, text):
    """Clause scores without machines: every clause, word and its neighbours."""
    import math
    import re

    scores = []
    for clause in re.split(r"[.!?;\n]", T.plain(text)):
        words = scorer.words.findall(clause)
        weights = [scorer.weight(w) for w in words]
        kind = lambda i: (None if weights[i] else scorer.kinds.get(words[i]) or ("report" if len(words[i]) == 1 and not words[i].isalpha() else None))
        total = 0.0
        for i, w in enumerate(weights):
            if w:
                near = lambda k, a, b: any(kind(j) == k for j in range(max(a, 0), min(b, len(words))))
                w *= T.NEGATED if near("negation", i - T.NEGATION_REACH, i) else 1.0
                w *= T.REPORTED if near("report", 0, i) else 1.0
                total += w * (T.TARGETED if near("target", i - T.TARGET_REACH, i) or near("target", i + 1, i + 1 + T.TARGET_REACH) else 1.0)
        scores.append(total)
    return math.fsum(scores), max(scores), math.fsum(scores) / math.sqrt(1 + len(T.plain(text)) / 6)


def test_whole_table_by_brute_force(spark):
    """Every document's score, with the learned words and fitted curve, from a
    scorer that has no machine and no scan."""
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = T.training_rows(docs, labels, "doc_id", "text")
    lex = T.lexicon(train)
    s = T.Scorer(lex)
    b = T.fit([(*plain_sums(s, r.text or ""), r.toxic) for r in train.collect()])
    got = {r.doc_id: r for r in T.score(docs, labels).collect()}
    assert lex and len(got) == docs.count()
    for i, text in docs.select("doc_id", "text").collect():
        x = plain_sums(s, text or "")
        assert s.sums(text or "") == pytest.approx(x, rel=1e-9)
        want = 1 / (1 + math.exp(-(b[3] + sum(w * math.log1p(v) for w, v in zip(b, x)))))
        assert got[i].score == pytest.approx(want, abs=1e-6)


def test_long_texts_take_time_by_their_length(scorer):
    import time

    def seconds(n):
        text = "a calm word " * 20 + ", ".join(["you idiot and so on"] * n)
        text = ". ".join([text] + ["an idiot here"] * n)
        t = time.process_time()
        scorer.sums(text)
        return time.process_time() - t

    seconds(500)
    assert min(seconds(32_000) for _ in range(2)) < 24 * max(min(seconds(4_000) for _ in range(3)), 1e-4)


def test_clauses_add_up(scorer):
    total, top, _ = scorer.sums("Not. Idiot! you blöde; nothing\nidiot IDIOT")
    assert total == pytest.approx(4 + 3 * T.TARGETED + 8) and top == pytest.approx(8)
    assert scorer.sums("") == (0.0, 0.0, 0.0)
    assert scorer.sums("x" * 200_000 + " idiot")[0] == 4


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic == 1]
    hits = sum(r.predicted for r in toxic)
    assert hits / len(toxic) >= 0.9
    assert hits / sum(r.predicted for r in rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_scores_do_not_see_ids_or_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 3000")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in T.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b
    texts = docs.groupBy("text").agg(F.collect_list("doc_id").alias("ids")).where("size(ids) > 1").collect()
    assert texts and all(len({a[i] for i in t.ids}) == 1 for t in texts)


def test_odd_rows_and_no_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, 1), (None, 1), (11, None)], "doc_id long, toxic int")
    got = T.score(odd, labels).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert all(r.score == 0 for r in T.score(odd, labels.limit(0)).collect())
    assert T.score(empty, labels).count() == 0
