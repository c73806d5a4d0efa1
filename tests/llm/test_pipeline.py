"""The pipeline's stages against brute force, and their columns."""

import math

import corpus_pipeline as P
from tiltkit.llm import queries as Q

from .conftest import SF001, frame, odd_rows
from .test_ngram_join import brute
from .test_quality import base


def run_stages(spark, docs, tmp_path):
    out = []
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF001).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs)
    return out


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    good, unique, near, mixed, tokens = run_stages(spark, docs, tmp_path)
    for df in (good, unique, near, mixed):
        assert df.columns == docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = ids(good)
    assert not [i for i in kept if base(rows[i])[5]]
    last = {}
    for i in kept:
        low = rows[i].encode().lower()
        last[low] = max(last.get(low, i), i)
    assert ids(unique) == sorted(last.values())
    left = [(i, rows[i]) for i in ids(unique)]
    assert ids(near) == sorted({c for _, _, c in brute(left, 5, 80)})
    sources = {}
    for r in near.collect():
        sources.setdefault(r.source, []).append(base(r.text)[0])
    total = sum(map(sum, sources.values()))
    took = {}
    for r in mixed.collect():
        took[r.source] = took.get(r.source, 0) + base(r.text)[0]
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sources))}
    share = {s: total * weight[s] / sum(weight.values()) for s in sources}
    if all(share[s] <= 3 * sum(sources[s]) for s in sources):
        assert all(abs(took.get(s, 0) - share[s]) <= 2 * max(sources[s]) for s in sources)
    assert ids(tokens) == ids(mixed)
    assert tokens.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert all(len(r.ids) == 4 * r.n_tokens and not math.isnan(r.n_tokens) for r in tokens.collect())


def test_odd_rows_and_empty_table(spark, odd, empty, tmp_path):
    for docs, name in ((odd, "odd"), (empty, "empty"), (frame(spark, odd_rows()[:3]), "few")):
        (tmp_path / name).mkdir()
        out = run_stages(spark, docs, tmp_path / name)
        assert all(df.columns == docs.columns for df in out[:-1])


def test_run_and_registration(spark):
    was = spark.conf.get(P.BATCH)
    assert P.run(spark, SF001).count() > 0
    assert spark.conf.get(P.BATCH) == was  # the caller's setting is back
    assert set(P.QUERIES) == {"pipeline"} and len(P.STAGES) == 5
    names = sorted(Q.QUERIES, key=lambda k: int(k[2:].split("_")[0]))
    assert [int(k[2:].split("_")[0]) for k in names] == list(range(1, 14))
