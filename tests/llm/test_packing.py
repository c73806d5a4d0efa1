"""Packing: best fit against a plain search, and lossless round trips."""

import random

import numpy as np
import pytest

from tiltkit.llm import packing as P

from .conftest import SF01, odd_rows


@pytest.mark.parametrize("length", [1, 7, 10, 16, 100])
def test_best_fit_like_a_plain_search(length):
    r = random.Random(length)
    for _ in range(40):
        sizes = sorted((r.randint(1, length) for _ in range(r.randrange(200))), reverse=True)
        rooms = []
        for n in sizes:
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else length) - n)
        rows = P.best_fit(sizes, length)
        assert sorted(length - sum(sizes[i] for i in row) for row in rows) == sorted(rooms)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))


def unpack(rows, length):
    """{doc_id: ids}, checking the matrices on the way."""
    pieces = {}
    for r in rows:
        ids, pos = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(pos) == length and r.cu_seqlens[-1] == r.n_tokens <= length
        assert (ids[r.n_tokens:] == P.PAD).all()
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (pos[a:b] == np.arange(b - a)).all()
            pieces.setdefault(d, []).append((start, ids[a:b].tolist()))
    return pieces


def ids_of(text):
    import base64

    import public_tokenizers
    import tiktoken

    with open(P.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return e.encode_ordinary(text or "")


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = P.pack(docs, length=512).collect()
    pieces = unpack(rows, 512)
    for r in docs.select("doc_id", "text").collect():
        own = sorted(pieces.get(r.doc_id, []))
        assert [i for _, p in own for i in p] == ids_of(r.text)
        assert all(len(p) == 512 for _, p in own[:-1])
    assert sum(r.n_tokens for r in rows) > 0.97 * 512 * len(rows)


def test_odd_rows_over_many_shards(odd, empty, monkeypatch):
    monkeypatch.setattr(P, "SHARD_BYTES", 50_000)
    rows = P.pack(odd, length=64).collect()
    assert len({r.shard for r in rows}) > 1
    pieces = unpack(rows, 64)
    want = {}
    for i, t, *_ in odd_rows():
        want[i] = want.get(i, 0) + len(ids_of(t))
    assert {i: sum(len(p) for _, p in x) for i, x in pieces.items()} == {i: n for i, n in want.items() if n}
    assert P.pack(empty).count() == 0


def test_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    again = [sorted(map(str, P.digests(P.pack(d)).collect())) for d in (docs, docs.repartition(5))]
    assert again[0] == again[1]


def test_write_packs(odd, tmp_path, spark):
    P.write_packs(P.pack(odd), str(tmp_path / "packs"))
    assert spark.read.parquet(str(tmp_path / "packs")).count() == P.pack(odd).count()
