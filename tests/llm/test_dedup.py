"""Exact dedup: groups, ties, and the filter's two passes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tiltkit.llm import exact_dedup as D

from .conftest import frame, odd_rows


def lowered(text):
    return (text or "").encode().lower()


def test_groups_of_odd_rows(odd):
    got = D.copy_groups(odd).collect()
    assert len(got) == len(odd_rows())
    groups = {}
    for i, t, *_ in odd_rows():
        groups.setdefault(hashlib.sha256(lowered(t)).hexdigest(), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    for sha, ids in groups.items():
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert groups[hashlib.sha256(b"").hexdigest()] == [1, 2]  # null counts as empty


def test_only_a_to_z_is_lowered(spark):
    got = {r.doc_id: r.group_size for r in D.copy_groups(frame(spark, [(1, "ÀB", "", ""), (2, "àb", "", ""), (3, "Àb", "", "")])).collect()}
    assert got == {1: 2, 2: 1, 3: 2}


def test_drop_copies_keeps_columns_and_one_row_each(odd):
    kept = D.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [lowered(r.text) for r in rows]
    assert len(texts) == len(set(texts)) == len({lowered(t) for _, t, *_ in odd_rows()})
    assert {r.doc_id for r in rows if r.text in (None, "")} == {2}


def test_empty_table(empty):
    assert D.copy_groups(empty).count() == 0
    assert D.drop_copies(empty).count() == 0


@pytest.mark.parametrize("n_words", [1, 64, 4096])
def test_full_filter_never_misses_a_copy(spark, n_words):
    """Also a filter far too small lets all copies through to the exact path."""
    rows = spark.range(3000).select(F.sha2((F.col("id") % 2000).cast("string"), 256).alias("sha"), "id")
    probed = D.probe(rows, D.repeat_filter(rows, n_words), n_words)
    assert probed.where("id % 2000 < 1000 AND NOT maybe").count() == 0
    if n_words == 4096:
        assert probed.where("id % 2000 >= 1000 AND maybe").count() < 50


def test_hot_group(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.col("id").cast("string")).alias("text"))
    got = D.copy_groups(rows)
    assert got.where("group_size = 3000 AND keep_id = 8997").count() == 3000
    assert got.where("kept").count() == 6001
