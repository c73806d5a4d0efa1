"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import random
from array import array

import pytest

from tiltkit.llm import bpe

from .conftest import SF001, SF01, odd_rows

LETTERS = [chr(c) for c in [*range(0x250), *range(0x300, 0x380), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600, 0x85, 0xFEFF]]


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def numbers(ids):
    return list(array("I", ids))


def test_random_texts_match_the_library(vocabulary, library):
    r = random.Random(7)
    for n in range(1500):
        pool = LETTERS if n % 2 else list("  \n\t'sabcd123é!|<>") + ["<|endoftext|>", "'re", "\r\n"]
        text = "".join(r.choices(pool, k=r.randrange(60)))
        want = library.encode(text, add_special_tokens=False)
        ids = vocabulary.encode(text)
        assert numbers(ids) == want.ids, repr(text)
        assert vocabulary.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "é" * 500, " " * 700, "\n" * 99, "xyz" * 31, "日本" * 200])
def test_long_words_match_the_library(vocabulary, library, text):
    assert numbers(vocabulary.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_array_and_heap_merge_alike(vocabulary):
    r = random.Random(3)
    for _ in range(300):
        piece = bytes(r.choices(b"aeinrst othe", k=r.randrange(2, 90)))
        assert bpe.merge_short(piece, vocabulary) == bpe.merge_long(piece, vocabulary)


def test_decoding_broken_utf8(vocabulary, library):
    ids = vocabulary.encode("日本")[:4]
    assert vocabulary.decode(ids) == library.decode(numbers(ids), skip_special_tokens=False)


def test_digests_of_odd_rows(odd, empty, library):
    got = {(r.doc_id, r.decoded_sha256): r for r in bpe.digests(odd).collect()}
    for i, t, *_ in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
    assert bpe.digests(empty).count() == 0


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    tokens = bpe.encode(docs)
    assert tokens.columns == [*docs.columns, "ids", "n_tokens"]
    assert bpe.decode(tokens).where("decoded <> text").count() == 0


def test_columns_named_as_results_are_replaced(odd):
    assert bpe.encode(odd).columns.count("ids") == 1


def test_cache_is_bounded_in_bytes_within_one_text(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    r = random.Random(11)
    text = " ".join("".join(r.choices("abcdefgh", k=r.randrange(1, 12))) for _ in range(20_000))
    assert numbers(v.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert v.cache.held <= 20_000 and len(v.cache) + len(v.cache.old) < 20_000 // bpe.ENTRY_BYTES * 2 + 2 * len(v.cache.entries)


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()}
    for i, t in docs.collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
