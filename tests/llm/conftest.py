import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tests.conftest import SF001, SF01  # noqa: F401

#: Extra columns whose names operators use themselves.
CLASHES = ("kept", "row_", "sha", "size", "group", "ids", "key", "word", "hits", "n_words", "keep_id", "copies")
SCHEMA = StructType([StructField("doc_id", LongType()), *(StructField(c, StringType()) for c in ("text", "lang", "source")),
                     StructField("n_chars", LongType()), *(StructField(c, StringType()) for c in CLASHES)])


def frame(spark, rows):
    """Documents of (doc_id, text, lang, source) with clashing extra columns."""
    full = [(i, t, lang, src, None if t is None else len(t), *(f"x{i}" for _ in CLASHES)) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    r = random.Random(5)
    w = ["the", "of", "Word", "über", "naïve", "x|y", "###", "42", "日本", "İ"]
    prose = lambda n: " ".join(r.choice(w) + str(r.randrange(n)) for _ in range(n))
    base = prose(120)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t\x0b ", None, None), (4, "one", "en", "b"), (5, "one two", "de", "b"),
        (6, base, "en", "a"), (7, base.upper(), "en", "a"), (8, base + " tail", "en", None), (8, base + " tail", "en", None),
        (9, "ÀÉ straße", "fr", "c"), (10, "àé straße", "fr", "c"), (None, "no id", "en", "a"), (None, "no id", None, "é"),
        (11, prose(30_000), "en", "long"), (12, "z" * 100_000, "en", "long"), (13, "same " * 300, "en", "c"),
        (14, "a\nb c\n\na\nb c\n", "en", "c"), (15, "<|endoftext|> text <|endoftext|>", "en", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows()).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
