"""URL filter against a plain per-url judgement."""

import random
import re

import pytest

from tiltkit.llm import url_filter as U

from .conftest import SF001

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_of(host, path):
    fits = []
    for r in RULES:
        h, _, p = r.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(r)
    return max(fits, key=len, default=None)


URLS = ["http://Example.ORG/es/1", "https://a.b.example.org/en/17?x=1", "http://example.org/en/2", "http://x.com/fr/1#t", "ftp://com/de/",
        "http://com", "http://notexample.org/es/", "http://xcom/fr/", None, "", "no scheme", "://", "http://", "http://org?x", "http://org/",
        "http://example.org:80/es/", "http://é.com/de/ü", "x://y://z.org/", "http://example.org/en/1" + "a" * 50_000, "http://" + "a." * 5000 + "org/"]


def check(rows, got, listed):
    for (i, url), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.page_id, r.url)))):
        host, path = parts(url)
        rule = rule_of(host, path)
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, rule), url
        assert r.verdict == (RULES[rule] if rule else "block" if url in listed else "allow"), url


def test_rules_and_odd_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (3, URLS[3]), (None, "http://l.net/a")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, hits string")
    got = U.judge(pages, keep=("page_id", "url")).collect()
    assert len(got) == len(rows)
    check(rows, got, set())


@pytest.mark.parametrize("n_words", [None, 1])
def test_listed_urls(spark, monkeypatch, n_words):
    """Listed urls are blocked, others are not, also by a filter that is full."""
    if n_words:
        monkeypatch.setattr(U, "MAX_WORDS", n_words)
    r = random.Random(4)
    urls = [f"http://h{r.randrange(300)}.net/p{r.randrange(9)}" for _ in range(2000)]
    listed = set(urls[:200])
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    block = spark.createDataFrame([(u,) for u in listed], "url string")
    got = U.judge(pages, block).collect()
    assert len(got) == 2000
    assert all((urls[x.page_id] in listed) == x.listed == (x.verdict == "block") for x in got)


def test_canonical(spark):
    same = ["http://www.a.net/x/", "https://A.net/x", "http://m.a.net/x.html?utm_source=z#q", "http://a.net/x?ref=1"]
    df = spark.createDataFrame([(u,) for u in same], "url string").select(U.canonical(U.F.col("url")).alias("c"))
    assert {r.c for r in df.collect()} == {"a.net/x"}


def test_empty_tables_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none, none.select("url")).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert U.judge(one, rules=()).first().verdict == "allow"


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r.page_id: r for r in U.judge(pages, U.repeated_pages(pages)).collect()}
    assert len(got) == pages.count()
    for p in pages.select("page_id", "url").collect():
        assert got[p.page_id].rule == rule_of(*parts(p.url))
