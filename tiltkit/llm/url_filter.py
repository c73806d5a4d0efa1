"""URL filter: blocked Bloom filter of the listed keys, then an exact join.

Listed are rules (host and path prefix, each with its verdict) and canonical
URLs (to be blocked). A url asks for the keys that could be listed for it: its
canonical form, and every pair of a host suffix and a path prefix as long as a
rule's. The filter answers from one 64-bit word per key (four bits each); a url
without a possible hit passes with the default verdict and is not shuffled.
The possible hits meet the list in an exact hash join, which removes false
positives; the longest rule wins, then the listed URL, then the default.

The filter has at most ``MAX_WORDS`` words, whatever the length of the list; a
longer list makes more false positives, never a wrong verdict. The rules are a
bounded literal list; the listed URLs may be any number of rows.

Cases: a null url, or one without ``://``, has an empty host and path and gets
the default; empty urls, repeated rows and rows with null ids are judged each;
columns of the input cannot clash with working columns; an empty table gives an
empty result. Urls are canonicalised by ``canonical``; the contract's host and
path keep what the url says.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..session import materialize
from .common import col, let

#: (verdict, host, path prefix) of the default rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_WORDS = 1 << 19
BITS_PER_KEY = 16
PROBES = 4
#: Most rules of one call (they are literals in the plan).
MAX_RULES = 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Query parameters that do not name a page.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www. and m., path without a closing slash or .html, and
    the query's parameters in order without those that only track."""
    asked = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    page = F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), r"(/|\.html)$", ""))
    return F.when(F.size(kept) > 0, F.concat(page, F.lit("?"), F.array_join(kept, "&"))).otherwise(page)


def listed_keys(spark: SparkSession, urls: DataFrame | None, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(key, rule, verdict) of rules and of listed urls (a column ``url``)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: list urls instead")
    given = [F.struct(F.lit("p:" + h + p).alias("key"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
             for v, h, p in rules]
    none = F.array().cast("array<struct<key:string,rule:string,verdict:string>>")
    keys = spark.range(1).select(F.inline(F.array(*given) if given else none))
    if urls is not None:
        keys = keys.unionByName(urls.select(
            F.concat(F.lit("u:"), canonical(F.col("url"))).alias("key"), F.lit(None).cast("string").alias("rule"),
            F.lit("block").alias("verdict")).distinct())
    return keys


def _possible_keys(host: Column, path: Column, canon: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    lengths = sorted({len(p) for _, _, p in rules})
    labels = max([h.count(".") + 1 for _, h, _ in rules], default=0)
    own = F.array(F.concat(F.lit("u:"), canon))
    if not rules:
        return own

    def suffixes(a: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(1), F.lit(labels)), lambda k: k <= F.size(a)),
                           lambda k: F.array_join(F.slice(a, -k, k), "."))

    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length(path)),
                         lambda n: F.substr(path, F.lit(1), n))
    prefixed = let(F.struct(let(F.split(host, r"\."), suffixes).alias("hosts"), starts.alias("paths")),
                   lambda s: F.flatten(F.transform(s["hosts"], lambda h: F.transform(
                       s["paths"], lambda p: F.concat(F.lit("p:"), h, p)))))
    return F.when(host != "", F.concat(own, prefixed)).otherwise(F.array().cast("array<string>"))


def _word(h: Column, n_words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(n_words))


def _mask(h: Column) -> Column:
    """The bits of a key in its word: 6 low bits of its hash name each."""
    out = None
    for j in range(PROBES):
        at = F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def blocked_bloom(keys: DataFrame, n_words: int):
    """The filter's words as a numpy array of n_words unsigned 64-bit numbers:
    masks are OR-ed before they shuffle, and at most n_words rows come back."""
    import numpy as np

    hashed = keys.select(F.xxhash64("key").alias("h"))
    found = hashed.groupBy(_word(F.col("h"), n_words).alias("word")).agg(F.bit_or(_mask(F.col("h"))).alias("mask")).toArrow()
    words = np.zeros(n_words, dtype=np.uint64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return words


def with_possible_hits(rows: DataFrame, words) -> DataFrame:
    """Replaces the array column ``keys`` by ``hits``: those of the keys that
    the filter may hold."""
    sent = rows.sparkSession.sparkContext.broadcast(words)  # 8 * MAX_WORDS bytes at most
    kept = [c for c in rows.columns if c != "keys"]
    asked = rows.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))

    def probe(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.zeros(len(flat), dtype=np.uint64)
            for j in range(PROBES):
                bits |= np.uint64(1) << ((flat >> np.uint64(6 * j)) & np.uint64(63))
            held = sent.value[(flat >> np.uint64(24)) % np.uint64(len(sent.value))]
            may = (held & bits) == bits
            ends = np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))
            left = np.concatenate([[0], np.cumsum(may)])[np.concatenate([[0], ends]).astype(np.int64)]
            hits = pa.ListArray.from_arrays(pa.array(left, pa.int32()), keys.flatten().filter(pa.array(may)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), hits], names=[*kept, "hits"])

    schema = StructType([*(f for f in rows.schema.fields if f.name != "keys"), StructField("hits", ArrayType(StringType()))])
    return asked.mapInArrow(probe, schema)


def n_words_for(n_keys: int) -> int:
    return min(MAX_WORDS, 1 << max(4, (n_keys * BITS_PER_KEY // 64).bit_length()))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES,
          url_col: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """Per row of ``pages``: the columns ``keep``, host, path, rule, verdict
    and ``listed`` (its canonical URL is listed)."""
    spark = pages.sparkSession
    keys = materialize(listed_keys(spark, listed, rules))
    n_words = n_words_for(keys.count())
    url = col(pages, url_col)
    kept = F.struct(*[col(pages, c).alias(c) for c in keep]).alias("kept")
    rows = pages.select(kept, url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    words = blocked_bloom(keys, n_words)
    rows = rows.withColumn("keys", _possible_keys(F.col("host"), F.col("path"), canonical(F.col("url")), rules))
    rows = with_possible_hits(rows, words)
    out = [F.col("kept")[c].alias(c) for c in keep]
    passed = rows.where(F.size("hits") == 0).select(
        *out, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
        F.lit(False).alias("listed"))
    maybe = rows.where(F.size("hits") > 0)
    # a verdict depends on the url alone
    asked = maybe.select("url", "hits").distinct().select("url", F.explode("hits").alias("key"))
    # written, so that the next join can split a url that many rows share
    found = materialize(asked.join(keys, "key").groupBy("url").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.char_length("rule").alias("n"), "rule", "verdict"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed")))
    told = maybe.join(found, "url", "left").select(
        *out, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("listed"), F.lit("block")), F.lit(default)).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"))
    return passed.unionByName(told)


def repeated_pages(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Urls whose canonical form more than one row has: the block list that a
    crawl gives of itself. Counted before it shuffles."""
    urls = pages.select(col(pages, url_col).alias("url"))
    return urls.groupBy(canonical(F.col("url")).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).where((F.col("n") > 1) & (F.col("c") != "")).select("url")


SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS asked
  FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '')
           || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS canon FROM p),
r AS (SELECT *, count(*) OVER (PARTITION BY canon) > 1 AND host <> '' AS listed,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
