"""Collocations: phrases of 2 to 4 words that belong together, per language.

Counts are exact and are made in three passes over the whole texts. A phrase
can be frequent only if its parts are, so the first pass counts the words, the
second one tells which pairs of frequent words can be frequent, and the third
one counts the phrases of which all pairs can be. The second pass only counts
64-bit hashes, as packed numbers; in the two others,

1. each task counts in a HAT-trie over word ids of its own (``hat_trie``). When
   the trie is full, its largest subtrees are spilled as runs sorted by phrase;
2. the runs of all tasks are merged per prefix partition: a partition has all
   phrases of some first words. First words with more than a thousandth of all
   words (so 1,000 at most) have their phrases dealt to several partitions.

What is frequent is told to the next pass by a blocked Bloom filter of bounded
size; what it lets pass wrongly (or two pairs of one hash) is counted and then
dropped by its exact count, and when full it lets more pass, never less. Scores
are joins of the counts.

Cases: a null text is empty; a null language is ``und``; empty texts and tables
give no phrase; a very long text is read in segments, also where it has no
punctuation; copies and repeated rows all count; ties are ranked by phrase;
only text and lang are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import Rounds, col, small_batches

LEAST = 30
LONGEST = 4
COVER = 80
TOP = 2_000
#: Words a task holds before they are counted, phrases and words of its trie.
BLOCK_WORDS = 100_000
MOST_PHRASES = 200_000
MOST_WORDS = 300_000
#: Bytes of a text that are split at a time.
SEGMENT = 1 << 20
#: Most 64-bit words of a filter (16 MB).
MAX_WORDS = 1 << 21
#: Hashes of pairs a task holds, and words of the corpus per part of all hashes.
MOST_HASHES = 600_000
PART_WORDS = 500_000
#: Packed parts, and whole texts, that travel between Spark and Python at a time.
BATCH_PARTS = 50
BATCH_TEXTS = 200
#: A first word with over 1 / SHARE of all words has several partitions.
SHARE = 1_000

_FOLD = bytearray(range(256))
for _c in range(ord("A"), ord("Z") + 1):
    _FOLD[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLD[_c] = ord("\n")
_FOLD[ord("\t")] = ord(" ")
_FOLD = bytes(_FOLD)


def segments(text: bytes, size: int = SEGMENT) -> Iterator[tuple[bytes, bool]]:
    """A folded text in parts cut at piece ends, or between words where a
    piece is long; with whether the next part goes on with the same piece."""
    at = 0
    while at < len(text):
        end, on = at + size, False
        if end >= len(text):
            end = len(text)
        elif (cut := text.rfind(b"\n", at, end)) >= 0:
            end = cut
        else:
            while end < len(text) and text[end] not in b" \n":
                end += 1
            on = text[end:end + 1] == b" "
        yield text[at:end], on
        at = end + 1


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def pair_hash(a, b):
    """Hash of two words from their hashes (numpy arrays)."""
    import numpy as np

    return _mixed(_mixed(a) * np.uint64(0xD1342543DE82EF95) + b)


def _places(h, n_words: int):
    """Word and bits of keys in a blocked filter."""
    import numpy as np

    bits = np.zeros(len(h), dtype=np.uint64)
    for j in range(4):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
    return ((h >> np.uint64(24)) % np.uint64(n_words)).astype(np.int64), bits


def _word_hash(lang: str, word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode()))


def hash_filter(hashes: DataFrame, max_words: int = MAX_WORDS):
    """A filter of the numbers ``h``, as an array of at most ``max_words``
    words; its size follows the number of rows up to there."""
    import numpy as np

    n_words = min(max_words, 1 << max(4, (hashes.count() // 4).bit_length()))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            at, bits = _places(b.column("h").to_numpy().view(np.uint64), n_words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], names=["at", "bits"])

    masks = hashes.select("h").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n_words, dtype=np.uint64)
    words[masks["at"].to_numpy()] = masks["bits"].to_numpy().view(np.uint64)
    return words


def word_hashes(words: DataFrame) -> DataFrame:
    """The hashes ``h`` of (lang, phrase) rows that are words."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist())
            h = np.array([_word_hash(lang, word.encode()) for lang, word in rows], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h bigint")


class _Counter:
    """The trie of a task, with its words; or the hashes of its pairs."""

    def __init__(self, widths: tuple, word_filter=None, pair_filter=None, splits: dict | None = None, parts: int = 0):
        self.widths, self.word_filter, self.pair_filter, self.splits, self.parts = widths, word_filter, pair_filter, splits or {}, parts
        self.held: dict[str, list] = {}  # language -> words, sizes of their pieces, words of the first one counted before
        self.n_held = 0
        self.totals: dict[str, int] = {}
        self.seen, self.n_seen = [], 0  # (sorted hashes of pairs, counts)
        self._begin()

    def _begin(self) -> None:
        import numpy as np

        from .hat_trie import HatTrie

        self.trie, self.ids, self.words, self.langs, self.raw = HatTrie(), {}, [], [], []
        self.hashes, self.frequent = np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)

    def _vocabulary(self, lang: str) -> dict:
        """word -> id of a language's words; a new word gets the next id."""
        if lang not in self.ids:
            words, langs, raw = self.words, self.langs, self.raw

            class Ids(dict):
                def __missing__(self, word: bytes) -> int:
                    self[word] = at = len(words)
                    words.append(word)
                    langs.append(lang)
                    raw.append(_word_hash(lang, word))
                    return at

            self.ids[lang] = Ids()
        return self.ids[lang]

    def read(self, lang: str, text: bytes) -> Iterator:
        """Counts a text; gives the batches of rows spilled meanwhile."""
        on = False
        for part, goes_on in segments(text.translate(_FOLD)):
            words, sizes, _ = self.held.setdefault(lang, [[], [], 0])
            for piece in part.split(b"\n"):
                found = piece.split()
                if on:
                    sizes[-1] += len(found)
                elif found:
                    sizes.append(len(found))
                words += found
                # a part that goes on is one piece; it may have no word yet
                on = goes_on and (on or bool(found))
            self.n_held += part.count(b" ") + 1
            if self.n_held >= BLOCK_WORDS:
                yield from self.count(lang if on else None)

    def count(self, open_lang: str | None = None) -> Iterator:
        """Counts what is held. The last piece of ``open_lang`` goes on: the
        words that its next phrases begin with stay."""
        held, self.held, self.n_held = self.held, {}, 0
        for lang, (words, sizes, before) in held.items():
            if words:
                self._block(lang, words, sizes, before)
                if lang == open_lang and sizes:
                    kept = words[len(words) - min(sizes[-1], LONGEST - 1):]
                    self.held[lang] = [kept, [len(kept)], len(kept)]
            if self.trie.size > MOST_PHRASES:
                yield from self.spilled(MOST_PHRASES // 2)
            if self.n_seen > MOST_HASHES:
                self._merge_seen()
                if self.n_seen > MOST_HASHES // 2:
                    yield from self.hashes_seen()
            if len(self.words) > MOST_WORDS:
                yield from self.spilled(0)
                self._begin()

    def _block(self, lang: str, words: list, sizes: list, before: int) -> None:
        import numpy as np

        from .hat_trie import packed_rest

        ids = np.fromiter(map(self._vocabulary(lang).__getitem__, words), dtype=np.int64, count=len(words))
        if self.widths == (1,):
            self.totals[lang] = self.totals.get(lang, 0) + len(ids) - before
            found, counts = np.unique(ids[before:], return_counts=True)
            self.trie.add_words(found.tolist(), counts.tolist())
            return
        self._learn()
        piece = np.repeat(np.arange(len(sizes)), sizes)
        known = self.frequent[ids]
        pairs = known[:-1] & known[1:] & (piece[:-1] == piece[1:])
        starts = np.flatnonzero(pairs)
        if not self.widths:
            self._see(starts[starts + 2 > before], ids)
            return
        at, bits = _places(pair_hash(self.hashes[ids[starts]], self.hashes[ids[starts + 1]]), len(self.pair_filter))
        pairs[starts[self.pair_filter[at] & bits != bits]] = False
        for width in self.widths:
            n = len(ids) - width + 1
            if n <= 0:
                continue
            good = np.ones(n, dtype=bool)
            for j in range(width - 1):
                good &= pairs[j:n + j]
            starts = np.flatnonzero(good)
            starts = starts[starts + width > before]  # the others were counted before
            self._add(ids[starts], packed_rest(ids, starts, width))

    def _learn(self) -> None:
        """Hashes of the new words, and whether they can be frequent."""
        import numpy as np

        new = np.array(self.raw[len(self.hashes):], dtype=np.uint64)
        self.hashes = np.concatenate([self.hashes, new])
        if self.word_filter is not None:
            at, bits = _places(new, len(self.word_filter))
            self.frequent = np.concatenate([self.frequent, self.word_filter[at] & bits == bits])

    def _see(self, starts, ids) -> None:
        import numpy as np

        h, n = np.unique(pair_hash(self.hashes[ids[starts]], self.hashes[ids[starts + 1]]), return_counts=True)
        self.seen.append((h, n.astype(np.int64)))
        self.n_seen += len(h)

    def _merge_seen(self) -> None:
        self.seen = [summed(*zip(*self.seen))] if self.seen else []
        self.n_seen = sum(len(h) for h, _ in self.seen)

    def hashes_seen(self) -> Iterator:
        """(part, hashes, counts): the sorted hashes of each part, packed."""
        import numpy as np
        import pyarrow as pa

        self._merge_seen()
        seen, self.seen, self.n_seen = self.seen, [], 0
        for h, n in seen:
            part = ((h >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(h) else np.zeros(1, dtype=np.int64)
            for at in range(0, len(cuts) - 1, BATCH_PARTS):
                spans = list(zip(cuts[at:at + BATCH_PARTS], cuts[at + 1:at + BATCH_PARTS + 1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[a]) for a, _ in spans], pa.int64()), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                     pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())], names=["part", "hashes", "counts"])

    def _add(self, first, rest) -> None:
        import numpy as np

        if not len(first):
            return
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
        counts = np.diff(np.append(new, len(first)))
        first, rest = first[new], rest[new]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]]))
        rests, counts = rest.tolist(), counts.tolist()
        for f, a, b in zip(first[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            self.trie.add(f, rests[a:b], counts[a:b])

    def spilled(self, keep: int) -> Iterator:
        """(partition, language, phrase, count) of the subtrees given up, in
        runs of whole subtrees sorted by phrase."""
        import numpy as np

        self._learn()
        known = self._words()
        if self.trie.ends:
            ids, counts = self.trie.spill_words()
            yield self._run(known, np.array(ids, dtype=np.int64), None, counts)
        firsts, sizes, rests, counts = [], [], [], []
        for first, r, n in self.trie.spill(keep):
            firsts.append(first)
            sizes.append(len(r))
            rests += r
            counts += n
            if len(rests) > 50_000:
                yield self._run(known, np.repeat(firsts, sizes), np.array(rests, dtype=np.int64), counts)
                firsts, sizes, rests, counts = [], [], [], []
        if rests:
            yield self._run(known, np.repeat(firsts, sizes), np.array(rests, dtype=np.int64), counts)

    def _words(self):
        """The words and their languages as Arrow arrays."""
        import pyarrow as pa

        return pa.array(self.words, pa.binary()), pa.array(self.langs, pa.string())

    def _run(self, known: tuple, firsts, rests, counts: list):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from .hat_trie import word_at

        words, langs = known
        phrase, tail = words.take(pa.array(firsts)), self.hashes[firsts]
        if rests is not None:
            after = [word_at(rests, place) for place in (1, 2, 3)]
            texts = [words.take(pa.array(ids, mask=ids < 0)) for ids in after]
            phrase = pc.binary_join_element_wise(phrase, *texts, b" ", null_handling="skip")
            for ids in after:
                tail = np.where(ids < 0, tail, pair_hash(tail, self.hashes[np.maximum(ids, 0)]))
        part = (self.hashes[firsts] >> np.uint64(2)).astype(np.int64)
        if self.splits:
            names, place = np.unique(firsts, return_inverse=True)
            split = np.array([self.splits.get((self.langs[i], self.words[i]), 1) for i in names.tolist()], dtype=np.uint64)[place]
            part += (tail % split).astype(np.int64)
        rows = pa.RecordBatch.from_arrays(
            [pa.array(part), langs.take(pa.array(firsts)), phrase.cast(pa.string()), pa.array(counts, pa.int64())],
            names=["part", "lang", "phrase", "n"])
        return rows.take(pc.sort_indices(phrase))

    def rest(self) -> Iterator:
        import pyarrow as pa

        yield from self.count()
        if not self.widths:
            yield from self.hashes_seen()
            return
        yield from self.spilled(0)
        if self.totals:
            empty = [None] * len(self.totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(empty), pa.int64()), pa.array(list(self.totals), pa.string()), pa.array(empty, pa.string()),
                 pa.array(list(self.totals.values()), pa.int64())], names=["part", "lang", "phrase", "n"])


def summed(hashes, counts):
    """Distinct hashes of several arrays, sorted, with the sums of their counts."""
    import numpy as np

    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")  # runs that are sorted already merge
    h, n = h[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    return h[new], np.add.reduceat(n, new) if len(h) else n


def _counted(docs: DataFrame, schema: str, widths: tuple, word_filter=None, pair_filter=None, splits: dict | None = None, parts: int = 0) -> DataFrame:
    """What the tasks count of (lang, text)."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((word_filter, pair_filter, splits, parts))  # filters of bounded size, SHARE splits at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = _Counter(widths, *sent.value)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").cast(pa.binary())):
                yield from counter.read(lang, text.as_py() or b"")
        yield from counter.rest()

    return docs.mapInArrow(run, schema)


def _frequent(docs: DataFrame, least: int, widths: tuple, *filters) -> DataFrame:
    """(lang, phrase, f) of phrases with ``least`` occurrences or more (with
    single words also the number of words, as phrase null): the spilled runs
    of all tasks merged per prefix partition."""
    runs = _counted(docs, "part bigint, lang string, phrase string, n bigint", widths, *filters)
    merged = runs.repartition("part").groupBy("part", "lang", "phrase").agg(F.sum("n").alias("f"))
    return merged.where((F.col("f") >= least) | F.col("phrase").isNull()).select("lang", "phrase", "f")


def _frequent_pairs(docs: DataFrame, least: int, word_filter, n_words: int) -> DataFrame:
    """Hashes ``h`` of pairs of frequent words that occur ``least`` times or
    more; a task sums the packed hashes of a part at a time."""
    parts = max(1, n_words // PART_WORDS)
    packed_hashes = _counted(docs, "part bigint, hashes binary, counts binary", (), word_filter, None, None, parts)

    def run(batches: Iterator) -> Iterator:
        import itertools

        import numpy as np
        import pyarrow as pa

        rows = (row for b in batches for row in zip(b.column("part").to_pylist(), b.column("hashes"), b.column("counts")))
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            group = [(np.frombuffer(h.as_py(), dtype=np.uint64), np.frombuffer(n.as_py(), dtype=np.int64)) for _, h, n in group]
            h, n = summed(*zip(*group))
            yield pa.RecordBatch.from_arrays([pa.array(h[n >= least].view(np.int64))], names=["h"])

    return packed_hashes.repartition("part").sortWithinPartitions("part").mapInArrow(run, "h bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to 4 words that occur ``least``
    times or more, and (lang, n), from (lang, text)."""
    tables = Rounds(docs.sparkSession)
    with small_batches(docs.sparkSession, BATCH_TEXTS):
        first = tables.write(_frequent(docs, least, (1,)))
        totals = first.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
        words = first.where("phrase IS NOT NULL")
        n = totals.agg(F.sum("n")).first()[0] or 0
        # words above 1 / share of all are fewer than share
        hot = words.where(F.col("f").cast("decimal(38,0)") * share > n).collect()
        splits = {(r.lang, r.phrase.encode()): -(-r.f * share // n) for r in hot}
        word_filter = hash_filter(tables.write(word_hashes(words)), max_words)
        pair_filter = hash_filter(tables.write(_frequent_pairs(docs, least, word_filter, n)), max_words)
        longer = tables.write(_frequent(docs, least, (2, 3, 4), word_filter, pair_filter, splits))
    return words.unionByName(longer), totals


def _part(words: Column, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _each(n: Column, low: int, row: Callable[[Column], Column]) -> Column:
    """An array of ``row(i)`` for i from ``low`` to n."""
    return F.when(n >= low, F.transform(F.sequence(F.lit(low), n), row))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, cover: int = COVER,
                 top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(F.coalesce(col(docs, lang_col).cast("string"), F.lit("und")).alias("lang"), col(docs, text_col).alias("text"))
    counts, totals = phrase_counts(rows, least)
    words = F.split("phrase", " ")
    found = counts.withColumn("words", words).withColumn("size", F.size("words")).where("size > 1").withColumnRenamed("f", "a")
    cuts = found.select("lang", "phrase", "a", F.explode(_each(F.col("size") - 1, 1, lambda k: F.struct(
        k.alias("k"), _part(F.col("words"), 1, k).alias("left"), _part(F.col("words"), k + 1, F.col("size") - k).alias("right")))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    for side in ("left", "right"):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])), ["lang", side])
    # 2000000 * a may pass 64 bits
    score = F.expr("CAST(a AS DECIMAL(30,0)) * 2000000BD div (CAST(l AS DECIMAL(30,0)) + CAST(r AS DECIMAL(30,0)))").cast("long")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = found.where("size > 2").select("lang", "a", F.explode(F.flatten(_each(F.col("size") - 1, 2, lambda n: _each(
        F.col("size") - n + 1, 1, lambda i: _part(F.col("words"), i, n))))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").where((100 * F.col("longer") < cover * F.col("a")) | F.col("longer").isNull())
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return materialize(best).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, cover: int = COVER, top: int = TOP) -> str:
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
sized AS (SELECT lang, ws, unnest(range(1, {LONGEST} + 1)) AS size FROM worded),
placed AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM sized),
counts AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, size, count(*) AS f FROM placed GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, size, f AS a FROM counts WHERE size > 1 AND f >= {least}),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cut c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, ws, a, size, unnest(range(2, size)) AS part FROM cand),
parts AS (SELECT lang, ws, a, part, unnest(range(1, size - part + 2)) AS i FROM inside),
covered AS (SELECT lang, array_to_string(ws[i:i + part - 1], ' ') AS phrase, max(a) AS longer FROM parts GROUP BY ALL),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN covered c ON c.lang = l.lang AND c.phrase = l.phrase
  WHERE c.longer IS NULL OR 100 * c.longer < {cover} * l.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= {top}
"""
