"""Quality rules: base counts and the divergence of a document's histograms
from its language's reference, by DataFrame expressions only.

Two histograms are compared by Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1): character classes, and the language's most common
words plus "any other word". The references are sums over all documents of a
language. A document is rejected by the base rules, or if a histogram is far
from its reference. Guards: the distance counts only for documents of at least
``MIN_WORDS`` words; languages with fewer than ``MIN_REFERENCE`` words in all
are judged by the character classes of all languages together; and the limit of the word histogram is wider for short documents, as a histogram
of n words strays from its source by about 1 / sqrt(n) without any fault.

Cases: a null text has no words and fails the base rules; a null language is a
language of its own; repeated rows are judged each; very long texts are judged
whole (all steps are linear or n log n); columns of the input named as a result
column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import col, let, packed, unpacked

#: Base rules.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Limits of the two distances; the word limit grows by SHORT_SLACK / sqrt(words).
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.22
SHORT_SLACK = 1.0
#: A language with fewer words in all has no reference of its own (one of so
#: many words strays by about 1 / sqrt(words), a tenth of the word limit).
MIN_REFERENCE = 2_000
#: Common words of a language's histogram.
COMMON = 16
#: Up to so many languages the references are broadcast.
MAX_BROADCAST_LANGUAGES = 4_000
#: Patterns of character classes.
UPPER = r"\p{Lu}"
DIGIT = r"\p{Nd}"
POINT = r"[.,;:!?'\"()\-]"
SYMBOLS = r"[#*$%&|<>]"
N_CLASSES = 7


def repeated_words(w: Column, exact: bool = False) -> Column:
    """Words covered by a 3-word window that the text holds twice or more.

    Windows are hashed to 64 bits and sorted with their position packed in the
    low 24 bits, so equal windows become neighbours in n log n steps. If two
    unlike windows agree in the 40 bits kept (or the text has 2^24 words),
    the sort is done on (hash, position) pairs instead (``exact``: always).
    """
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        """Words covered by windows that start at these sorted positions."""
        return F.aggregate(at, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
                           lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
                           lambda s: s["n"])

    def by_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p"))))
        twice = lambda s: F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return covered(F.sort_array(F.transform(let(pairs, twice), lambda x: x["p"])))

    low = F.lit((1 << 24) - 1).cast("long")

    def by_longs(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

        def judged(s: Column) -> Column:
            pos = lambda x: x.bitwiseAND(low).cast("int")
            near = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), 24) == 0
            twice = F.filter(s, lambda x, j: near(x, F.get(s, j + 1)) | near(x, F.get(s, j - 1)))

            def checked(t: Column) -> Column:
                unlike = F.exists(F.sequence(F.lit(0), F.size(t) - 1), lambda j: near(F.get(t, j), F.get(t, j + 1)) & (
                    F.get(h, pos(F.get(t, j))) != F.get(h, pos(F.get(t, j + 1)))))
                return F.when(F.size(t) == 0, F.lit(0).cast("long")).when(unlike, by_pairs(h)).otherwise(
                    covered(F.sort_array(F.transform(t, lambda x: x.bitwiseAND(low)))))

            return let(twice, checked)

        return let(keys, judged)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(
        let(hashes, lambda h: by_pairs(h) if exact else F.when(F.size(h) >= (1 << 24) - 1, by_pairs(h)).otherwise(by_longs(h))))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of the same length; null if
    one is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def of(a: Column) -> Column:
        terms = F.transform(F.arrays_zip(a["p"], a["q"]),
                            lambda z: part(z["p"] / a["np"], z["q"] / a["nq"]) + part(z["q"] / a["nq"], z["p"] / a["np"]))
        return F.when((a["np"] > 0) & (a["nq"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms) / 2)))

    return let(F.struct(p.alias("p"), q.alias("q"), total(p).alias("np"), total(q).alias("nq")), of)


def _characters(text: Column) -> Column:
    """Struct of word_chars, n_symbols and the characters per class: upper
    case, digit, point, symbol, new line, other white space, anything else
    (mostly lower-case letters). Classes are counted in what is left of the
    text without a-z and space, which is short."""
    found = F.struct(
        F.regexp_replace(text, "[a-z ]+", "").alias("rest"), F.char_length(text).cast("long").alias("n"),
        F.char_length(F.replace(text, F.lit(" "), F.lit(""))).cast("long").alias("solid"))

    def counted(f: Column) -> Column:
        n = lambda p: F.regexp_count(f["rest"], F.lit(p)).cast("long")
        counts = F.struct(n(UPPER).alias("u"), n(DIGIT).alias("d"), n(POINT).alias("p"), n(SYMBOLS).alias("s"),
                          n("\n").alias("l"), n(r"[\x09\x0B-\x0D]").alias("t"))

        def of(c: Column) -> Column:
            in_words = f["solid"] - c["l"] - c["t"]
            return F.struct(in_words.alias("word_chars"), c["s"].alias("n_symbols"), F.transform(
                F.array(c["u"], c["d"], c["p"], c["s"], c["l"], f["n"] - f["solid"] + c["t"],
                        in_words - c["u"] - c["d"] - c["p"] - c["s"]), lambda x: x.cast("double")).alias("classes"))

        return let(counts, of)

    return let(found, counted)


def _split(text: Column) -> Column:
    """The words of a text and empty strings, cut at single blanks."""
    return F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")


def _words(text: Column) -> Column:
    return F.filter(_split(text), lambda w: w != "")


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per language, over all documents: its COMMON most common words,
    their counts with all other words last, and the class counts. Languages of
    few words have no common words and the class counts of all. Words are
    counted before they shuffle, and ranked in 64 parts of a language first."""
    lang, text = col(docs, lang_col).alias("lang"), F.coalesce(col(docs, text_col), F.lit(""))
    rows = docs.select(lang, _characters(text)["classes"].alias("c"))
    classes = materialize(rows.groupBy("lang").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(N_CLASSES)]).alias("ref_classes")))
    pooled = classes.agg(*[F.sum(F.col("ref_classes")[i]) for i in range(N_CLASSES)]).first()
    pooled = F.array(*[F.lit(float(x or 0)) for x in pooled])
    # empty strings are counted along and dropped from the counts
    spelt = docs.select(lang, F.explode(_split(text)).alias("w"))
    counted = materialize(spelt.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).where("w <> ''"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    classes = classes.alias("a").join(totals.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang"))).select("a.lang", "ref_classes", "n")
    order = [F.desc("n"), F.asc("w")]
    parted = counted.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(64)))
    best = parted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= COMMON)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= COMMON)
    top = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
    own = F.col("n") >= MIN_REFERENCE
    ref = classes.alias("c").join(top.alias("t"), F.col("c.lang").eqNullSafe(F.col("t.lang")), "left").withColumn("top", F.when(own, F.col("top")))
    kept = F.transform("top", lambda x: x["n"].cast("double"))
    return ref.select(
        F.col("c.lang").alias("ref_lang"), F.transform("top", lambda x: x["w"]).alias("ref_words"),
        F.concat(kept, F.array(F.col("n").cast("double") - F.aggregate(kept, F.lit(0.0), lambda s, x: s + x))).alias("ref_counts"),
        F.when(own, F.col("ref_classes")).otherwise(pooled).alias("ref_classes"),
        F.array_max(F.transform("top", lambda x: F.octet_length(x["w"]))).alias("ref_longest"))


def _word_counts(w: Column, common: Column, longest: Column) -> Column:
    """Counts of the common words in a document, all other words last: common
    words are written as one letter each and the letters counted. Words of
    more bytes than the longest common one are not looked up."""
    letters = F.array(*[F.lit(x) for x in " " + "abcdefghijklmnopqrstuvwxyz"[:COMMON]])
    spelt = F.array_join(F.transform(F.filter(w, lambda x: F.octet_length(x) <= longest), lambda x: F.get(letters, F.array_position(common, x).cast("int"))), "")

    def count(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(common)),
                           lambda i: F.char_length(t) - F.char_length(F.replace(t, F.get(letters, i), F.lit(""))))
        return let(each, lambda e: F.transform(F.concat(e, F.array(F.size(w) - F.aggregate(e, F.lit(0), lambda a, x: a + x))),
                                               lambda x: x.cast("double")))

    return F.when(F.size(common) > 0, let(spelt, count))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance and kept. One pass builds the
    references, a second judges; no document is shuffled."""
    ref = materialize(references(docs, text_col, lang_col))
    if ref.count() <= MAX_BROADCAST_LANGUAGES:  # some 600 bytes each
        ref = F.broadcast(ref)
    text = col(docs, text_col)
    rows = docs.select(packed(docs), col(docs, lang_col).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.join(ref, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")

    def verdict(w: Column) -> Column:
        found = F.struct(
            F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"), _characters(F.col("text")).alias("m"),
            _distance(_word_counts(w, F.col("ref_words"), F.col("ref_longest")), F.col("ref_counts")).alias("word"))

        def of(f: Column) -> Column:
            def told(apart: Column) -> Column:
                failed = (f["n"] < MIN_WORDS) | (100 * f["repeated"] > MAX_REPEATED_PERCENT * f["n"])
                far = (apart > MAX_CLASS_DISTANCE) | (f["word"] > MAX_WORD_DISTANCE + SHORT_SLACK / F.sqrt(F.greatest(f["n"], F.lit(1))))
                return F.struct(
                    f["n"].alias("n_words"), f["m"]["word_chars"].alias("word_chars"), f["m"]["n_symbols"].alias("n_symbols"),
                    f["repeated"].alias("n_repeat_words"), failed.alias("base_failed"), apart.alias("class_distance"),
                    f["word"].alias("word_distance"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"))

            return let(_distance(f["m"]["classes"], F.col("ref_classes")), told)

        return let(found, of)

    judged = rows.select("row_", repeated_lines(F.col("text")).alias("n_dup_lines"), let(_words(F.col("text")), verdict).alias("v"))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance",
             "word_distance", "kept"]
    keep = [F.col("row_")[c].alias(c) for c in docs.columns if c not in added]
    return judged.select(*keep, *[F.col(c) if c == "n_dup_lines" else F.col("v")[c].alias(c) for c in added])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with the columns of the input."""
    whole = docs.select(packed(docs), col(docs, text_col).alias("text"), col(docs, lang_col).alias("lang"))
    return unpacked(judge(whole, "text", "lang").where("kept").select("row_"))
