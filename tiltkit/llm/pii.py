"""PII surrogates with DataFrame expressions only.

Detected entities are cut into atoms, the parts that name something: a mail's
local part and its domain, a phone number, a card number, an IPv4 address, a
secret, the words of a name after a title. Every distinct atom gets a surrogate
drawn from a keyed digest of (kind, atom, attempt) that keeps its type: letters
stay letters of their script and case, digits stay digits, a card keeps its
Luhn validity, an address its private range, a name its script, case and
gender. Atoms whose surrogate another atom has, or which is itself an atom of
the corpus, draw again until there is none, so unlike atoms stay unlike. Where
more than a quarter of the addresses of a range, or of the phone numbers of a
beginning and shape, are atoms, a keyed permutation of all of them without fixed
points is taken instead: still distinct and never the atom itself, but it may be
another atom. One table holds the surrogates, so the same atom becomes the same
everywhere.

Texts are searched once, and written with what was found. Those without an
entity are not shuffled. The others meet their surrogates by a
digest of the text, after atoms are made distinct.

Cases: a null text stays null, an empty text empty; other columns pass
unchanged and cannot clash (``n_entities`` replaces a column of that name);
repeated rows are replaced alike; very long texts are replaced whole in linear
passes; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Rounds, col, let, packed

#: Default key of the surrogates; a real run passes its own secret.
KEY = "corpus-key"
MAX_ROUNDS = 64
#: Rounds of the permutation of a crowded space.
FEISTEL = 24
#: Titles that show a gender.
MALE = "Mr|Herr|Monsieur|Señor|Sr|господин|г-н|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Srta|госпожа|г-жа|κυρία"
TITLES = "|".join(t for group in (MALE, FEMALE) for t in (group, group.upper()))
#: Tokens with a prefix of their issuer, and the prefixes alone (they stay).
TOKENS = (r"gh[pousr]_[A-Za-z0-9]{16,}+|github_pat_[A-Za-z0-9_]{16,}+|glpat-[A-Za-z0-9_\-]{16,}+|xox[a-z]-[A-Za-z0-9\-]{10,}+"
          r"|sk-(?=[a-z\-]*+[A-Z0-9_]|[a-z]{16})[A-Za-z0-9_\-]{16,}+|[spr]k_(?:live|test)_[A-Za-z0-9]{10,}+|AIza[A-Za-z0-9_\-]{30,}+"
          r"|npm_[A-Za-z0-9]{30,}+|hf_[A-Za-z0-9]{30,}+|pypi-[A-Za-z0-9_\-]{16,}+|ASIA[0-9A-Z]{16}(?![\p{L}\p{N}])"
          r"|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+")
TOKEN_STARTS = "gh[pousr]_|github_pat_|glpat-|xox[a-z]-|sk-|[spr]k_(?:live|test)_|AIza|npm_|hf_|pypi-|ASIA|eyJ"
#: Numbers after a country code, and national ones: area code in
#: brackets, trunk 0 (French pairs; two digits and seven or more; longer area
#: codes; nine digits or more in all, so times and dates are none), 3-3-4 groups.
ABROAD = r"[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?(?:\d{2,4}|\d(?:[ .\-]\d{2,4}){2})(?:[ .\-/]?\d{2,4}){1,4}(?!\d)"
NATIONAL = (r"\((?!(?:19|20)\d\d\))\d{2,5}\)(?: ?/ ?|[ .\-])?(?=(?:[ .\-]?\d){6})\d{2,8}(?:[ .\-]\d{2,6}){0,3}"
            r"|0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4}|[ \-](?:\d{4}[ \-]\d{4}|\d{7,8})|\d{8,9})"
            r"|(?=0(?:[ .\-/]{0,3}\d){8})0[1-9]\d{1,4}(?: ?/ ?|[ .\-])\d{3,8}(?:[ .\-]\d{2,8}){0,3}"
            r"|(?:1[ .\-])?(?:[2-9]\d\d[ .\-]\d{3}[ .\-]\d{4}|\d{3}-\d{3}-\d{4})")
#: Patterns of entities, tried in this order.
PATTERNS = (
    r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}_%+\-]++(?:\.[\p{L}\p{N}_%+\-]++)*+@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)",
    r"(?=[Aeghnprsx])(?<![\p{L}\p{N}])(?:" + TOKENS + ")",
    r"(?<![\p{L}\p{N}+])\+\d{1,3}" + ABROAD,
    r"(?<![\p{L}\p{N}.])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\p{L}\p{N}])",
    r"(?=[0-9(])(?<![\p{L}\p{N}+/])(?<![\p{L}\p{N}]-|\d[.,:])(?:00[1-9]\d{0,2}" + ABROAD + "|(?:" + NATIONAL + r")(?!\d|[.\-/]\d))",
    r"(?<![\p{L}\p{N}])(?:" + TITLES + r")\.?(?: (?!(?:" + TITLES + r")\b)\p{Lu}[\p{L}'’\-]++(?!\p{N})){1,3}",
)
ANY = "|".join(PATTERNS)
#: No entity is in a text without one of these (a quick first look).
HINT = "[@0-9]|AKIA|[a-f]{32}|[A-F]{32}|" + TOKEN_STARTS + "|(?:" + TITLES + r")\.? \p{Lu}"
#: What stays of a phone number: the country code, or the trunk 0 and the next digit.
DIALLED = r"^(?:\+\d{1,3}|00[1-9]\d{0,2}|(?:1[ .\-])?\(?0?\d)"
#: Letters by script, and syllables of surrogate names.
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga go ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi zo", "n", "a"),
    "cyrillic": ("ба бе бо да де до за зо ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви", "н", "а"),
    "greek": ("βα βε βο γα γε δα δε δο θα κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το φα", "ς", "α"),
}


def find(text: Column) -> Column:
    """All entities of a text, in order."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def atoms(found: Column) -> Column:
    """An entity as (kind, value) parts; parts to be kept have no kind."""
    part = lambda kind, v: F.struct(F.lit(kind).cast("string").alias("kind"), v.alias("value"))
    mail = F.array(part("local", F.split_part(found, F.lit("@"), F.lit(1))), part(None, F.lit("@")),
                   part("domain", F.split_part(found, F.lit("@"), F.lit(2))))

    def person(w: Column) -> Column:
        given = F.when(w[0].rlike("^(" + FEMALE + "|" + FEMALE.upper() + r")\.?$"), F.lit("given_f")).otherwise(F.lit("given_m"))
        kinds = lambda i: F.when((i == F.size(w) - 1), F.lit("surname")).otherwise(given)
        return F.flatten(F.transform(w, lambda x, i: F.when(i == 0, F.array(part(None, x))).otherwise(
            F.array(part(None, F.lit(" ")), F.struct(kinds(i).alias("kind"), x.alias("value"))))))

    return (F.when(F.contains(found, F.lit("@")), mail)
            .when(found.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.array(part("ipv4", found)))
            .when(found.rlike(r"^(?:\+|\(|00[1-9](?![0-9A-Fa-f]{29}))"), F.array(part("phone", found)))
            .when(found.rlike(r"^(\d{13,19}|\d{4}([ \-]\d{4}){3})$"), F.array(part("card", found)))
            .when(found.rlike(r"^\d[\d ./\-]{5,30}$"), F.array(part("phone", found)))
            .when(found.rlike("^AKIA[0-9A-Z]{16}$"), F.array(part("key", found)))
            .when(found.rlike("^(?:" + TOKEN_STARTS + ")"), F.array(part("token", found)))
            .when(found.rlike("^[0-9A-Fa-f]+$"), F.array(part("hex", found)))
            .otherwise(let(F.split(found, " "), person)))


def _pick(letters: str, seed: Column, i: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(F.xxhash64(seed, i), F.lit(len(letters))).cast("int") + 1, F.lit(1))


def _redrawn(value: Column, seed: Column, kept: Column, hexed: Column) -> Column:
    """Every letter and digit drawn anew within its class, but for the first
    ``kept`` characters."""
    def one(c: Column, i: Column) -> Column:
        drawn = F.when(c.rlike("[0-9]") & hexed, _pick("0123456789", seed, i)).when(c.rlike("[0-9]"), _pick("0123456789", seed, i))
        drawn = drawn.when(hexed & c.rlike("[a-f]"), _pick("abcdef", seed, i)).when(hexed & c.rlike("[A-F]"), _pick("ABCDEF", seed, i))
        for pattern, letters in ((r"\p{IsCyrillic}", CYRILLIC), (r"\p{IsGreek}", GREEK), (r"\p{L}", LATIN)):
            drawn = drawn.when(c.rlike(pattern) & c.rlike(r"\p{Lu}"), F.upper(_pick(letters, seed, i)))
            drawn = drawn.when(c.rlike(pattern), _pick(letters, seed, i))
        return F.when(i < kept, c).otherwise(drawn.otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _kept_octets(value: Column) -> Column:
    return F.when(value.rlike(r"^(10|127)\."), 1).when(value.rlike(r"^(192\.168|172\.(1[6-9]|2\d|3[01])|169\.254)\."), 2).otherwise(0)


def _address(value: Column, seed: Column) -> Column:
    """An IPv4 address of the same range: loopback and private prefixes stay."""
    drawn = lambda i: F.when(i == 0, F.pmod(F.xxhash64(seed, i), F.lit(223)) + 1).otherwise(F.pmod(F.xxhash64(seed, i), F.lit(256)))
    octet = lambda x, i: F.when(i < _kept_octets(value), x).otherwise(drawn(i).cast("string"))
    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _space(kind: Column, value: Column) -> Column:
    """What an address or phone number shares with all its surrogates, with #
    for each octet or digit that is drawn. Spaces do not overlap."""
    octets = F.transform(F.split(value, r"\."), lambda x, i: F.when(i < _kept_octets(value), x).otherwise(F.lit("#")))
    head = F.regexp_extract(value, DIALLED, 0)
    rest = F.substr(value, F.char_length(head) + 1, F.char_length(value))
    return F.when(kind == "ipv4", F.array_join(octets, ".")).otherwise(F.concat(head, F.regexp_replace(rest, "[0-9]", "#")))


def _permuted(kind: Column, value: Column, space: Column, key: str) -> Column:
    """The surrogate by a keyed permutation of the space: a Feistel network, a
    shift by a constant that is not 0, and the network backwards."""
    base = F.when(kind == "ipv4", F.lit(256)).otherwise(F.lit(10))
    free = F.char_length(F.regexp_replace(space, "[^#]", ""))
    parts = F.when(kind == "ipv4", F.split(value, r"\.")).otherwise(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    parts = F.transform(F.slice(parts, F.size(parts) - free + 1, free), lambda x: x.cast("int"))

    def of(seed: Column) -> Column:
        rounds = F.sequence(F.lit(1), F.lit(FEISTEL))
        told = lambda rest, i: F.pmod(F.xxhash64(seed, i, rest), base)
        int_ = lambda x: F.array(F.pmod(x, base).cast("int"))

        def forth(a: Column, i: Column) -> Column:
            return let(F.slice(a, F.lit(2), free - 1), lambda rest: F.concat(rest, int_(F.get(a, F.lit(0)) + told(rest, i))))

        def back(a: Column, i: Column) -> Column:
            return let(F.slice(a, F.lit(1), free - 1), lambda rest: F.concat(int_(F.get(a, free - 1) - told(rest, FEISTEL + 1 - i)), rest))

        shift = F.pmod(F.xxhash64(seed, F.lit(0)), base - 1) + 1
        shifted = lambda a: F.concat(int_(F.get(a, F.lit(0)) + shift), F.slice(a, F.lit(2), free - 1))
        new = let(F.aggregate(rounds, parts, forth), lambda a: F.aggregate(rounds, shifted(a), back))
        # the n-th # of the space gets the n-th part
        return let(new, lambda a: F.array_join(F.zip_with(F.split(space, "#"), F.transform(a, lambda x: x.cast("string")),
                                                          lambda s, x: F.concat(s, F.coalesce(x, F.lit("")))), ""))

    return let(F.sha2(F.concat_ws("\n", F.lit(key), kind, space), 256), of)


def _card(value: Column, seed: Column) -> Column:
    """Same network digit and grouping; valid by Luhn if the number was."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")

    def closed(body: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.substr(body, F.lit(1), F.char_length(body) - 1), d.cast("string")))
        fits = F.call_function("luhn_check", digits(value))
        return F.coalesce(F.get(F.filter(ends, lambda x: F.call_function("luhn_check", digits(x)) == fits), F.lit(0)), body)

    return let(_redrawn(value, seed, F.lit(1), F.lit(False)), closed)


def _name(kind: Column, value: Column, seed: Column, attempt: Column) -> Column:
    """A name of syllables of the same script, ending by gender."""
    n = F.lit(2) + F.pmod(F.xxhash64(seed), F.lit(2)).cast("int") + (attempt / 8).cast("int")

    def of(script: str) -> Column:
        syllables, male, female = SYLLABLES[script]
        options = F.array(*[F.lit(x) for x in syllables.split()])
        size = len(syllables.split())
        stem = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.get(options, F.pmod(F.xxhash64(seed, i), F.lit(size)).cast("int"))), "")
        return F.concat(stem, F.when(kind == "given_f", F.lit(female)).when(kind == "given_m", F.lit(male)).otherwise(F.lit("")))

    drawn = (F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(value.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin")))
    return F.when((F.upper(value) == value) & (F.char_length(value) > 1), F.upper(drawn)).otherwise(F.initcap(drawn))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate that an atom draws at an attempt."""
    def of(seed: Column) -> Column:
        kept = (F.when(kind == "key", 4).when(kind == "phone", F.char_length(F.regexp_extract(value, DIALLED, 0)))
                .when(kind == "token", F.char_length(F.regexp_extract(value, "^(?:" + TOKEN_STARTS + ")", 0))).otherwise(0))
        tld = F.regexp_extract(value, r"\.[^.]*$", 0)
        host = F.substr(value, F.lit(1), F.char_length(value) - F.char_length(tld))
        plain = _redrawn(F.when(kind == "domain", host).otherwise(value), seed, kept, kind == "hex")
        # short names run out of surrogates of their length: later draws are longer
        longer = F.array_join(F.transform(F.sequence(F.lit(1), (attempt / 4).cast("int")), lambda i: _pick(LATIN, seed, -i)), "")
        plain = F.when(kind.isin("local", "domain") & (attempt >= 4), F.concat(plain, longer)).otherwise(plain)
        return (F.when(kind == "ipv4", _address(value, seed)).when(kind == "card", _card(value, seed))
                .when(kind.isin("given_f", "given_m", "surname"), _name(kind, value, seed, attempt))
                .when(kind == "domain", F.concat(plain, tld)).otherwise(plain))

    return let(F.sha2(F.concat_ws("\n", F.lit(key), kind, attempt.cast("string"), value), 256), of)


def surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value) -> also surrogate; one row per distinct atom, no
    surrogate twice in a kind and none that is an atom itself (in a crowded
    space: none that is its own atom)."""
    now = materialize(found.distinct().withColumn("attempt", F.lit(0)))
    told, spaced = None, now.withColumn("space", F.when(F.col("kind").isin("ipv4", "phone"), _space(F.col("kind"), F.col("value"))))
    free = F.char_length(F.regexp_replace("space", "[^#]", ""))
    room = F.pow(F.when(F.col("kind") == "ipv4", F.lit(256.0)).otherwise(F.lit(10.0)), free)
    crowded = materialize(spaced.where("space IS NOT NULL").groupBy("kind", "space").agg(F.count(F.lit(1)).alias("n")).where(
        (free > 1) & (4 * F.col("n") > room)).select("kind", "space"))
    if not crowded.isEmpty():
        told = materialize(spaced.join(crowded, ["kind", "space"]).select(
            "kind", "value", _permuted(F.col("kind"), F.col("value"), F.col("space"), key).alias("surrogate")))
        now = materialize(spaced.join(crowded, ["kind", "space"], "left_anti").drop("space"))
    real = now.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(MAX_ROUNDS):
        drawn = materialize(now.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("keeper"))
        judged = drawn.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left").withColumn(
            "again", (F.col("value") != F.col("keeper")) | F.col("real").isNotNull() | (
                (F.col("kind") == "ipv4") & (_kept_octets(F.col("value")) != _kept_octets(F.col("surrogate")))))
        judged = materialize(judged.select("kind", "value", "attempt", "surrogate", "again"))
        if judged.where("again").isEmpty():
            drawn = judged.select("kind", "value", "surrogate")
            return drawn.unionByName(told) if told is not None else drawn
        now = judged.select("kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise ValueError("a kind has more atoms than surrogates")


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The rows of ``docs`` with surrogates in the text, and ``n_entities``."""
    # rows with what was found in them are written once, as the search is the cost
    rows = Rounds(docs.sparkSession).write(docs.select(packed(docs), find(col(docs, text_col)).alias("found")))
    rows = rows.select("row_", F.col("row_")[text_col].alias("text"), "found")
    parts = lambda found: F.transform(found, atoms)
    private = rows.where(F.size("found") > 0).withColumn("digest", F.md5("text"))
    asked = materialize(private.select("digest", F.explode(F.flatten(parts(F.col("found")))).alias("a")).select(
        "digest", "a.kind", "a.value").where("kind IS NOT NULL").distinct())
    told = asked.join(surrogates(asked.select("kind", "value"), key), ["kind", "value"])
    name = lambda k, v: F.concat(k, F.lit(":"), v)
    per_text = materialize(told.groupBy("digest").agg(F.map_from_entries(F.collect_list(
        F.struct(name(F.col("kind"), F.col("value")), "surrogate"))).alias("new")))
    told = private.join(per_text, "digest")

    def written(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda a: F.when(a["kind"].isNull(), a["value"]).otherwise(
            F.element_at(F.col("new"), name(a["kind"], a["value"])))), "")

    texts = F.transform(parts(F.col("found")), written)
    gaps = F.split("text", ANY)
    whole = F.array_join(F.zip_with(gaps, F.array_append(texts, F.lit("")), lambda g, t: F.concat(g, t)), "")
    plain = rows.where(~(F.size("found") > 0) | F.col("found").isNull())
    cols = [c for c in docs.columns if c != "n_entities"]
    out = lambda df, text, n: df.select(
        *[text.alias(c) if c == text_col else F.col("row_")[c].alias(c) for c in cols], n.cast("long").alias("n_entities"))
    return out(plain, F.col("text"), F.lit(0)).unionByName(out(told, whole, F.size("found")))
