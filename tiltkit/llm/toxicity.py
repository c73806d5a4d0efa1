"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers are composed into one machine: words become classes
(insult, threat, target, negation, report, other); a negation lowers what
follows it within a few words; a report or an opening quote lowers the rest of
the clause; a target before or after an insult or threat raises it. The composed
machine walks every clause that holds an insult or threat and adds up weights,
so a matched clause is scored, not a word by itself. A target that follows is
seen by the target's machine on the clause read backwards. Threats are verbs
with their endings.

The lexicon is learned: word beginnings of 3 to 12 letters and whole words,
whose log odds between toxic and other training documents are high. Their
support is counted in distinct contexts (neighbouring words), so copies of one
document count once. A logistic curve over three clause sums gives the score.
Learning and scoring split words alike: elided beginnings (l', d', qu'), endings
('s, 're) and outer apostrophes are left out, isn't and the like stay whole.
Learning uses at most about ``TRAIN_TOXIC`` + ``TRAIN_OTHER`` labelled
documents, chosen by a hash of the id; scoring reads every whole text.

Cases: a null or empty text, and any text without a match, has the score of no
match; without toxic training rows every score is 0; documents labelled more
than once count as toxic if one label is; rows with a null id are scored and not
held out; repeated rows are scored each; columns of the input cannot clash; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import col

#: Bounds of the training sample, in documents of each class (about).
TRAIN_TOXIC = 3_000
TRAIN_OTHER = 6_000
#: Lengths of word beginnings, support and least log odds of the lexicon.
SHORTEST, LONGEST = 3, 12
MIN_SUPPORT = 5
MIN_SHARE = 0.01
MIN_ODDS = 2.0
MAX_LEXICON = 4_000
THRESHOLD = 0.7
#: Words of the grammar's other classes, in four languages.
TARGETS = ("you your yours he him she her they them du dich dir ihr euch sie er tu toi te vous il elle ils "
           "usted ustedes ella ellos").split()
NEGATIONS = "not never isn't aren't don't nicht kein keine nie niemals pas jamais nunca jamás tampoco".split()
REPORTS = ("said says say told tells wrote writes claims called quoted sagte sagt schrieb meinte nannte "
           "dit disait écrit appelle dijo dice escribió llamó").split()
#: Verbs of threats by stems, with the endings that they take.
THREAT_VERBS = (
    ("kill hurt punish destroy murder shoot stab beat strangle", " s es ed d ing er"),
    ("töt vernicht schlag erschieß bestraf verprügel", "e en est et t te ten end n"),
    ("tuer frapper", " ai as a ez ons ont"), ("tue frappe détrui", " s t nt re sent rai"),
    ("mat golpe castig", "ar o aré arte arás ando"), ("destru", "ir iré irte yo ye"),
)
THREATS = frozenset(stem + end for stems, ends in THREAT_VERBS for stem in stems.split() for end in ends.split(" "))
THREAT_WEIGHT = 2.5
#: Multipliers and reach (in words) of the grammar.
NEGATED, REPORTED, TARGETED = 0.5, 0.5, 1.5
NEGATION_REACH, TARGET_REACH = 2, 3
CLAUSE_END = ".!?;\n"
#: A word in lower case with straight apostrophes, as learning and scoring read it.
WORD = (r"(?<![\p{L}\p{M}])(?:[\p{L}\p{M}]+n't(?![\p{L}\p{M}])|(?!(?:\p{L}|(?:jus|lors|puis|quoi)?qu)'[\p{L}\p{M}])"
        r"(?!(?<=[\p{L}\p{M}]')(?:s|d|m|re|ve|ll)(?![\p{L}\p{M}]))[\p{L}\p{M}]+)")


def plain(text: str) -> str:
    """Lower case, with straight apostrophes."""
    return text.lower().replace("’", "'")


# --- transducers ------------------------------------------------------------
# A transducer is {state: {symbol: (next state, symbol out, multiplier)}}, with
# "*" for any other symbol (which is given on unchanged); state 0 is the start.

HITS = ("insult", "threat")


def window_after(trigger: str, reach: int, factor: float) -> dict:
    """Hits within ``reach`` symbols after a trigger are multiplied."""
    machine = {0: {trigger: (reach, trigger, 1.0), "*": (0, None, 1.0)}}
    for s in range(1, reach + 1):
        machine[s] = {trigger: (reach, trigger, 1.0), "*": (s - 1, None, 1.0)} | {h: (s - 1, h, factor) for h in HITS}
    return machine


def rest_after(trigger: str, factor: float) -> dict:
    """Hits anywhere after a trigger are multiplied."""
    return {0: {trigger: (1, trigger, 1.0), "*": (0, None, 1.0)},
            1: {"*": (1, None, 1.0)} | {h: (1, h, factor) for h in HITS}}


SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")


def step(machine: dict, state, symbol: str):
    nxt, out, w = machine[state].get(symbol) or machine[state]["*"]
    return nxt, out or symbol, w


def compose(a: dict, b: dict) -> dict:
    """The machine that feeds what ``a`` gives out into ``b``."""
    names, out, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        p, q = at = todo.pop()
        arcs = {}
        for s in SYMBOLS:
            p2, mid, w1 = step(a, p, s)
            q2, end, w2 = step(b, q, mid)
            if (p2, q2) not in names:
                names[p2, q2] = len(names)
                todo.append((p2, q2))
            arcs[s] = (names[p2, q2], end, w1 * w2)
        out[names[at]] = arcs
    return out


def toward_target() -> dict:
    return window_after("target", TARGET_REACH, TARGETED)


def grammar() -> dict:
    return compose(compose(window_after("negation", NEGATION_REACH, NEGATED), rest_after("report", REPORTED)), toward_target())


def factors(machine: dict, symbols: list[str]) -> list[float]:
    """What the machine multiplies each symbol by."""
    state, out = 0, []
    for s in symbols:
        state, _, w = step(machine, state, s)
        out.append(w)
    return out


class Scorer:
    """Scores texts by a lexicon of (beginning, weight); a beginning that ends
    in ``$`` is a whole word."""

    def __init__(self, lexicon: list[tuple[str, float]]):
        import ahocorasick
        import regex

        self.machine, self.target = grammar(), toward_target()
        self.kinds = {w: k for k, ws in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
        self.whole = {w[:-1]: x for w, x in lexicon if w.endswith("$")} | {w: THREAT_WEIGHT for w in THREATS}
        self.starts = {w: x for w, x in lexicon if not w.endswith("$")}
        self.sizes = sorted({len(w) for w in self.starts}, reverse=True)
        self.words = regex.compile(WORD + r"|[\"“„«]")
        self.ends = regex.compile("[" + regex.escape(CLAUSE_END) + "]")
        self.scan = ahocorasick.Automaton()
        for w in {*self.whole, *self.starts}:
            self.scan.add_word(w, len(w))
        self.scan.make_automaton()

    def weight(self, word: str) -> float:
        if word in self.whole:
            return self.whole[word]
        return next((self.starts[word[:n]] for n in self.sizes if word[:n] in self.starts), 0.0)

    def clause(self, text: str) -> float:
        """What the machines add up over one clause."""
        weights, kinds = [], []
        for word in self.words.findall(plain(text)):
            w = self.weight(word)
            weights.append(w)
            kinds.append(("threat" if word in THREATS else "insult") if w else
                         self.kinds.get(word) or ("report" if len(word) == 1 and not word.isalpha() else "other"))
        if not any(weights):
            return 0.0
        whole, before, after = factors(self.machine, kinds), factors(self.target, kinds), factors(self.target, kinds[::-1])[::-1]
        # a target raises once, from either side
        return math.fsum(w * f * (y if y > x else x) / x for w, f, x, y in zip(weights, whole, before, after) if w)

    def sums(self, text: str) -> tuple[float, float, float]:
        """All clause scores, the largest, and all per square root of the
        text's length in words (about). A clause's beginning is sought from
        the end of the last one scored, so the work is linear in the text."""
        low = plain(text)
        scores, done = [], -1
        if len(self.scan):
            for end, size in self.scan.iter(low):
                begin = end - size + 1
                if begin <= done or begin and low[begin - 1].isalpha():
                    continue
                left = max(low.rfind(c, max(done, 0), begin) for c in CLAUSE_END) + 1
                right = self.ends.search(low, end + 1)
                done = right.start() if right else len(low)
                if s := self.clause(low[left:done]):
                    scores.append(s)
        total = math.fsum(scores)
        return total, max(scores, default=0.0), total / math.sqrt(1 + len(low) / 6)


# --- learning ---------------------------------------------------------------

def _held_out(i):
    return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic): labelled documents outside the held-out third, about as
    many of each class as the bounds allow, chosen by a hash of the id."""
    known = labels.where(~_held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda c, most: min(1.0, most / max(1, sizes.get(c, 0)))
    parts = 1 << 20
    limit = F.when(F.col("toxic") == 1, F.lit(int(share(1, TRAIN_TOXIC) * parts))).otherwise(
        F.lit(int(share(0, TRAIN_OTHER) * parts)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(parts)) < limit)
    rows = docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"))
    # about TRAIN_TOXIC + TRAIN_OTHER ids by construction
    return materialize(rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))


def lexicon(train: DataFrame) -> list[tuple[str, float]]:
    """Word beginnings and words with high log odds, at most MAX_LEXICON."""
    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        import regex

        words = regex.compile(WORD)
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                ws = words.findall(plain(text.as_py() or ""))
                seen = {}
                for i, w in enumerate(ws):
                    around = zlib.crc32(f"{ws[i - 1] if i else ''} {ws[i + 1] if i + 1 < len(ws) else ''}".encode())
                    for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
                        seen.setdefault(w[:n], around)
                    seen.setdefault(w + "$", around)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()),
                     pa.array([int(toxic)] * len(seen), pa.int32())], names=["f", "around", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return []
    features = train.mapInArrow(run, "f string, around bigint, toxic int")
    odds = F.log((F.col("pos") + 0.5) / (n_toxic + 1) / ((F.col("neg") + 0.5) / (n_other + 1)))
    counts = features.groupBy("f", "toxic", "around").agg(F.lit(1).alias("one")).groupBy("f").agg(
        F.sum("toxic").cast("double").alias("pos"), F.sum(1 - F.col("toxic")).cast("double").alias("neg"))
    best = counts.where(F.col("pos") >= max(MIN_SUPPORT, MIN_SHARE * n_toxic)).withColumn("w", odds).where(F.col("w") >= MIN_ODDS)
    found = {r["f"]: r["w"] for r in best.orderBy(F.desc(F.col("w") * F.col("pos")), "f").limit(MAX_LEXICON).collect()}

    def shorter(f: str) -> list[str]:
        stem = f.rstrip("$")
        return [stem[:n] for n in range(SHORTEST, len(stem) + f.endswith("$"))]

    # a beginning that is as telling makes the longer ones needless
    return [(f, w) for f, w in found.items() if not any(found.get(s, 0) >= w - 0.3 for s in shorter(f))]


def fit(points: list[tuple[float, float, float, int]]) -> list[float]:
    """Coefficients (constant last) of a logistic curve over the clause sums,
    by Newton steps with a small ridge. The classes weigh as in a full sample,
    whatever their shares in the labels, so the curve is alike at every size."""
    import numpy as np

    data = np.array(points, dtype=float).reshape(-1, 4)
    x, y = np.column_stack([np.log1p(data[:, :3]), np.ones(len(data))]), data[:, 3]
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.array([TRAIN_OTHER, TRAIN_TOXIC]) / np.maximum(n, 1)
    weight = (weight * n.sum() / (weight * n).sum())[y.astype(int)] if n.all() else np.ones(len(y))
    b = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * b
        b -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4), grad)
    return b.tolist()


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(lex: list[tuple[str, float]]) -> Scorer:
    key = tuple(lex)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(lex)
    return _SCORERS[key]


def clause_sums(rows: DataFrame, lex: list[tuple[str, float]]) -> DataFrame:
    """Replaces ``text`` by total, top and per_length."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = _scorer(lex)
        for batch in batches:
            sums = [s.sums(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array([x[i] for x in sums], pa.float64()) for i in range(3))],
                names=[*kept, "total", "top", "per_length"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, total double, top double, per_length double")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    train = training_rows(docs, labels, id_col, text_col)
    lex = lexicon(train)
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).alias("text"))
    if lex:
        points = clause_sums(train.select("text", F.col("toxic").cast("int").alias("toxic")), lex)
        b = fit([(r["total"], r["top"], r["per_length"], r["toxic"]) for r in points.collect()])  # bounded sample
        z = F.lit(b[3])
        for c, w in zip(("total", "top", "per_length"), b):
            z = z + F.lit(w) * F.log1p(c)
        value = F.round(1 / (1 + F.exp(-z)), 9)
    else:
        value = F.lit(0.0)
    return clause_sums(rows, lex).select(
        F.col("id").alias(id_col), _held_out(F.col("id")).alias("held_out"), value.alias("score"),
        (value >= THRESHOLD).cast("int").alias("predicted"))
