"""Exact order statistics per group without sorting a group in one task.

``bracket_quantiles`` reads its input twice and writes no copy of it: a sketch
brackets every target rank, one counting pass tells how many values lie below
a bracket and how often each value inside occurs, and the target is read off
those few rows. ``exact_quantiles`` is a distributed radix select. Every value gets an
order-preserving 64-bit key (``ordered_key``, JVM expressions only). Four
passes each count rows per 16-bit digit of the key, restricted to the
bucket chosen by the previous pass; a running sum over at most 65,536 digit
rows per (group, quantile) picks the bucket that holds the target rank.
Counting is a partial/final aggregation, so a group holding a third of all
rows, or millions of ties, costs no more than a small one, and no window
ever sees more than 65,536 rows. The result is exact (the
value itself, not an interpolation).

Rank rules (0-based target rank r of n sorted values):
  nearest  r = round_half_away((n - 1) * q)   (the study's default)
  lower    r = floor((n - 1) * q)
  higher   r = ceil((n - 1) * q)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ordered_key, round_half_away
from ..session import ensure_checkpoint_dir, materialize
from .joins import join_null_safe

_BITS = 16
_MASK = (1 << _BITS) - 1
_PASSES = 64 // _BITS


def _rank(n: Column, q: Column, rule: str) -> Column:
    pos = (n - 1).cast("double") * q
    if rule == "nearest":
        r = round_half_away(pos, 0)
    elif rule == "lower":
        r = F.floor(pos)
    elif rule == "higher":
        r = F.ceil(pos)
    else:
        raise ValueError(f"unknown rank rule {rule!r}")
    return F.least(F.greatest(r.cast("long"), F.lit(0).cast("long")), (n - 1).cast("long"))


def target_rank(n, q: float, rule: str = "nearest") -> Column:
    """0-based rank of quantile q among n values, clamped to [0, n-1]."""
    n = F.col(n) if isinstance(n, str) else n
    return _rank(n, F.lit(float(q)), rule)


def _digit(k: Column, i: int) -> Column:
    return F.shiftrightunsigned(k, 64 - _BITS * (i + 1)).bitwiseAND(F.lit(_MASK).cast("long"))


def _prefix(k: Column, i: int) -> Column:
    """Top 16*i bits of the key (i >= 1)."""
    return F.shiftrightunsigned(k, 64 - _BITS * i)


def _choose(hist: DataFrame, keys: list[str]) -> DataFrame:
    """For every (group, q) the digit whose running count covers the rank r.

    ``hist`` holds (group, q, _r, _p, _d, _c, _vmin); the window sees at most
    2**16 digit rows per (group, q).
    """
    w = Window.partitionBy(*keys, "q").orderBy("_d").rowsBetween(Window.unboundedPreceding,
                                                                 Window.currentRow)
    j = hist.withColumn("_cum", F.sum("_c").over(w))
    hit = j.where((F.col("_cum") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_cum")))
    return hit.select(
        *keys, "q",
        (F.col("_r") - (F.col("_cum") - F.col("_c"))).alias("_r"),
        F.shiftleft(F.col("_p"), _BITS).bitwiseOR(F.col("_d")).alias("_p"),
        F.col("_vmin"),
        F.col("_c"),
    )


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    qs: Sequence[float], rule: str = "nearest", with_stats: bool = False) -> DataFrame:
    """Long result (group..., q, value[, n, total]) of exact quantiles per group.

    NULL and NaN values are ignored. The (group, value, key) rows are written
    once with a reliable ``checkpoint()`` (the session's checkpoint folder),
    so the four counting passes re-read them instead of recomputing the
    input, and lineage is cut. The per-pass chosen-bucket tables (groups x
    len(qs) rows) are checkpointed as well; their joins are left to the
    planner. This function runs Spark jobs (the checkpoints).
    """
    if rule not in ("nearest", "lower", "higher"):
        raise ValueError(f"unknown rank rule {rule!r}")
    keys = list(group_cols)
    ensure_checkpoint_dir(df.sparkSession)
    data = (
        df.select(*keys, F.col(value_col).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_k", ordered_key("_v"))
        .checkpoint(eager=True)
    )
    # pass 0: top-digit histogram; group sizes and totals come with it
    h0 = data.groupBy(*keys, _digit(F.col("_k"), 0).alias("_d")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_vmin"), F.sum("_v").alias("_s")
    ).checkpoint(eager=True)
    stats = h0.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum("_s").alias("total"))
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    cand = stats.select(*keys, "n", F.explode(qarr).alias("q")).select(
        *keys, "q", _rank(F.col("n"), F.col("q"), rule).alias("_r"),
        F.lit(0).cast("long").alias("_p"))
    hist = join_null_safe(h0.drop("_s"), cand, keys)
    chosen = _choose(hist, keys).checkpoint(eager=True)

    for i in range(1, _PASSES):
        # rows of the chosen bucket, once per quantile that chose it
        sel = chosen.select(*keys, "q", "_r", F.col("_p").alias("_sel"))
        rows = join_null_safe(data.withColumn("_sel", _prefix(F.col("_k"), i)), sel,
                              [*keys, "_sel"])
        hist = rows.groupBy(*keys, "q", "_r", F.col("_sel").alias("_p"),
                            _digit(F.col("_k"), i).alias("_d")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_vmin"))
        chosen = _choose(hist, keys).checkpoint(eager=True)

    out = chosen.select(*keys, "q", F.col("_vmin").alias("value"))
    if with_stats:
        out = join_null_safe(out, stats, keys)
    return out


#: Groups whose brackets are broadcast, and rows of a bracket one window sees.
MOST_GROUPS = 100_000
WINDOW_ROWS = 1 << (_BITS)


def bracket_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, qs: Sequence[float], rule: str = "nearest",
                      with_stats: bool = False, accuracy: int = 10_000, slack: float = 3.0) -> DataFrame:
    """Long result (group..., q, value[, n, total]) of exact quantiles per group,
    as ``exact_quantiles`` gives, from two reads of ``df``.

    Read 1 takes per group the count, the total and, from one sketch of rank
    error 1 / ``accuracy``, values ``slack`` times that error below and above
    each quantile. Read 2 counts the values below each such bracket and each
    value inside it (partial sums first), so what is kept is a few
    ten-thousandths of a large group; a group of at most 2 * ``accuracy`` rows
    is kept whole, as (value, count). The target rank's value is found by a
    running count where a bracket has few distinct values, else by radix select
    over them. Should a bracket miss its rank, its group is read again with a
    bracket eight times as wide. NULL and NaN values are ignored; NULL is a
    group of its own. Runs jobs: all but the last step.
    """
    keys = list(group_cols)
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(*keys, (F.col(value_col).cast("double") + 0.0).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    found, stats, delta = [], None, slack / accuracy
    pending = rows
    while True:
        info, solved, missed = _bracketed(pending, keys, [float(q) for q in qs], rule, accuracy, delta)
        stats = info if stats is None else stats
        found.append(solved)
        if missed is None:
            break
        delta = max(8 * delta, 1 / accuracy)
        pending = join_null_safe(rows, missed, keys)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return join_null_safe(out, stats.select(*keys, "n", "total"), keys) if with_stats else out


def _bracketed(rows: DataFrame, keys: list[str], qs: list[float], rule: str, accuracy: int,
               delta: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(statistics per group, quantiles found, groups with a missed rank or None)."""
    at = [p for q in qs for p in (max(q - delta, 0.0), min(q + delta, 1.0))]
    stats = materialize(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.percentile_approx("_v", at, accuracy).alias("_at")))
    whole = F.col("n") <= 2 * accuracy
    none = F.lit(None).cast("double")
    # one bracket without ends for a small group, else one per quantile; ends at 0 and 1 are open
    ends = [F.struct(F.lit(i).alias("_b"), (F.get("_at", F.lit(2 * i)) if at[2 * i] > 0 else none).alias("_lo"),
                     (F.get("_at", F.lit(2 * i + 1)) if at[2 * i + 1] < 1 else none).alias("_hi")) for i in range(len(qs))]
    open_ends = F.array(F.struct(F.lit(0).alias("_b"), none.alias("_lo"), none.alias("_hi")))
    brackets = stats.select(*keys, F.inline(F.when(whole, open_ends).otherwise(F.array(*ends))))
    if stats.count() <= MOST_GROUPS:
        brackets = F.broadcast(brackets)
    inside = F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))
    counted = join_null_safe(rows, brackets, keys).where(F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    counted = materialize(counted.groupBy(*keys, "_b", F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    targets = stats.select(*keys, "n", F.when(whole, F.lit(0)).otherwise(F.lit(-1)).alias("_one"), F.posexplode(
        F.array(*[F.lit(q) for q in qs])).alias("_i", "q")).select(
        *keys, "q", F.when(F.col("_one") == 0, F.lit(0)).otherwise(F.col("_i")).alias("_b"), _rank(F.col("n"), F.col("q"), rule).alias("_r"))
    sizes = counted.groupBy(*keys, "_b").agg(
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))), F.lit(0)).alias("_inside"),
        F.count("_v").alias("_distinct"))
    placed = materialize(join_null_safe(targets, sizes, [*keys, "_b"]).withColumn("_r", F.col("_r") - F.col("_below")))
    hit = (F.col("_r") >= 0) & (F.col("_r") < F.col("_inside"))
    n_missed, most = placed.agg(F.count(F.when(~hit, 1)), F.max("_distinct")).first()
    values, within = counted.where("_v IS NOT NULL"), placed.where(hit).select(*keys, "_b", "q", "_r")
    if (most or 0) <= WINDOW_ROWS:
        running = F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cum = values.withColumn("_cum", running)
        met = join_null_safe(cum, within, [*keys, "_b"]).where((F.col("_cum") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_cum")))
        solved = met.select(*keys, "q", F.col("_v").alias("value"))
    else:
        solved = _by_digits(values, [*keys, "_b"], within).select(*keys, "q", F.col("_vmin").alias("value"))
    # NULL keys: groups are told apart null-safe where they are read again
    missed = placed.where(~hit).select(*keys).distinct() if n_missed else None
    if missed is not None:  # all quantiles of such a group are found anew
        gone = missed.withColumn("_gone", F.lit(True))
        cond = None
        for k in keys:
            e = solved[k].eqNullSafe(gone[k])
            cond = e if cond is None else cond & e
        solved = solved.join(gone, cond, "left_anti")
    return stats, solved, missed


def _by_digits(values: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """(keys, q, _vmin): the value of each target rank among counted values
    (keys, _v, _c), digit by digit of the ordered key."""
    data = values.withColumn("_k", ordered_key("_v"))
    chosen = targets.select(*keys, "q", "_r", F.lit(0).cast("long").alias("_p"))
    for i in range(_PASSES):
        sel = chosen.select(*keys, "q", "_r", F.col("_p").alias("_sel"))
        rows = join_null_safe(data.withColumn("_sel", _prefix(F.col("_k"), i) if i else F.lit(0).cast("long")), sel, [*keys, "_sel"])
        hist = rows.groupBy(*keys, "q", "_r", F.col("_sel").alias("_p"), _digit(F.col("_k"), i).alias("_d")).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_vmin"))
        chosen = materialize(_choose(hist, keys))
    return chosen


def approx_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                     qs: Sequence[float], accuracy: int = 10000, with_stats: bool = False) -> DataFrame:
    """percentile_approx per group (rank error <= n / accuracy), long form;
    count and total come from the same single aggregation when ``with_stats``."""
    keys = list(group_cols)
    v = F.col(value_col).cast("double")
    aggs = [F.percentile_approx(v, [float(q) for q in qs], accuracy).alias("_vals")]
    if with_stats:
        aggs += [F.count(F.lit(1)).alias("n"), F.sum(v).alias("total")]
    agg = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(*aggs)
    extra = ["n", "total"] if with_stats else []
    return agg.select(*keys, *extra, F.posexplode("_vals").alias("_i", "value")).select(
        *keys, F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i") + 1).alias("q"),
        "value", *extra)


def rank_errors(df: DataFrame, group_cols: Sequence[str], value_col: str, quantiles: DataFrame,
                accuracy: int = 10000) -> DataFrame:
    """(group..., q, n, within): whether each approximate quantile lies within
    n / accuracy ranks of its target rank (n - 1) * q, by counting."""
    keys = list(group_cols)
    rows = df.select(*keys, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    j = join_null_safe(rows, quantiles.select(*keys, "q", F.col("value").alias("_q")), keys)
    c = j.groupBy(*keys, "q").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("_v") < F.col("_q")).cast("long")).alias("_lt"),
        F.sum((F.col("_v") <= F.col("_q")).cast("long")).alias("_le"))
    target, slack = (F.col("n") - 1) * F.col("q"), F.col("n") / accuracy + 1
    within = (F.col("_lt") <= target + slack) & (F.col("_le") - 1 >= target - slack)
    return c.select(*keys, "q", "n", within.alias("within"))


def wide_quantiles(long: DataFrame, group_cols: Sequence[str], qs: Sequence[float],
                   names: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Long (group, q, value) -> one column per quantile (conditional aggregation)."""
    aggs = [F.first(F.when(F.col("q") == float(q), F.col("value")), ignorenulls=True).alias(nm)
            for q, nm in zip(qs, names)]
    aggs += [F.first(c).alias(c) for c in extra]
    return long.groupBy(*group_cols).agg(*aggs)
