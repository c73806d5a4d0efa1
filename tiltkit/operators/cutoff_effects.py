"""The jump at every candidate cut-off of a grid with its robust error, in one pass.

For a side with n points, means (mx, my), slope b and t = cut-off - mx, the
line's value at the cut-off is my + b t, and its HC1 variance is

    q = sum w_i^2 e_i^2,   w_i = 1/n + t dx_i / Mxx,   e_i = dy_i - b dx_i

with dx, dy measured from the means. Both factors are polynomials, so q needs
only the centred cross moments M(p, k) = sum dx^p dy^k of order four or less:

    q = E0 / n^2 + 2 t E1 / (n Mxx) + t^2 E2 / Mxx^2,
    E_j = M(j, 2) - 2 b M(j+1, 1) + b^2 M(j+2, 0).

Moments of two sets merge (a binomial shift of each to the common mean), so
rows are summed once per bucket between two grid points and the buckets merged
from either end, as the cut-off search merges its second moments: no candidate
reads the rows again, and no parameters are joined back to them. A bucket sums
powers of the distance from its own grid point (x) and from the model's mean
(y), which keeps the sums well conditioned before they are centred.

A side with fewer than two distinct x has no line of its own. The effect is
then NULL, or by option that of the coefficients of least norm among all that
fit equally well, which is what a pseudo-inverse of the design gives.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import linspace_point
from ..functions.text import stars_from_z
from ..schema import DEFAULT_GRID_POINTS
from ..session import materialize
from .joins import join_null_safe
from .rdd import K_PARAMS, SSE_NOISE, X_RESOLUTION, _bucket, _finite, _grid_columns, _keyed

#: Powers (of x, of y) of the moments kept.
ORDERS = ((2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (4, 0), (3, 1), (2, 2))
FIELDS = ("n", "mx", "my", *(f"m{p}{k}" for p, k in ORDERS), "xlo", "xhi")


def _power(x: Column, n: int) -> Column:
    out = F.lit(1.0)
    for i in range(n):
        out = x if i == 0 else out * x
    return out


def _shifted(moment, p: int, k: int, dx: Column, dy: Column) -> Column:
    """M(p, k) of a set about a point (dx, dy) below its centre; ``moment(i, j)``
    gives its centred moments, with None for those that are zero."""
    terms = None
    for i in range(p + 1):
        for j in range(k + 1):
            m = moment(i, j)
            if m is not None:
                term = m * float(comb(p, i) * comb(k, j)) * _power(dx, p - i) * _power(dy, k - j)
                terms = term if terms is None else terms + term
    return terms


def _moment_of(s: Column):
    return lambda i, j: s["n"] if i + j == 0 else None if i + j == 1 else s[f"m{i}{j}"]


def _merged(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    mx, my = a["mx"] + (b["mx"] - a["mx"]) * b["n"] / n, a["my"] + (b["my"] - a["my"]) * b["n"] / n
    moments = [(_shifted(_moment_of(a), p, k, a["mx"] - mx, a["my"] - my) + _shifted(_moment_of(b), p, k, b["mx"] - mx, b["my"] - my))
               .alias(f"m{p}{k}") for p, k in ORDERS]
    return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), *moments,
                    F.least(a["xlo"], b["xlo"]).alias("xlo"), F.greatest(a["xhi"], b["xhi"]).alias("xhi"))


def _running(stats: Column) -> Column:
    """Merged statistics of the first 1, 2, ... elements of an array."""
    kind = "array<struct<" + ",".join(f"{f}:double" for f in FIELDS) + ">>"
    return F.aggregate(stats, F.array().cast(kind), lambda acc, e: F.when(
        F.size(acc) == 0, F.array(e)).otherwise(F.array_append(acc, _merged(F.element_at(acc, -1), e))).cast(kind))


def _bucket_moments(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, grid, bucket, s): count, means and centred moments per bucket."""
    u, w = F.col("_x") - F.col("_rx"), F.col("_y") - F.col("_ry")
    raw = [(1, 0), (0, 1), *ORDERS]
    sums = d.groupBy(*keys, "_gs", "_ge", "_gn", "_b", "_rx", "_ry").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.min("_x").alias("xlo"), F.max("_x").alias("xhi"),
        *[F.sum(_power(u, p) * _power(w, k)).alias(f"r{p}{k}") for p, k in raw])
    dx, dy = F.col("r10") / F.col("n"), F.col("r01") / F.col("n")
    about = lambda i, j: F.col("n") if i + j == 0 else F.col(f"r{i}{j}")
    moments = [_shifted(about, p, k, -dx, -dy).alias(f"m{p}{k}") for p, k in ORDERS]
    s = F.struct("n", (F.col("_rx") + dx).alias("mx"), (F.col("_ry") + dy).alias("my"), *moments, "xlo", "xhi")
    return sums.select(*keys, "_gs", "_ge", "_gn", "_b", s.alias("s"))


def full_side(c: Column) -> Column:
    """Whether a line can be fit to a side (struct of moments)."""
    spread = c["xhi"] - c["xlo"]
    return F.coalesce((c["n"] >= 2) & (c["m20"] > 0) & (spread > X_RESOLUTION * F.greatest(F.abs(c["xlo"]), F.abs(c["xhi"]))), F.lit(False))


def _candidates(df: DataFrame, y: str, x: str, grid, keys: list[str], checkpoint_input: bool) -> DataFrame:
    """(keys, j, cutoff, L, R): the merged statistics of both sides of every
    candidate; an empty side is NULL."""
    d = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(_finite("_x") & _finite("_y"))
    d = materialize(d) if checkpoint_input else d
    # one row per model: the centre of y, and the default grid
    per_model = d.groupBy(*keys).agg(F.avg("_y").alias("_ry"), F.min("_x").alias("_gs"), F.max("_x").alias("_ge"))
    if grid is None:
        per_model = per_model.withColumn("_gn", F.lit(DEFAULT_GRID_POINTS))
    else:
        if grid[2] < 2:
            raise ValueError("a cut-off grid needs at least two points")
        gs, ge, gn = _grid_columns(grid)
        per_model = per_model.withColumns({"_gs": gs, "_ge": ge, "_gn": gn})
    d = join_null_safe(d, per_model, keys)
    d = d.withColumn("_b", _bucket(F.col("_x"), F.col("_gs"), F.col("_ge"), F.col("_gn")))
    d = d.withColumn("_rx", linspace_point(F.col("_gs"), F.col("_ge"), F.col("_gn"), F.greatest(F.col("_b") - 1, F.lit(0))))
    one = F.struct("_b", "s")
    t = _bucket_moments(d, keys).groupBy(*keys, "_gs", "_ge", "_gn").agg(F.sort_array(F.collect_list(one)).alias("_a"))
    stats = F.transform("_a", lambda e: e["s"])
    t = t.withColumns({"_left": _running(stats), "_right": F.reverse(_running(F.reverse(stats)))})
    # candidates from a bucket to the next one have the statistics through it
    # on their left; before the first bucket the left side is empty
    t = t.select(*keys, "_gs", "_ge", "_gn", "_a", "_left", "_right", F.explode(F.sequence(F.lit(-1), F.size("_a") - 1)).alias("_i"))
    i = F.col("_i")
    lo = F.when(i < 0, F.lit(0)).otherwise(F.get("_a", i)["_b"])
    hi = F.least(F.coalesce(F.get("_a", i + 1)["_b"], F.col("_gn")), F.col("_gn")) - 1
    t = t.select(*keys, "_gs", "_ge", "_gn", F.get("_left", i).alias("L"), F.get("_right", i + 1).alias("R"),
                 F.explode(F.when(hi >= lo, F.sequence(lo, hi))).alias("j"))
    return t.select(*keys, F.col("j").cast("int").alias("j"), linspace_point(F.col("_gs"), F.col("_ge"), F.col("_gn"), F.col("j")).alias("cutoff"), "L", "R")


def _line(c: Column, cutoff: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(is a line, slope, value at the cut-off, squared error, its variance) of a side."""
    full = full_side(c)
    b = F.when(full, c["m11"] / c["m20"])
    t = cutoff - c["mx"]
    e = [c[f"m{j}2"] - 2.0 * b * c[f"m{j + 1}1"] + b * b * c[f"m{j + 2}0"] for j in range(3)]
    exact = (c["n"] == 2) | (e[0] <= SSE_NOISE * c["m02"])  # no error but float noise
    q = F.when(exact, F.lit(0.0)).otherwise(F.greatest(
        e[0] / (c["n"] * c["n"]) + 2.0 * t * e[1] / (c["n"] * c["m20"]) + t * t * e[2] / (c["m20"] * c["m20"]), F.lit(0.0)))
    sse = F.when(c.isNull() | (full & exact), F.lit(0.0)).when(full, e[0]).otherwise(c["m02"])
    return full, b, c["my"] + b * t, sse, F.when(full, q)


def least_norm_effect(L: Column, R: Column, cutoff: Column) -> Column:
    """Coefficient of Z of least norm where a side has one x or none.

    With coefficients (a, z, b, w) the fit is a + b s on the left and
    (a + z) + (b + w) s on the right, s = x - cut-off. A side of one x fixes
    one value, an empty side nothing; the rest is the nearest point to 0.
    """
    one = F.lit(1.0)
    full_l, b_l, at_l, _, _ = _line(L, cutoff)
    full_r, b_r, at_r, _, _ = _line(R, cutoff)
    l, r = L["mx"] - cutoff, R["mx"] - cutoff  # noqa: E741
    cross = one + l * r
    both = (one + l * l) * (2.0 * (one + r * r)) - cross * cross
    return (F.when(full_l & full_r, at_r - at_l)
            .when(R.isNull(), F.lit(0.0))
            .when(full_l, (R["my"] - at_l - b_l * r) / (one + r * r))
            .when(L.isNull() & full_r, at_r / 2.0)
            .when(full_r, at_r / 2.0 - (L["my"] - at_r / 2.0 - l * b_r / 2.0) / (one + l * l))
            .when(L.isNull(), R["my"] / (2.0 * (one + r * r)))
            .otherwise(((one + l * l) * R["my"] - cross * L["my"]) / both))


def cutoff_effects(df: DataFrame, y: str, x: str, grid=None, keys: Sequence[str] = (), least_norm: bool = False,
                   checkpoint_input: bool = True) -> DataFrame:
    """(keys, j, cutoff, nobs, mse, effect_Z, bse_Z, z_Z, stars_Z,
    rank_deficient) of every candidate, per model.

    ``grid`` is (start, stop, num) of a linspace, None for the study's default
    linspace(min x, max x, 101). ``bse_Z`` is the HC1 error (NULL where a side
    has no line, or without residual degrees of freedom). ``least_norm`` fills
    ``effect_Z`` of a rank-deficient candidate by ``least_norm_effect``; else
    it is NULL. Rows are read twice (the centre of y, then the sums) and
    shuffled as partial sums only; NULL is a model of its own.
    """
    keys, df, drop = _keyed(df, keys)
    t = _candidates(df, y, x, grid, keys, checkpoint_input)
    L, R, cutoff = F.col("L"), F.col("R"), F.col("cutoff")
    (full_l, _, at_l, sse_l, q_l), (full_r, _, at_r, sse_r, q_r) = _line(L, cutoff), _line(R, cutoff)
    n = F.coalesce(L["n"], F.lit(0.0)) + F.coalesce(R["n"], F.lit(0.0))
    full = full_l & full_r
    effect = least_norm_effect(L, R, cutoff) if least_norm else F.when(full, at_r - at_l)
    out = t.select(*keys, "j", "cutoff", n.cast("long").alias("nobs"), ((sse_l + sse_r) / n).alias("mse"), effect.alias("effect_Z"),
                   F.when(full & (n > K_PARAMS), F.sqrt(n / (n - K_PARAMS) * (q_l + q_r))).alias("bse_Z"), (~full).alias("rank_deficient"))
    z = F.when(F.col("bse_Z") > 0, F.col("effect_Z") / F.col("bse_Z"))
    out = out.withColumn("z_Z", z).withColumn("stars_Z", stars_from_z("z_Z"))
    return out.select(*keys, "j", "cutoff", "nobs", "mse", "effect_Z", "bse_Z", "z_Z", "stars_Z", "rank_deficient").drop(*drop)
