"""Sharp regression discontinuity with a global linear specification.

    y ~ Z + Xc + Z:Xc,   Z = 1{x >= c},  Xc = x - c

The model is fully interacted, so its OLS fit is two simple regressions of
y on Xc, one per side: Intercept = a_L, Xc = b_L, Z = a_R - a_L,
Z:Xc = b_R - b_L. Everything is grouped sums over any number of models at
once (model keys are group keys):

  pass 1  per (model, side): n, means, min/max x and centred moments
          (Spark's stable var_pop / covar_pop) -> slopes, intercepts, SSE, SST
  pass 2  residual sums for the robust covariance (HC1, or per-cluster
          scores for the cluster-robust one)

Every pass joins back a parameter table with one row per (model, side).
Model keys may be NULL; NULL is a model of its own.

The cut-off search fits all candidates of a grid in one pass: rows are
bucketed between consecutive grid points, the six centred sums are
aggregated per bucket, and merging the (at most grid+1) buckets from either
end gives the statistics left and right of every candidate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import linspace_point
from ..functions.stats import with_pvalue as add_pvalue
from ..functions.text import stars_from_z
from ..schema import DEFAULT_GRID_POINTS, FITTED_POINTS, TERMS
from ..session import materialize
from .joins import join_null_safe

K_PARAMS = 4
# Relative tolerance of equal MSEs in the cut-off search, and the relative
# spread of x below which a side holds one x value only.
TIE = 1e-9
X_RESOLUTION = 1e-13
# A side whose squared residuals are a smaller part of its variation is fit exactly.
SSE_NOISE = 1e-12


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[list[str], DataFrame, list[str]]:
    """Model keys; a single model gets a constant key so every step stays a keyed join."""
    keys = list(keys)
    if keys:
        return keys, df, []
    return ["_model"], df.withColumn("_model", F.lit(0)), ["_model"]


def _finite(c: str) -> Column:
    """Rows the fit uses: NULL, NaN and +-inf are dropped (as the study drops
    its +-inf / NaN rows before fitting)."""
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def _lit_or_col(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.lit(float(v))


def _model_table(df: DataFrame, y: str, x: str, cutoff, keys: Sequence[str],
                 cluster: str | None) -> DataFrame:
    cols = [*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
            _lit_or_col(cutoff).cast("double").alias("_c")]
    if cluster is not None:
        cols.append(F.col(cluster).alias("_g"))
    d = df.select(*cols).where(_finite("_x") & _finite("_y"))
    return d.withColumns({"_z": (F.col("_x") >= F.col("_c")).cast("int"),
                          "_xc": F.col("_x") - F.col("_c")})


def _side(col: str, z: int) -> Column:
    return F.max(F.when(F.col("_z") == z, F.col(col)))


def fit_wide(df: DataFrame, y: str, x: str, cutoff, keys: Sequence[str] = (),
             cluster: str | None = None, checkpoint_input: bool = True) -> DataFrame:
    """One row per model: cutoff, nobs, side coefficients, robust variances, fit stats.

    The (model, x, y) rows are checkpointed once (a Spark job), so the two
    passes read them instead of recomputing the input; pass
    ``checkpoint_input=False`` when ``df`` is already checkpointed. The
    per-(model, side) parameter tables are joined back null-safe (a NULL
    model key is a model of its own), by the planner's choice.

    ``cutoff`` is a number, a column name or a Column (per-model cut-offs).
    Variances are HC1 (k = 4), or cluster-robust with the
    G/(G-1) * (n-1)/(n-k) correction when ``cluster`` names a column.
    A side with fewer than two distinct x values has NULL coefficients; a
    side of exactly two points is fit exactly (zero residuals), and a term
    whose standard error is 0 gets a NULL z.
    """
    keys, df, drop = _keyed(df, keys)
    d = _model_table(df, y, x, cutoff, keys, cluster)
    d = materialize(d) if checkpoint_input else d
    n = F.count(F.lit(1))
    p2 = d.groupBy(*keys, "_z").agg(
        n.alias("_n"), F.avg("_xc").alias("_mx"), F.avg("_y").alias("_my"),
        F.min("_x").alias("_xmin"), F.max("_x").alias("_xmax"), F.first("_c").alias("_cut"),
        (F.var_pop("_xc") * n).alias("_sxx"), (F.covar_pop("_xc", "_y") * n).alias("_sxy"),
        (F.var_pop("_y") * n).alias("_syy"))
    ok = (F.col("_n") >= 2) & (F.col("_xmax") > F.col("_xmin"))
    b = F.when(ok, F.col("_sxy") / F.col("_sxx"))
    p2 = p2.withColumns({"_b": b, "_a": F.col("_my") - b * F.col("_mx")})
    p2 = p2.withColumn("_sse", F.when(F.col("_b").isNotNull(),
                                      F.col("_syy") - F.col("_b") * F.col("_sxy"))
                       .otherwise(F.col("_syy")))

    # pass 2: residual sums with the side parameters joined back
    j2 = join_null_safe(d, p2.select(*keys, "_z", "_n", "_mx", "_my", "_sxx", "_b"), [*keys, "_z"])
    dx = F.col("_xc") - F.col("_mx")
    fitted = F.col("_b").isNotNull()
    # a side of two points is fit exactly: its residuals are 0, not float noise
    e = F.when(F.col("_n") == 2, F.lit(0.0)).otherwise((F.col("_y") - F.col("_my")) - F.col("_b") * dx)
    w0 = F.when(fitted, 1.0 / F.col("_n") - F.col("_mx") * dx / F.col("_sxx"))
    w1 = F.when(fitted, dx / F.col("_sxx"))
    if cluster is None:
        p3 = j2.groupBy(*keys, "_z").agg(F.sum(w0 * w0 * e * e).alias("_m0"),
                                         F.sum(w1 * w1 * e * e).alias("_m1"))
        var = p3.groupBy(*keys).agg(
            _side("_m0", 0).alias("_v_aL"), _side("_m1", 0).alias("_v_bL"),
            _side("_m0", 1).alias("_v_aR"), _side("_m1", 1).alias("_v_bR"))
        var = var.withColumn("_clusters", F.lit(None).cast("long"))
    else:
        z0, z1 = F.col("_z") == 0, F.col("_z") == 1
        sc = j2.groupBy(*keys, "_g").agg(
            F.coalesce(F.sum(F.when(z0, w0 * e)), F.lit(0.0)).alias("_saL"),
            F.coalesce(F.sum(F.when(z0, w1 * e)), F.lit(0.0)).alias("_sbL"),
            F.coalesce(F.sum(F.when(z1, w0 * e)), F.lit(0.0)).alias("_saR"),
            F.coalesce(F.sum(F.when(z1, w1 * e)), F.lit(0.0)).alias("_sbR"))
        var = sc.groupBy(*keys).agg(
            F.sum(F.col("_saL") ** 2).alias("_q_int"),
            F.sum((F.col("_saR") - F.col("_saL")) ** 2).alias("_q_z"),
            F.sum(F.col("_sbL") ** 2).alias("_q_xc"),
            F.sum((F.col("_sbR") - F.col("_sbL")) ** 2).alias("_q_zxc"),
            F.count(F.lit(1)).alias("_clusters"))

    sides = p2.groupBy(*keys).agg(
        *[_side(c, z).alias(f"{c}{s}") for c in ("_n", "_a", "_b", "_mx", "_my", "_syy", "_sse", "_xmin", "_xmax")
          for z, s in ((0, "L"), (1, "R"))],
        F.first("_cut").alias("cutoff"))
    w = join_null_safe(sides, var, keys)
    nL, nR = F.coalesce(F.col("_nL"), F.lit(0)), F.coalesce(F.col("_nR"), F.lit(0))
    n = (nL + nR).cast("long")
    ybar = (F.coalesce(F.col("_myL") * nL, F.lit(0.0)) + F.coalesce(F.col("_myR") * nR, F.lit(0.0))) / n
    sst = (F.coalesce(F.col("_syyL") + nL * (F.col("_myL") - ybar) ** 2, F.lit(0.0))
           + F.coalesce(F.col("_syyR") + nR * (F.col("_myR") - ybar) ** 2, F.lit(0.0)))
    sse = F.coalesce(F.col("_sseL"), F.lit(0.0)) + F.coalesce(F.col("_sseR"), F.lit(0.0))
    w = w.withColumns({"nobs": n, "_sst": sst, "_sse_all": sse})
    r2 = 1.0 - F.col("_sse_all") / F.col("_sst")
    dfr = (F.col("nobs") - K_PARAMS).cast("double")
    w = w.withColumns({
        "rsquared": F.when(F.col("_sst") > 0, r2),
        "rsquared_adj": F.when((F.col("_sst") > 0) & (dfr > 0),
                               1.0 - (F.col("nobs") - 1).cast("double") / dfr * (1.0 - r2)),
        "xmin": F.least("_xminL", "_xminR"), "xmax": F.greatest("_xmaxL", "_xmaxR"),
    })
    # coefficients (intercepts are at Xc = 0, i.e. at the cut-off)
    coef = {"Intercept": F.col("_aL"), "Z": F.col("_aR") - F.col("_aL"),
            "Xc": F.col("_bL"), "Z:Xc": F.col("_bR") - F.col("_bL")}
    if cluster is None:
        c = F.when(dfr > 0, F.col("nobs").cast("double") / dfr)
        var_t = {"Intercept": c * F.col("_v_aL"), "Z": c * (F.col("_v_aL") + F.col("_v_aR")),
                 "Xc": c * F.col("_v_bL"), "Z:Xc": c * (F.col("_v_bL") + F.col("_v_bR"))}
    else:
        g = F.col("_clusters").cast("double")
        c = F.when((g > 1) & (dfr > 0), g / (g - 1.0) * (F.col("nobs") - 1).cast("double") / dfr)
        var_t = {"Intercept": c * F.col("_q_int"), "Z": c * F.col("_q_z"),
                 "Xc": c * F.col("_q_xc"), "Z:Xc": c * F.col("_q_zxc")}
    out = w.select(
        *keys, "cutoff", "nobs", "rsquared", "rsquared_adj", "xmin", "xmax",
        F.col("_clusters").alias("clusters"),
        *[coef[t].alias(f"coef_{t}") for t in TERMS],
        *[F.when(coef[t].isNotNull() & (var_t[t] >= 0), F.sqrt(var_t[t])).alias(f"bse_{t}") for t in TERMS],
        F.col("_aL").alias("a_left"), F.col("_bL").alias("b_left"),
        F.col("_aR").alias("a_right"), F.col("_bR").alias("b_right"),
    )
    return out.drop(*drop)


def coefficients(wide: DataFrame, keys: Sequence[str] = (), with_pvalue: bool = True) -> DataFrame:
    """Long coefficient table: one row per (model, term) with coef, bse, z, p, stars."""
    keys = list(keys)
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), F.lit(i).alias("term_index"),
                 F.col(f"coef_{t}").alias("coef"), F.col(f"bse_{t}").alias("bse"))
        for i, t in enumerate(TERMS)]))
    long = wide.select(*keys, "cutoff", "nobs", "rsquared", "rsquared_adj", rows.alias("_t")).select(
        *keys, "cutoff", "_t.term", "_t.coef", "_t.bse", "nobs", "rsquared", "rsquared_adj")
    long = long.withColumn("z", F.when(F.col("bse") > 0, F.col("coef") / F.col("bse")))
    # stars by the critical values of |z|: the long p-value expression is
    # evaluated only where the p-value itself is asked for
    long = long.withColumn("stars", stars_from_z("z"))
    return add_pvalue(long, "z", "pval") if with_pvalue else long


def fitted_line(wide: DataFrame, keys: Sequence[str] = (), points: int = FITTED_POINTS) -> DataFrame:
    """Fitted values on ``points`` equally spaced x from min to max, per model."""
    keys = list(keys)
    g = wide.select(*keys, "cutoff", "xmin", "xmax", "a_left", "b_left", "a_right", "b_right",
                    F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = linspace_point(F.col("xmin"), F.col("xmax"), F.lit(points), F.col("i"))
    g = g.withColumn("x", x).withColumn("_xc", F.col("x") - F.col("cutoff"))
    yhat = F.when(F.col("x") >= F.col("cutoff"), F.col("a_right") + F.col("b_right") * F.col("_xc")) \
        .otherwise(F.col("a_left") + F.col("b_left") * F.col("_xc"))
    return g.select(*keys, "i", "x", yhat.alias("yhat"))


# ------------------------------------------------------------ cut-off search

def _grid_columns(grid) -> tuple[Column, Column, Column]:
    start, stop, num = grid
    return F.lit(float(start)), F.lit(float(stop)), F.lit(int(num))


def _bucket(x: Column, start: Column, stop: Column, num: Column) -> Column:
    """Number of grid points <= x (exact against the actual grid values)."""
    step = (stop - start) / (num - 1).cast("double")
    raw = F.floor((x - start) / step) + 1
    est = F.when(x < start, F.lit(0)).when(x >= stop, num).otherwise(
        F.least(F.greatest(raw, F.lit(0)), num)).cast("int")
    pt = lambda k: linspace_point(start, stop, num, k)
    down = F.when((est >= 1) & (pt(est - 1) > x), est - 1).otherwise(est)
    up = F.when((down <= num - 1) & (pt(down) <= x), down + 1).otherwise(down)
    return F.when(step == 0, F.when(x >= start, num).otherwise(F.lit(0))).otherwise(up)


def cutoff_curve(df: DataFrame, y: str, x: str, grid=None, keys: Sequence[str] = (),
                 checkpoint_input: bool = True) -> DataFrame:
    """In-sample MSE and jump for every candidate cut-off of a grid, per model.

    ``grid`` is (start, stop, num) of a linspace; None uses the study's
    default linspace(min x, max x, 101) per model. Returns
    (keys, j, cutoff, mse, effect_Z, rank_deficient): ``effect_Z`` is NULL
    and ``rank_deficient`` true when a side has fewer than two distinct x
    (the MSE is still the least-squares one).

    Two shuffles: (1) rows are bucketed between grid points and each bucket
    keeps its count, means and centred second moments (Spark's stable
    var_pop / covar_pop); (2) a model's buckets (grid + 1 at most) are merged
    pairwise from the left and from the right, without any subtraction of
    sums, and every non-empty bucket emits the candidates up to the next one.
    Work is O(rows + grid), never rows x grid.
    """
    keys, df, drop = _keyed(df, keys)
    d = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
        .where(_finite("_x") & _finite("_y"))
    d = materialize(d) if checkpoint_input else d
    if grid is None:
        m = d.groupBy(*keys).agg(F.min("_x").alias("_gs"), F.max("_x").alias("_ge")) \
            .withColumn("_gn", F.lit(DEFAULT_GRID_POINTS))
        d = join_null_safe(d, m, keys)
    else:
        gs, ge, gn = _grid_columns(grid)
        if grid[2] < 2:
            raise ValueError("a cut-off grid needs at least two points")
        d = d.withColumns({"_gs": gs, "_ge": ge, "_gn": gn})
    d = d.withColumn("_b", _bucket(F.col("_x"), F.col("_gs"), F.col("_ge"), F.col("_gn")))
    bk = d.groupBy(*keys, "_b", "_gs", "_ge", "_gn").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"),
        (F.var_pop("_x") * F.count(F.lit(1))).alias("mxx"),
        (F.var_pop("_y") * F.count(F.lit(1))).alias("myy"),
        (F.covar_pop("_x", "_y") * F.count(F.lit(1))).alias("mxy"),
        F.min("_x").alias("xlo"), F.max("_x").alias("xhi"))

    # at most grid + 1 buckets per model, in order
    names = ("n", "mx", "my", "mxx", "myy", "mxy", "xlo", "xhi")
    one = F.struct("_b", F.struct(F.col("n").cast("double").alias("n"), *names[1:]).alias("s"))
    t = bk.groupBy(*keys, "_gs", "_ge", "_gn").agg(F.sort_array(F.collect_list(one)).alias("_a"))
    stats = F.transform("_a", lambda e: e["s"])
    t = t.withColumns({"_left": _running(stats), "_right": F.reverse(_running(F.reverse(stats)))})
    # candidates j in [b, next bucket) use the prefix through b; before the
    # first non-empty bucket the left side is empty
    last = F.size("_a") - 1
    at = F.explode(F.sequence(F.lit(-1), last)).alias("_i")
    t = t.select(*keys, "_gs", "_ge", "_gn", "_a", "_left", "_right", at)
    i = F.col("_i")
    lo = F.when(i < 0, F.lit(0)).otherwise(F.get("_a", i)["_b"])
    hi = F.least(F.coalesce(F.get("_a", i + 1)["_b"], F.col("_gn")), F.col("_gn")) - 1
    t = t.select(*keys, "_gs", "_ge", "_gn", F.get("_left", i).alias("L"), F.get("_right", i + 1).alias("R"),
                 F.explode(F.when(hi >= lo, F.sequence(lo, hi))).alias("j"))
    t = t.withColumn("cutoff", linspace_point(F.col("_gs"), F.col("_ge"), F.col("_gn"), F.col("j")))

    def side(s: str) -> tuple[Column, Column, Column]:
        """(SSE, value at the cut-off, whether a line can be fit) of one side."""
        c = F.col(s)
        spread = c["xhi"] - c["xlo"]
        full = F.coalesce((c["n"] >= 2) & (c["mxx"] > 0)
                          & (spread > X_RESOLUTION * F.greatest(F.abs(c["xlo"]), F.abs(c["xhi"]))), F.lit(False))
        slope = F.when(full, c["mxy"] / c["mxx"])
        line = c["myy"] - slope * c["mxy"]
        sse = (F.when(c.isNull() | (full & (line <= SSE_NOISE * c["myy"])), F.lit(0.0))
               .when(full, line).otherwise(c["myy"]))
        return sse, c["my"] + slope * (F.col("cutoff") - c["mx"]), full

    (sse_l, at_l, ok_l), (sse_r, at_r, ok_r) = side("L"), side("R")
    n = F.coalesce(F.col("L")["n"], F.lit(0.0)) + F.coalesce(F.col("R")["n"], F.lit(0.0))
    return t.select(
        *keys, F.col("j").cast("int").alias("j"), "cutoff", ((sse_l + sse_r) / n).alias("mse"),
        F.when(ok_l & ok_r, at_r - at_l).alias("effect_Z"), (~(ok_l & ok_r)).alias("rank_deficient")).drop(*drop)


def _merged(a: Column, b: Column) -> Column:
    """Count, means, centred moments and range of two sets together: only
    additions of like-signed terms, so a narrow side loses nothing."""
    n = a["n"] + b["n"]
    dx, dy, w = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * b["n"] / n
    return F.struct(
        n.alias("n"), (a["mx"] + dx * b["n"] / n).alias("mx"), (a["my"] + dy * b["n"] / n).alias("my"),
        (a["mxx"] + b["mxx"] + dx * dx * w).alias("mxx"), (a["myy"] + b["myy"] + dy * dy * w).alias("myy"),
        (a["mxy"] + b["mxy"] + dx * dy * w).alias("mxy"),
        F.least(a["xlo"], b["xlo"]).alias("xlo"), F.greatest(a["xhi"], b["xhi"]).alias("xhi"))


def _running(stats: Column) -> Column:
    """Merged statistics of the first 1, 2, ... elements of an array."""
    kind = "array<struct<n:double,mx:double,my:double,mxx:double,myy:double,mxy:double,xlo:double,xhi:double>>"
    return F.aggregate(stats, F.array().cast(kind), lambda acc, e: F.when(
        F.size(acc) == 0, F.array(e)).otherwise(F.array_append(acc, _merged(F.element_at(acc, -1), e))).cast(kind))


def optimal_cutoff(curve: DataFrame, keys: Sequence[str] = (), tie: float = TIE) -> DataFrame:
    """Candidate with the smallest MSE per model. Candidates within the
    relative tolerance ``tie`` of it are ties (equal but for float noise), and
    the first of the grid wins, as a strict '<' scan would pick."""
    keys, curve, drop = _keyed(curve, keys)
    least = F.min("mse").over(Window.partitionBy(*keys))  # a grid's rows per model
    row = F.struct("j", "cutoff", "mse", "effect_Z", "rank_deficient")
    near = curve.withColumn("_least", least).where(F.col("mse") <= F.col("_least") * (1 + tie))
    best = near.groupBy(*keys).agg(F.min_by(row, F.col("j")).alias("_best"))
    return best.select(*keys, "_best.*").drop(*drop)
