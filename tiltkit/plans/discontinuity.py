"""Registered discontinuity queries (fits, cut-off search, fitted line) and
their brute-force DuckDB formulations (regr_* per side and candidate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imbalance as imb
from ..operators import rdd
from ..operators.cutoff_effects import cutoff_effects
from ..functions.stats import erfc_sql
from ..schema import RDD_CLASSES, Z_CRIT, dollar_col
from . import catalog as C
from . import oracle as orc

KEYS = ("cp_flag", "investor")
MCAP_CUTOFF = 1.5
# Cut-off of each class in the class-by-flag models (the study's differ by class too).
CLASS_CUTOFFS = {"customer_100": 8.0, "professional": 7.9, "firm": 8.2}
MCAP_GRID = (0.5, 2.5, 61)
COEF_DP, Z_DP, MSE_DP = 6, 4, 9
R = C._sql_round


def _price_curve(spark, sf):
    return C.curve(spark, sf, "ln_prc")


def _fit(spark, sf, x="ln_prc", cutoff=C.FIX_CUTOFF, flags=("C", "P")):
    cur = C.curve(spark, sf, x, flags)
    return rdd.fit_wide(cur, "itm_otm", x, cutoff, keys=KEYS)


def _coef_out(long):
    out = long.select(*KEYS, "cutoff", "term", "coef", "bse", "z", "pval", "stars", "nobs", "rsquared",
                      "rsquared_adj")
    out = C.rounded(out, ["coef", "bse", "pval", "rsquared", "rsquared_adj"], COEF_DP)
    return C.rounded(out, ["z"], Z_DP)


def q_rdd_price_hc1(spark, sf):
    return _coef_out(rdd.coefficients(_fit(spark, sf), KEYS))


def q_rdd_price_cluster(spark, sf):
    s = C.short(spark, sf)
    per_ticker = imb.imbalance_by_ticker(s, "ln_prc", {c: dollar_col(c) for c in RDD_CLASSES}) \
        .where(F.col("ln_prc").isNotNull())
    wide = rdd.fit_wide(per_ticker, "itm_otm", "ln_prc", C.FIX_CUTOFF, keys=KEYS, cluster="ticker")
    return _coef_out(rdd.coefficients(wide, KEYS))


def q_rdd_fitted_line(spark, sf):
    line = rdd.fitted_line(_fit(spark, sf), KEYS)
    return C.rounded(line, ["x", "yhat"], C.RATIO_DP)


def _curve_out(df):
    df = C.rounded(df, ["cutoff", "effect_Z"], C.RATIO_DP)
    return C.rounded(df, ["mse"], MSE_DP)


def q_cutoff_mse_curve(spark, sf):
    return _curve_out(rdd.cutoff_curve(_price_curve(spark, sf), "itm_otm", "ln_prc", C.FIX_GRID, KEYS))


def q_optimal_cutoff(spark, sf):
    cur = rdd.cutoff_curve(_price_curve(spark, sf), "itm_otm", "ln_prc", C.FIX_GRID, KEYS)
    return _curve_out(rdd.optimal_cutoff(cur, KEYS))


def _summary(cur, x, cutoff, grid):
    """Fit at the cut-off plus the MSE-optimal cut-off, one row per model."""
    cur = rdd.materialize(cur)  # one curve for the fit and the search
    wide = rdd.fit_wide(cur, "itm_otm", x, cutoff, keys=KEYS, checkpoint_input=False)
    z = rdd.coefficients(wide, KEYS).where(F.col("term") == "Z").select(
        *KEYS, "cutoff", "nobs", F.col("coef").alias("effect_Z"), F.col("bse").alias("bse_Z"),
        F.col("z").alias("z_Z"), F.col("stars").alias("stars_Z"), "rsquared")
    best = rdd.optimal_cutoff(rdd.cutoff_curve(cur, "itm_otm", x, grid, KEYS, checkpoint_input=False),
                              KEYS).select(
        *KEYS, F.col("cutoff").alias("optimal_cutoff"), F.col("mse").alias("optimal_mse"),
        F.col("effect_Z").alias("optimal_effect_Z"))
    out = z.join(best, list(KEYS), "left")
    out = C.rounded(out, ["effect_Z", "bse_Z", "rsquared", "optimal_cutoff", "optimal_effect_Z"], COEF_DP)
    return C.rounded(C.rounded(out, ["z_Z"], Z_DP), ["optimal_mse"], MSE_DP)


def q_rdd_by_class_and_flag(spark, sf):
    of_class = F.create_map(*[F.lit(v) for kv in CLASS_CUTOFFS.items() for v in kv])[F.col("investor")]
    return _summary(_price_curve(spark, sf), "ln_prc", of_class, C.FIX_GRID)


def q_rdd_mcap(spark, sf):
    cur = C.curve(spark, sf, "ln_mcap", flags=("C",))
    return _summary(cur, "ln_mcap", MCAP_CUTOFF, MCAP_GRID)


def q_cutoff_effect_se(spark, sf):
    """Jump and HC1 error of every candidate, as one fit per candidate gives."""
    e = cutoff_effects(_price_curve(spark, sf), "itm_otm", "ln_prc", C.FIX_GRID, KEYS).drop("mse")
    return C.rounded(C.rounded(e, ["cutoff", "effect_Z", "bse_Z"], COEF_DP), ["z_Z"], Z_DP)


def q_cutoff_effect_min_norm(spark, sf):
    """Jumps on the study's default grid, whose ends leave a side one x or none."""
    e = cutoff_effects(_price_curve(spark, sf), "itm_otm", "ln_prc", None, KEYS, least_norm=True)
    return C.rounded(e.select(*KEYS, "j", "cutoff", "effect_Z", "rank_deficient"), ["cutoff", "effect_Z"], COEF_DP)


# ------------------------------------------------------------------ oracles

def _curve_ctes(x):
    return orc.base_ctes() + [orc.joined_cte(), orc.short_cte(C.FIX_MATURITIES)] + \
        orc.curve_ctes(x, RDD_CLASSES)


def _pvalue_sql(z: str) -> str:
    """Two-sided normal p-value of a z column in SQL (same expansions as the library)."""
    x = f"(abs({z}) / sqrt(2.0))"
    return erfc_sql(x)


def _stars_sql(z: str) -> str:
    parts = " ".join(f"WHEN abs({z}) > {crit!r} THEN '{s}'" for crit, s in Z_CRIT)
    return f"CASE {parts} ELSE '' END"


def _sql_cutoff(cutoff) -> str:
    """A number, or one number per class."""
    if not isinstance(cutoff, dict):
        return f"{float(cutoff)!r}::DOUBLE"
    return "(CASE investor " + " ".join(f"WHEN '{c}' THEN {float(v)!r}::DOUBLE" for c, v in cutoff.items()) + " END)"


def _fit_ctes(src: str, cutoff, cluster: str | None = None) -> list[str]:
    g = f", {cluster} AS g" if cluster else ""
    ctes = [f"""
d AS (
  SELECT cp_flag, investor, x, itm_otm AS y {g},
         CASE WHEN x >= {_sql_cutoff(cutoff)} THEN 1 ELSE 0 END AS z, x - {_sql_cutoff(cutoff)} AS xc
  FROM {src}
)""", """
side AS (
  SELECT cp_flag, investor, z, count(*) AS n, avg(y) AS my, avg(xc) AS mx,
         CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_slope(y, xc) END AS b,
         CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_intercept(y, xc) END AS a,
         regr_sxx(y, xc) AS sxx
  FROM d GROUP BY ALL
)""", """
res AS (
  SELECT d.*, s.n, s.mx, s.sxx, s.a, s.b,
         CASE WHEN s.n = 2 THEN 0.0 WHEN s.b IS NOT NULL THEN d.y - s.a - s.b * d.xc ELSE d.y - s.my END AS e,
         CASE WHEN s.b IS NOT NULL THEN 1.0 / s.n - s.mx * (d.xc - s.mx) / s.sxx END AS w0,
         CASE WHEN s.b IS NOT NULL THEN (d.xc - s.mx) / s.sxx END AS w1
  FROM d JOIN side s USING (cp_flag, investor, z)
)""", """
tot AS (
  SELECT cp_flag, investor, count(*) AS n, sum(e * e) AS sse
  FROM res GROUP BY ALL
)""", """
sst AS (
  SELECT d.cp_flag, d.investor, sum(power(d.y - m.ybar, 2)) AS sst
  FROM d JOIN (SELECT cp_flag, investor, avg(y) AS ybar FROM d GROUP BY ALL) m USING (cp_flag, investor)
  GROUP BY ALL
)"""]
    if cluster is None:
        ctes.append("""
meat AS (
  SELECT cp_flag, investor,
    sum(CASE WHEN z = 0 THEN w0 * w0 * e * e END) AS q_int,
    sum(w0 * w0 * e * e) AS q_z,
    sum(CASE WHEN z = 0 THEN w1 * w1 * e * e END) AS q_xc,
    sum(w1 * w1 * e * e) AS q_zxc,
    NULL::BIGINT AS clusters
  FROM res GROUP BY ALL
)""")
        corr = "t.n::DOUBLE / (t.n - 4)"
    else:
        ctes.append("""
score AS (
  SELECT cp_flag, investor, g,
    coalesce(sum(CASE WHEN z = 0 THEN w0 * e END), 0) AS saL,
    coalesce(sum(CASE WHEN z = 0 THEN w1 * e END), 0) AS sbL,
    coalesce(sum(CASE WHEN z = 1 THEN w0 * e END), 0) AS saR,
    coalesce(sum(CASE WHEN z = 1 THEN w1 * e END), 0) AS sbR
  FROM res GROUP BY ALL
)""")
        ctes.append("""
meat AS (
  SELECT cp_flag, investor, sum(saL * saL) AS q_int, sum(power(saR - saL, 2)) AS q_z,
         sum(sbL * sbL) AS q_xc, sum(power(sbR - sbL, 2)) AS q_zxc, count(*) AS clusters
  FROM score GROUP BY ALL
)""")
        corr = "m.clusters::DOUBLE / (m.clusters - 1) * (t.n - 1)::DOUBLE / (t.n - 4)"
    ctes.append(f"""
model AS (
  SELECT t.cp_flag, t.investor, t.n AS nobs, 1 - t.sse / q.sst AS r2,
         l.a AS aL, l.b AS bL, r.a AS aR, r.b AS bR,
         {corr} AS corr, m.q_int, m.q_z, m.q_xc, m.q_zxc
  FROM tot t JOIN sst q USING (cp_flag, investor) JOIN meat m USING (cp_flag, investor)
  LEFT JOIN side l ON l.cp_flag = t.cp_flag AND l.investor = t.investor AND l.z = 0
  LEFT JOIN side r ON r.cp_flag = t.cp_flag AND r.investor = t.investor AND r.z = 1
)""")
    terms = {"Intercept": ("aL", "q_int"), "Z": ("aR - aL", "q_z"), "Xc": ("bL", "q_xc"),
             "Z:Xc": ("bR - bL", "q_zxc")}
    union = "\n  UNION ALL ".join(
        f"SELECT cp_flag, investor, '{t}' AS term, {c} AS coef, "
        f"CASE WHEN ({c}) IS NOT NULL THEN sqrt(corr * {v}) END AS bse, nobs, r2 FROM model"
        for t, (c, v) in terms.items())
    ctes.append(f"""
coef AS (
  SELECT *, CASE WHEN bse > 0 THEN coef / bse END AS zstat FROM (
  {union})
)""")
    return ctes


def _coef_select(cutoff: float) -> str:
    return f"""
SELECT cp_flag, investor, {cutoff!r}::DOUBLE AS cutoff, term,
       {R('coef', COEF_DP)} AS coef, {R('bse', COEF_DP)} AS bse, {R('zstat', Z_DP)} AS z,
       {R(_pvalue_sql('zstat'), COEF_DP)} AS pval,
       {_stars_sql('zstat')} AS stars, nobs, {R('r2', COEF_DP)} AS rsquared,
       {R('1 - (nobs - 1)::DOUBLE / (nobs - 4) * (1 - r2)', COEF_DP)} AS rsquared_adj
FROM coef"""


def o_rdd_price_hc1():
    return orc.with_ctes(_curve_ctes("ln_prc") + _fit_ctes("curve", C.FIX_CUTOFF),
                         _coef_select(C.FIX_CUTOFF))


def o_rdd_price_cluster():
    src = "(SELECT * FROM curve_ticker WHERE x IS NOT NULL)"
    return orc.with_ctes(_curve_ctes("ln_prc") + _fit_ctes(src, C.FIX_CUTOFF, "ticker"),
                         _coef_select(C.FIX_CUTOFF))


def o_rdd_fitted_line():
    n = 400
    ctes = _curve_ctes("ln_prc") + _fit_ctes("curve", C.FIX_CUTOFF) + ["""
rng AS (SELECT cp_flag, investor, min(x) AS lo, max(x) AS hi FROM curve GROUP BY ALL)""", f"""
pts AS (
  SELECT m.cp_flag, m.investor, i,
         CASE WHEN i = {n - 1} THEN r.hi ELSE i::DOUBLE * ((r.hi - r.lo) / {float(n - 1)!r}::DOUBLE) + r.lo END AS x,
         m.aL, m.bL, m.aR, m.bR
  FROM model m JOIN rng r USING (cp_flag, investor), range(0, {n}) t(i)
)"""]
    c = C.FIX_CUTOFF
    yhat = f"CASE WHEN x >= {c!r} THEN aR + bR * (x - {c!r}) ELSE aL + bL * (x - {c!r}) END"
    return orc.with_ctes(ctes, f"SELECT cp_flag, investor, CAST(i AS INTEGER) AS i, "
                               f"{R('x', C.RATIO_DP)} AS x, {R(yhat, C.RATIO_DP)} AS yhat FROM pts")


def _grid_ctes(src: str, grid) -> list[str]:
    start, stop, num = grid
    step = f"(({float(stop)!r}::DOUBLE - {float(start)!r}::DOUBLE) / {float(num - 1)!r}::DOUBLE)"
    return [f"""
grid AS (
  SELECT CAST(j AS INTEGER) AS j,
         CASE WHEN j = {num - 1} THEN {float(stop)!r}::DOUBLE
              ELSE j::DOUBLE * {step} + {float(start)!r}::DOUBLE END AS c
  FROM range(0, {num}) t(j)
)""", f"""
gd AS (
  SELECT s.cp_flag, s.investor, s.x, s.itm_otm AS y, g.j, g.c,
         CASE WHEN s.x >= g.c THEN 1 ELSE 0 END AS z, s.x - g.c AS xc
  FROM {src} s, grid g
)""", """
gside AS (
  SELECT cp_flag, investor, j, z,
         CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_slope(y, xc) END AS b,
         CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_intercept(y, xc) END AS a, avg(y) AS my
  FROM gd GROUP BY ALL
)""", """
gpart AS (
  SELECT gd.cp_flag, gd.investor, gd.j, gd.c, gd.z, count(*) AS n,
         sum(power(CASE WHEN s.b IS NOT NULL THEN gd.y - s.a - s.b * gd.xc ELSE gd.y - s.my END, 2)) AS sse,
         sum(power(gd.y - s.my, 2)) AS syy
  FROM gd JOIN gside s USING (cp_flag, investor, j, z)
  GROUP BY ALL
)""", """
gsse AS (
  SELECT cp_flag, investor, j, c, sum(CASE WHEN sse <= 1e-12 * syy THEN 0 ELSE sse END) AS sse, sum(n) AS n
  FROM gpart GROUP BY ALL
)""", """
gcurve AS (
  SELECT e.cp_flag, e.investor, e.j, e.c AS cutoff, e.sse / e.n AS mse,
         CASE WHEN l.b IS NOT NULL AND r.b IS NOT NULL THEN r.a - l.a END AS effect_Z,
         NOT (l.b IS NOT NULL AND r.b IS NOT NULL) AS rank_deficient
  FROM gsse e
  LEFT JOIN gside l ON l.cp_flag = e.cp_flag AND l.investor = e.investor AND l.j = e.j AND l.z = 0
  LEFT JOIN gside r ON r.cp_flag = e.cp_flag AND r.investor = e.investor AND r.j = e.j AND r.z = 1
)"""]


def _curve_cols() -> str:
    return (f"cp_flag, investor, j, {R('cutoff', C.RATIO_DP)} AS cutoff, {R('mse', MSE_DP)} AS mse, "
            f"{R('effect_Z', C.RATIO_DP)} AS effect_Z, rank_deficient")


def o_cutoff_mse_curve():
    return orc.with_ctes(_curve_ctes("ln_prc") + _grid_ctes("curve", C.FIX_GRID),
                         f"SELECT {_curve_cols()} FROM gcurve")


_BEST = ("(SELECT * EXCLUDE (least) FROM (SELECT *, min(mse) OVER (PARTITION BY cp_flag, investor) AS least FROM gcurve) "
         "WHERE mse <= least * (1 + 1e-9) QUALIFY row_number() OVER (PARTITION BY cp_flag, investor ORDER BY j) = 1)")


def o_optimal_cutoff():
    return orc.with_ctes(_curve_ctes("ln_prc") + _grid_ctes("curve", C.FIX_GRID),
                         f"SELECT {_curve_cols()} FROM {_BEST}")


def _o_summary(x, cutoff, grid, flags):
    src = f"(SELECT * FROM curve WHERE cp_flag IN {orc._in(flags)})"
    ctes = _curve_ctes(x) + _fit_ctes(src, cutoff) + _grid_ctes(src, grid) + [
        f"best AS {_BEST}"]
    return orc.with_ctes(ctes, f"""
SELECT c.cp_flag, c.investor, {_sql_cutoff(cutoff).replace("investor", "c.investor")} AS cutoff, c.nobs,
       {R('c.coef', COEF_DP)} AS effect_Z, {R('c.bse', COEF_DP)} AS bse_Z, {R('c.zstat', Z_DP)} AS z_Z,
       {_stars_sql('c.zstat')} AS stars_Z, {R('c.r2', COEF_DP)} AS rsquared,
       {R('b.cutoff', COEF_DP)} AS optimal_cutoff, {R('b.mse', MSE_DP)} AS optimal_mse,
       {R('b.effect_Z', COEF_DP)} AS optimal_effect_Z
FROM coef c LEFT JOIN best b USING (cp_flag, investor)
WHERE c.term = 'Z'""")


def o_rdd_by_class_and_flag():
    return _o_summary("ln_prc", CLASS_CUTOFFS, C.FIX_GRID, ("C", "P"))


def o_rdd_mcap():
    return _o_summary("ln_mcap", MCAP_CUTOFF, MCAP_GRID, ("C",))


_EFFECT_SIDES = ["""
gs AS (
  SELECT cp_flag, investor, j, c, z, count(*) AS n, avg(xc) AS mx, avg(y) AS my, regr_sxx(y, xc) AS sxx,
         CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_slope(y, xc) END AS b,
         CASE WHEN count(*) >= 2 AND max(x) > min(x) THEN regr_intercept(y, xc) END AS a
  FROM gd GROUP BY ALL
)""", """
gq AS (
  SELECT gd.cp_flag, gd.investor, gd.j, gd.z, any_value(s.n) AS n,
         sum(power((1.0 / s.n - s.mx * (gd.xc - s.mx) / s.sxx) * (gd.y - s.a - s.b * gd.xc), 2)) AS q,
         sum(power(gd.y - s.a - s.b * gd.xc, 2)) AS sse, sum(power(gd.y - s.my, 2)) AS syy
  FROM gd JOIN gs s USING (cp_flag, investor, j, z) WHERE s.b IS NOT NULL
  GROUP BY ALL
)""", """
model AS (SELECT cp_flag, investor, j, any_value(c) AS c, sum(n)::BIGINT AS nobs FROM gs GROUP BY cp_flag, investor, j)""", """
sides AS (
  SELECT m.*, l.a AS aL, l.b AS bL, l.mx AS xL, l.my AS yL, l.n AS nL, r.a AS aR, r.b AS bR, r.mx AS xR, r.my AS yR, r.n AS nR,
         CASE WHEN ql.n = 2 OR ql.sse <= 1e-12 * ql.syy THEN 0 ELSE ql.q END AS qL,
         CASE WHEN qr.n = 2 OR qr.sse <= 1e-12 * qr.syy THEN 0 ELSE qr.q END AS qR
  FROM model m
  LEFT JOIN gs l ON l.cp_flag = m.cp_flag AND l.investor = m.investor AND l.j = m.j AND l.z = 0
  LEFT JOIN gs r ON r.cp_flag = m.cp_flag AND r.investor = m.investor AND r.j = m.j AND r.z = 1
  LEFT JOIN gq ql ON ql.cp_flag = m.cp_flag AND ql.investor = m.investor AND ql.j = m.j AND ql.z = 0
  LEFT JOIN gq qr ON qr.cp_flag = m.cp_flag AND qr.investor = m.investor AND qr.j = m.j AND qr.z = 1
)"""]


def o_cutoff_effect_se():
    ctes = _curve_ctes("ln_prc") + _grid_ctes("curve", C.FIX_GRID)[:2] + _EFFECT_SIDES + ["""
eff AS (
  SELECT cp_flag, investor, j, c, nobs, aR - aL AS e, bL IS NULL OR bR IS NULL AS deficient,
         CASE WHEN bL IS NOT NULL AND bR IS NOT NULL AND nobs > 4 THEN sqrt(nobs::DOUBLE / (nobs - 4) * (qL + qR)) END AS se
  FROM sides
)""", "zed AS (SELECT *, CASE WHEN se > 0 THEN e / se END AS zz FROM eff)"]
    return orc.with_ctes(ctes, f"""
SELECT cp_flag, investor, j, {R('c', COEF_DP)} AS cutoff, nobs, {R('e', COEF_DP)} AS effect_Z, {R('se', COEF_DP)} AS bse_Z,
       {R('zz', Z_DP)} AS z_Z, {_stars_sql('zz')} AS stars_Z, deficient AS rank_deficient
FROM zed""")


def o_cutoff_effect_min_norm():
    n = 101
    ctes = _curve_ctes("ln_prc") + ["""
rng AS (SELECT cp_flag, investor, min(x) AS lo, max(x) AS hi FROM curve GROUP BY ALL)""", f"""
cuts AS (
  SELECT cp_flag, investor, CAST(j AS INTEGER) AS j, CASE WHEN j = {n - 1} THEN hi ELSE j::DOUBLE * ((hi - lo) / {float(n - 1)!r}::DOUBLE) + lo END AS c
  FROM rng, range(0, {n}) t(j)
)""", """
gd AS (
  SELECT s.cp_flag, s.investor, s.x, s.itm_otm AS y, g.j, g.c, CASE WHEN s.x >= g.c THEN 1 ELSE 0 END AS z, s.x - g.c AS xc
  FROM curve s JOIN cuts g USING (cp_flag, investor)
)"""] + _EFFECT_SIDES
    effect = """CASE WHEN bL IS NOT NULL AND bR IS NOT NULL THEN aR - aL
      WHEN nR IS NULL THEN 0
      WHEN bL IS NOT NULL THEN (yR - aL - bL * xR) / (1 + xR * xR)
      WHEN nL IS NULL AND bR IS NOT NULL THEN aR / 2
      WHEN bR IS NOT NULL THEN aR / 2 - (yL - aR / 2 - xL * bR / 2) / (1 + xL * xL)
      WHEN nL IS NULL THEN yR / (2 * (1 + xR * xR))
      ELSE ((1 + xL * xL) * yR - (1 + xL * xR) * yL) / (2 * (1 + xL * xL) * (1 + xR * xR) - power(1 + xL * xR, 2)) END"""
    return orc.with_ctes(ctes, f"""
SELECT cp_flag, investor, j, {R('c', COEF_DP)} AS cutoff, {R(effect, COEF_DP)} AS effect_Z,
       bL IS NULL OR bR IS NULL AS rank_deficient
FROM sides""")


QUERIES = {
    "cutoff_effect_se": q_cutoff_effect_se,
    "cutoff_effect_min_norm": q_cutoff_effect_min_norm,
    "rdd_price_hc1": q_rdd_price_hc1,
    "rdd_price_cluster": q_rdd_price_cluster,
    "rdd_fitted_line": q_rdd_fitted_line,
    "cutoff_mse_curve": q_cutoff_mse_curve,
    "optimal_cutoff": q_optimal_cutoff,
    "rdd_by_class_and_flag": q_rdd_by_class_and_flag,
    "rdd_mcap": q_rdd_mcap,
}

ORACLES = {
    "cutoff_effect_se": o_cutoff_effect_se,
    "cutoff_effect_min_norm": o_cutoff_effect_min_norm,
    "rdd_price_hc1": o_rdd_price_hc1,
    "rdd_price_cluster": o_rdd_price_cluster,
    "rdd_fitted_line": o_rdd_fitted_line,
    "cutoff_mse_curve": o_cutoff_mse_curve,
    "optimal_cutoff": o_optimal_cutoff,
    "rdd_by_class_and_flag": o_rdd_by_class_and_flag,
    "rdd_mcap": o_rdd_mcap,
}
