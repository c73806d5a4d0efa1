"""Registered report queries (formatted table cells) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rdd, report
from ..schema import MONEYNESS, PANEL_TITLES, QUANTILE_LABELS, RDD_CLASSES, TERM_ORDER
from . import catalog as C
from . import discontinuity as D
from . import oracle as orc

MODELS = {f"{c}_{f}": f"{c}_{f}" for f in ("C", "P") for c in RDD_CLASSES}


def _coef(spark, sf, with_pvalue=False):
    long = rdd.coefficients(D._fit(spark, sf), D.KEYS, with_pvalue)
    return long.withColumn("model", F.concat_ws("_", "investor", "cp_flag"))


def q_model_comparison(spark, sf):
    return report.model_comparison(_coef(spark, sf), MODELS)


def q_regression_table(spark, sf):
    return report.regression_table(_coef(spark, sf), MODELS)


def q_significance_stars(spark, sf):
    c = _coef(spark, sf, with_pvalue=True).select(*D.KEYS, "term", "z", "pval", "stars")
    return C.rounded(C.rounded(c, ["z"], D.Z_DP), ["pval"], D.COEF_DP)


def q_volume_distribution_panel(spark, sf):
    # cells print whole units: the distribution is taken at its exact
    # resolution first (sums exact to 3 decimals), as in the table query
    return report.distribution_panel(C.q_volume_distribution(spark, sf))


def q_share_distribution_panel(spark, sf):
    return report.distribution_panel(C.q_share_distribution(spark, sf))


#: Models whose date effects are taken out, and the class and flag whose column is skipped.
WITH_FE = {m: "Yes" if m.endswith("_C") else "No" for m in MODELS}
SKIPPED = ("firm", "P")


def q_regression_table_date_fe(spark, sf):
    return report.regression_table(_coef(spark, sf), MODELS, fixed_effects=WITH_FE, time_effects_only=True)


def q_tstat_table(spark, sf):
    return report.tstat_lines(_coef(spark, sf), MODELS)


def q_regression_table_header(spark, sf):
    """Headers of two tables over the fitted models: columns by class, then
    flag (a class has adjacent columns), and by flag, then class."""
    models = D._fit(spark, sf).select(*D.KEYS).withColumn("skipped", (F.col("investor") == SKIPPED[0]) & (F.col("cp_flag") == SKIPPED[1]))
    layouts = []
    for name, other in (("investor", "cp_flag"), ("cp_flag", "investor")):
        place = F.row_number().over(Window.orderBy(name, other)) - 1  # one row per model
        layouts.append(models.select(F.lit(f"by_{name}").alias("table_name"), place.alias("position"), F.col(name).alias("name"), "skipped"))
    return report.header_spans(layouts[0].unionByName(layouts[1]), ["table_name"])


# ------------------------------------------------------------------ oracles

def _fit_sql() -> list[str]:
    return D._curve_ctes("ln_prc") + D._fit_ctes("curve", C.FIX_CUTOFF) + [f"""
mc AS (
  SELECT investor || '_' || cp_flag AS model, term, coef, bse, zstat, nobs, r2,
         1 - (nobs - 1)::DOUBLE / (nobs - 4) * (1 - r2) AS r2a,
         {D._stars_sql('zstat')} AS st
  FROM coef
)"""]


def _pivot(lines_sql: str) -> str:
    cols = ", ".join(f"max(CASE WHEN model = '{m}' THEN text END) AS {name}" for m, name in MODELS.items())
    return f"SELECT line_no, row_label, {cols} FROM ({lines_sql}) GROUP BY line_no, row_label"


def o_model_comparison():
    parts, i = [], 0
    for t in TERM_ORDER:
        parts.append(f"SELECT model, {i} AS line_no, '{t}' AS row_label, "
                     f"CASE WHEN coef IS NULL THEN '' ELSE printf('%.2f', coef) || st END AS text "
                     f"FROM mc WHERE term = '{t}'")
        parts.append(f"SELECT model, {i + 1} AS line_no, '' AS row_label, "
                     f"CASE WHEN bse IS NULL THEN '' ELSE '(' || printf('%.2f', bse) || ')' END AS text "
                     f"FROM mc WHERE term = '{t}'")
        i += 2
    parts.append(f"SELECT model, {i} AS line_no, 'R-squared' AS row_label, printf('%.2f', r2) AS text "
                 f"FROM mc WHERE term = 'Z'")
    parts.append(f"SELECT model, {i + 1} AS line_no, 'R-squared Adj.' AS row_label, "
                 f"printf('%.2f', r2a) AS text FROM mc WHERE term = 'Z'")
    parts.append(f"SELECT model, {i + 2} AS line_no, 'N' AS row_label, format('{{:,.0f}}', nobs::DOUBLE) AS text "
                 f"FROM mc WHERE term = 'Z'")
    return orc.with_ctes(_fit_sql(), _pivot("\n UNION ALL ".join(parts)))


def o_regression_table(fe_line: str | None = None):
    parts, i = [], 0
    for t in TERM_ORDER:
        parts.append(f"SELECT model, {i} AS line_no, '{t}' AS row_label, "
                     f"CASE WHEN coef IS NULL OR isnan(coef) THEN '' ELSE printf('%.3f', coef) || st END AS text "
                     f"FROM mc WHERE term = '{t}'")
        parts.append(f"SELECT model, {i + 1} AS line_no, '' AS row_label, "
                     f"CASE WHEN bse IS NULL OR isnan(bse) THEN '' ELSE '(' || printf('%.3f', bse) || ')' END AS text "
                     f"FROM mc WHERE term = '{t}'")
        i += 2
    parts.append(f"SELECT model, {i} AS line_no, 'N' AS row_label, format('{{:,.0f}}', nobs::DOUBLE) AS text "
                 f"FROM mc WHERE term = 'Z'")
    parts.append(f"SELECT model, {i + 1} AS line_no, 'R^2(%)' AS row_label, "
                 f"printf('%.2f', r2 * 100.0) AS text FROM mc WHERE term = 'Z'")
    if fe_line:
        cases = " ".join(f"WHEN '{m}' THEN '{v}'" for m, v in WITH_FE.items())
        parts.append(f"SELECT model, {i + 2} AS line_no, '{fe_line}' AS row_label, CASE model {cases} ELSE '' END AS text FROM mc WHERE term = 'Z'")
    return orc.with_ctes(_fit_sql(), _pivot("\n UNION ALL ".join(parts)))


def o_regression_table_date_fe():
    return o_regression_table("Date FE")


def o_tstat_table():
    lines = " UNION ALL ".join(
        f"SELECT model, {i} AS line_no, '{t}' AS row_label, CASE WHEN zstat IS NULL THEN '' ELSE '[' || printf('%.2f', zstat) || ']' END AS text "
        f"FROM mc WHERE term = '{t}'" for i, t in enumerate(TERM_ORDER))
    return orc.with_ctes(_fit_sql(), _pivot(lines))


def o_regression_table_header():
    skipped = f"(investor = '{SKIPPED[0]}' AND cp_flag = '{SKIPPED[1]}')"
    tables = " UNION ALL ".join(
        f"SELECT 'by_{n}' AS table_name, row_number() OVER (ORDER BY {n}, {o}) - 1 AS i, {skipped} AS skipped, "
        f"CASE WHEN {skipped} THEN '' ELSE {n} END AS name FROM models"
        for n, o in (("investor", "cp_flag"), ("cp_flag", "investor")))
    return orc.with_ctes(_fit_sql() + ["models AS (SELECT DISTINCT cp_flag, investor FROM coef)", f"cols AS ({tables})", """
cells AS (
  SELECT *, CAST(sum(CASE WHEN skipped OR before IS NULL OR before <> name THEN 1 ELSE 0 END) OVER (PARTITION BY table_name ORDER BY i) - 1 AS INTEGER) AS cell
  FROM (SELECT *, lag(name) OVER (PARTITION BY table_name ORDER BY i) AS before FROM cols)
)"""], """
SELECT table_name, 'names' AS line, cell, any_value(name) AS text, CAST(min(i) + 1 AS INTEGER) AS first_col, CAST(max(i) + 1 AS INTEGER) AS last_col,
       any_value(name) <> '' AS ruled
FROM cells GROUP BY table_name, cell
UNION ALL
SELECT table_name, 'numbers', CAST(i AS INTEGER), CASE WHEN skipped THEN '' ELSE '(' || (i + 1) || ')' END, CAST(i + 1 AS INTEGER), CAST(i + 1 AS INTEGER), FALSE
FROM cells""")


def o_significance_stars():
    return orc.with_ctes(_fit_sql(), f"SELECT split_part(model, '_', -1) AS cp_flag, "
                                     f"regexp_replace(model, '_[CP]$', '') AS investor, term, "
                                     f"{C._sql_round('zstat', D.Z_DP)} AS z, "
                                     f"{C._sql_round(D._pvalue_sql('zstat'), D.COEF_DP)} AS pval, "
                                     f"st AS stars FROM mc")


def o_volume_distribution_panel():
    return _panel_sql(C.o_volume_distribution())


def o_share_distribution_panel():
    return _panel_sql(C.o_share_distribution())


def _panel_sql(dist: str) -> str:
    stats = [("Mean", "mean")] + list(zip(QUANTILE_LABELS, C.QCOLS))
    parts = [f"SELECT cp_flag, investor, f_k_moneyness, {i} AS stat_order, '{lbl}' AS stat, "
             f"format('{{:,.0f}}', {c}) AS text FROM dist" for i, (lbl, c) in enumerate(stats)]
    parts.append(f"SELECT cp_flag, investor, f_k_moneyness, {len(stats)} AS stat_order, "
                 f"'Total Percentage' AS stat, '(' || format('{{:,.0f}}', share_pct) || '\\%)' AS text FROM dist")
    title = "CASE " + " ".join(f"WHEN cp_flag = '{k}' THEN '{v}'" for k, v in PANEL_TITLES.items()) + " END"
    piv = ", ".join(f"max(CASE WHEN f_k_moneyness = '{m}' THEN text END) AS {m}" for m in MONEYNESS)
    return (f"WITH dist AS ({dist})\n"
            f"SELECT cp_flag, {title} AS panel, investor, stat_order, stat, {piv}\n"
            f"FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL")


QUERIES = {
    "regression_table_header": q_regression_table_header,
    "regression_table_date_fe": q_regression_table_date_fe,
    "tstat_table": q_tstat_table,
    "model_comparison": q_model_comparison,
    "regression_table": q_regression_table,
    "significance_stars": q_significance_stars,
    "volume_distribution_panel": q_volume_distribution_panel,
    "share_distribution_panel": q_share_distribution_panel,
}

ORACLES = {
    "regression_table_header": o_regression_table_header,
    "regression_table_date_fe": o_regression_table_date_fe,
    "tstat_table": o_tstat_table,
    "model_comparison": o_model_comparison,
    "regression_table": o_regression_table,
    "significance_stars": o_significance_stars,
    "volume_distribution_panel": o_volume_distribution_panel,
    "share_distribution_panel": o_share_distribution_panel,
}
