"""Table contents of the study's reports, as DataFrames of formatted cells.

Only the cell text is built (numbers formatted as the tables print them);
typesetting (rules, multicolumn headers) is left to the caller. Rows are
long (one row per table line) and pivoted to one column per model or per
moneyness class with an explicit value list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (
    fmt_bse, fmt_coef, fmt_fixed, fmt_nobs, fmt_rsquared, fmt_share_pct, fmt_thousands, fmt_tstat,
)
from ..schema import MONEYNESS, PANEL_TITLES, QUANTILE_LABELS, TERM_ORDER


def _pivot_models(long: DataFrame, models: Mapping[str, str], keys=("line_no", "row_label")) -> DataFrame:
    aggs = [F.first(F.when(F.col("model") == m, F.col("text")), ignorenulls=True).alias(name)
            for m, name in models.items()]
    return long.groupBy(*keys).agg(*aggs)


def _term_lines(coef: DataFrame, terms: Sequence[str], coef_text, se_text,
                footer: list[tuple[str, F.Column]], skip: F.Column | None = None) -> DataFrame:
    """Long (model, line_no, row_label, text) straight from the long coefficient
    table: each term row gives its coefficient and s.e. lines, the first
    term's row also carries the model-level footer lines. No aggregation
    before the final pivot."""
    order = {t: i for i, t in enumerate(terms)}
    idx = None
    for t, i in order.items():
        idx = F.when(F.col("term") == t, F.lit(i)) if idx is None else idx.when(F.col("term") == t, F.lit(i))
    rows = coef.where(F.col("term").isin(*terms)).withColumn("_i", idx)
    base = len(terms) * 2
    first = F.col("_i") == 0
    lines = [F.struct((F.col("_i") * 2).alias("line_no"), F.col("term").alias("row_label"),
                      coef_text.alias("text")),
             F.struct((F.col("_i") * 2 + 1).alias("line_no"), F.lit("").alias("row_label"),
                      se_text.alias("text"))]
    lines += [F.struct(F.lit(base + k).alias("line_no"), F.lit(lbl).alias("row_label"), txt.alias("text"))
              for k, (lbl, txt) in enumerate(footer)]
    keep = F.array(*[F.lit(True)] * 2 + [first] * len(footer))
    long = rows.select("model", F.arrays_zip(F.array(*lines).alias("l"), keep.alias("k")).alias("_z")) \
        .select("model", F.explode("_z").alias("_e")).where(F.col("_e.k")) \
        .select("model", F.col("_e.l.line_no").alias("line_no"), F.col("_e.l.row_label").alias("row_label"),
                F.col("_e.l.text").alias("text"))
    if skip is not None:
        long = long.withColumn("text", F.when(skip, F.lit("")).otherwise(F.col("text")))
    return long


def model_comparison(coef: DataFrame, models: Mapping[str, str], decimals: int = 2,
                     terms: Sequence[str] = TERM_ORDER) -> DataFrame:
    """Side-by-side models: per term a coefficient line (with stars) and an
    s.e. line in parentheses, then R-squared, adjusted R-squared and N.

    ``coef`` is the long coefficient table with a ``model`` column and
    ``stars``; ``models`` maps model keys to output column names, in order.
    """
    c, b = F.col("coef"), F.col("bse")
    coef_text = F.when(c.isNull(), "").otherwise(F.concat(fmt_fixed(c, decimals), F.col("stars")))
    se_text = F.when(b.isNull(), "").otherwise(F.concat(F.lit("("), fmt_fixed(b, decimals), F.lit(")")))
    footer = [("R-squared", fmt_fixed(F.col("rsquared"), decimals)),
              ("R-squared Adj.", fmt_fixed(F.col("rsquared_adj"), decimals)),
              ("N", fmt_nobs(F.col("nobs")))]
    return _pivot_models(_term_lines(coef, terms, coef_text, se_text, footer), models)


def header_spans(columns: DataFrame, table: Sequence[str] = ()) -> DataFrame:
    """Header cells of a regression table over its ordered model columns.

    ``columns`` has, per table (key columns ``table``), ``position`` (from 0),
    ``name`` and ``skipped``. Adjacent columns of one name share a cell; a
    skipped column is a blank cell of its own and ends the one before. Returns
    (table..., line, cell, text, first_col, last_col, ruled): line ``names`` has
    the shared cells, ``ruled`` (a rule is drawn below) where the name is not
    blank; line ``numbers`` has "(1)", "(2)", ... per column, blank where
    skipped. Columns count from 1; the row labels stand before them.

    Gaps and islands: a cell begins where the name differs from the column
    before, and the running count of beginnings numbers it. A table's windows
    hold its model columns only.
    """
    at = Window.partitionBy(*table).orderBy("position")
    c = columns.select(*table, (F.row_number().over(at) - 1).cast("int").alias("i"), "position", F.coalesce("skipped", F.lit(False)).alias("skipped"),
                       F.when(F.coalesce("skipped", F.lit(False)), "").otherwise(F.coalesce("name", F.lit(""))).alias("name"))
    begins = F.col("skipped") | F.lag("name").over(at).isNull() | (F.lag("name").over(at) != F.col("name"))
    c = c.withColumn("begins", begins.cast("int")).withColumn("cell", (F.sum("begins").over(at) - 1).cast("int"))
    col = (F.col("i") + 1).alias("col")
    names = c.groupBy(*table, "cell").agg(F.first("name").alias("text"), F.min(col).alias("first_col"), F.max(col).alias("last_col"))
    names = names.select(*table, F.lit("names").alias("line"), "cell", "text", "first_col", "last_col", (F.col("text") != "").alias("ruled"))
    number = F.when(F.col("skipped"), "").otherwise(F.concat(F.lit("("), col.cast("string"), F.lit(")")))
    numbers = c.select(*table, F.lit("numbers").alias("line"), F.col("i").alias("cell"), number.alias("text"), col.alias("first_col"),
                       col.alias("last_col"), F.lit(False).alias("ruled"))
    return names.unionByName(numbers)


def tstat_lines(coef: DataFrame, models: Mapping[str, str], terms: Sequence[str] = TERM_ORDER) -> DataFrame:
    """Per term a line with each model's t-statistic in square brackets."""
    order = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")).cast("int") - 1
    text = F.when(F.col("z").isNull(), "").otherwise(fmt_tstat("z"))
    long = coef.where(F.col("term").isin(*terms)).select("model", order.alias("line_no"), F.col("term").alias("row_label"), text.alias("text"))
    return _pivot_models(long, models)


#: Labels of the fixed-effects line.
FIRM_DATE_FE, DATE_FE = "Firm and date FE", "Date FE"


def regression_table(coef: DataFrame, models: Mapping[str, str], rows: Sequence[str] = TERM_ORDER,
                     include_nobs: bool = True, include_rsquared: bool = True,
                     fixed_effects: Mapping[str, str] | None = None,
                     fe_label: str | None = None, skip_models: Sequence[str] = (),
                     time_effects_only: bool = False) -> DataFrame:
    """Regression table body and footer: per row a coefficient line (3
    decimals with stars) and an s.e. line; then N, R^2 in percent and an
    optional fixed-effects line, for firm and date or (``time_effects_only``)
    for the date alone. Models in ``skip_models`` get blank cells.
    """
    fe_label = fe_label or (DATE_FE if time_effects_only else FIRM_DATE_FE)
    footer: list[tuple[str, F.Column]] = []
    if include_nobs:
        footer.append(("N", fmt_nobs(F.col("nobs"))))
    if include_rsquared:
        footer.append(("R^2(%)", fmt_rsquared(F.col("rsquared") * 100.0)))
    if fixed_effects is not None:
        fe = None
        for m, v in fixed_effects.items():
            fe = F.when(F.col("model") == m, v) if fe is None else fe.when(F.col("model") == m, v)
        footer.append((fe_label, fe.otherwise("") if fe is not None else F.lit("")))
    skip = F.col("model").isin(*skip_models) if skip_models else None
    long = _term_lines(coef, rows, fmt_coef("coef", "stars"), fmt_bse("bse"), footer, skip)
    return _pivot_models(long, models)


def distribution_panel(dist: DataFrame) -> DataFrame:
    """Cells of the distribution tables: per (flag panel, class, statistic) one
    row with itm / otm / atm text; numbers '{:,.0f}', the share '(NN\\%)'."""
    stats = [("Mean", F.col("mean"))] + [
        (lbl, F.col(c)) for lbl, c in zip(QUANTILE_LABELS, ("p05", "p25", "p50", "p75", "p95"))]
    cells = [F.struct(F.lit(i).alias("stat_order"), F.lit(lbl).alias("stat"),
                      fmt_thousands(v).alias("text")) for i, (lbl, v) in enumerate(stats)]
    cells.append(F.struct(F.lit(len(stats)).alias("stat_order"), F.lit("Total Percentage").alias("stat"),
                          fmt_share_pct(F.col("share_pct")).alias("text")))
    title = F.lit(None).cast("string")
    for flag, t in PANEL_TITLES.items():
        title = F.when(F.col("cp_flag") == flag, t).otherwise(title)
    long = dist.select("cp_flag", title.alias("panel"), "investor", "f_k_moneyness",
                       F.explode(F.array(*cells)).alias("c")).select(
        "cp_flag", "panel", "investor", "f_k_moneyness", "c.stat_order", "c.stat", "c.text")
    m = F.col("f_k_moneyness")
    return long.groupBy("cp_flag", "panel", "investor", "stat_order", "stat").agg(
        *[F.first(F.when(m == lbl, F.col("text")), ignorenulls=True).alias(lbl) for lbl in MONEYNESS])


def share_cells(avg: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average shares (in percent after ``* 100``) as '(NN\\%)' cells."""
    return avg.select("f_k_moneyness", "cp_flag", *[fmt_share_pct(F.col(c) * 100.0).alias(c) for c in columns])
