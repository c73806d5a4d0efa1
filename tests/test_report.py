"""Report cells: regression table options and the model comparison text."""

from tiltkit.functions.text import stars
from tiltkit.operators import report


def _coef(spark):
    rows = [("m1", "Intercept", 0.5, 0.1, 0.001, 120, 0.25, 0.2),
            ("m1", "Z", -1.23456, 0.5, 0.04, 120, 0.25, 0.2),
            ("m1", "Xc", 0.0004, 0.002, 0.5, 120, 0.25, 0.2),
            ("m1", "Z:Xc", None, None, None, 120, 0.25, 0.2),
            ("m2", "Intercept", 2.0, 1.0, 0.08, 1234567, 0.5, 0.45),
            ("m2", "Z", 0.125, 0.05, 0.009, 1234567, 0.5, 0.45),
            ("m2", "Xc", 3.0, 1.0, 0.2, 1234567, 0.5, 0.45),
            ("m2", "Z:Xc", 1.0, 2.0, 0.7, 1234567, 0.5, 0.45)]
    return spark.createDataFrame(
        rows, "model string, term string, coef double, bse double, pval double, nobs long, "
              "rsquared double, rsquared_adj double").withColumn("stars", stars("pval"))


def test_regression_table_options(spark):
    t = report.regression_table(_coef(spark), {"m1": "m1", "m2": "m2"}, rows=("Z", "Intercept"),
                                fixed_effects={"m1": "Yes", "m2": "No"}, skip_models=("m2",))
    got = {(r.line_no, r.row_label): (r.m1, r.m2) for r in t.collect()}
    assert got[(0, "Z")] == ("-1.235**", "")
    assert got[(1, "")] == ("(0.500)", "")
    assert got[(2, "Intercept")] == ("0.500***", "")
    assert got[(4, "N")] == ("120", "")
    assert got[(5, "R^2(%)")] == ("25.00", "")
    assert got[(6, "Firm and date FE")] == ("Yes", "")


def test_model_comparison_cells(spark):
    t = report.model_comparison(_coef(spark), {"m1": "first", "m2": "second"})
    rows = sorted(t.collect(), key=lambda r: r.line_no)
    labels = [r.row_label for r in rows]
    assert labels == ["Z", "", "Xc", "", "Z:Xc", "", "Intercept", "", "R-squared", "R-squared Adj.", "N"]
    assert (rows[0].first, rows[0].second) == ("-1.23**", "0.12***")  # 0.125 -> 0.12 (half-even, as '%0.2f')
    assert (rows[4].first, rows[5].first) == ("", "")  # missing term
    assert rows[8].second == "0.50" and rows[9].first == "0.20"
    assert rows[10].second == "1,234,567"


def test_header_spans(spark):
    """Skipped columns end a span and are cells of their own; equal names meet
    only where adjacent."""
    names = ["a", "a", "b", "a", "a", "a", None, ""]
    skipped = {4}
    rows = [("t", i, n, i in skipped) for i, n in enumerate(names)] + [("u", 0, "x", None)]
    got = report.header_spans(spark.createDataFrame(rows, "t string, position int, name string, skipped boolean"), ["t"]).collect()
    spans = sorted((r.cell, r.text, r.first_col, r.last_col, r.ruled) for r in got if r.t == "t" and r.line == "names")
    # the last two are blank names that are not skipped: one cell
    assert spans == [(0, "a", 1, 2, True), (1, "b", 3, 3, True), (2, "a", 4, 4, True), (3, "", 5, 5, False), (4, "a", 6, 6, True),
                     (5, "", 7, 8, False)]
    numbers = [r.text for r in sorted((r for r in got if r.t == "t" and r.line == "numbers"), key=lambda r: r.cell)]
    assert numbers == ["(1)", "(2)", "(3)", "(4)", "", "(6)", "(7)", "(8)"]
    assert [(r.text, r.first_col, r.last_col) for r in got if r.t == "u" and r.line == "names"] == [("x", 1, 1)]


def test_date_effects_label_and_tstats(spark):
    t = report.regression_table(_coef(spark), {"m1": "m1"}, fixed_effects={"m1": "Yes"}, time_effects_only=True)
    assert ("Date FE", "Yes") in {(r.row_label, r.m1) for r in t.collect()}
    from pyspark.sql import functions as F

    z = _coef(spark).withColumn("z", F.col("coef") / F.col("bse"))
    lines = {r.row_label: (r.line_no, r.m1, r.m2) for r in report.tstat_lines(z, {"m1": "m1", "m2": "m2"}).collect()}
    assert lines["Z"] == (0, "[-2.47]", "[2.50]") and lines["Z:Xc"] == (2, "", "[0.50]")
