"""Robust errors and least-norm effects of all candidates against numpy."""

import numpy as np
import pytest

from tiltkit.operators.cutoff_effects import cutoff_effects

from .test_rdd import _design, _ols


def _frame(spark, models):
    rows = [(m, float(a), float(b)) for m, (x, y) in models.items() for a, b in zip(x, y)]
    rows += [("a", None, 1.0), ("a", float("nan"), 1.0), ("a", 1.0, float("inf"))]
    return spark.createDataFrame(rows, "m string, x double, y double").repartition(3)


def _models(offset=0.0, y_offset=0.0):
    r = np.random.default_rng(4)
    x = np.round(r.uniform(3, 9, 300), 1)  # ties in x
    y = y_offset + 0.2 + 0.05 * (x - 6) + 0.3 * (x >= 6) + r.normal(0, 0.02 * x)
    far = np.concatenate([r.normal(4, 0.001, 40), r.normal(8, 0.5, 200)])
    return {"a": (x + offset, y), None: (far + offset, r.normal(0, 1, len(far)) * (1 + far) + y_offset),
            "tiny": (np.array([3.0, 5.0, 5.5, 7.0, 8.0]) + offset, np.array([1.0, 2.0, 1.5, 0.5, 3.0]) + y_offset)}


@pytest.mark.parametrize("offset,y_offset", [(0.0, 0.0), (1000.0, 0.0), (0.0, 1e5)])
def test_robust_error_equals_one_fit_per_candidate(spark, offset, y_offset):
    models = _models(offset, y_offset)
    grid = (3.0 + offset, 9.0 + offset, 40)
    got = {(r.m, r.j): r for r in cutoff_effects(_frame(spark, models), "y", "x", grid, ["m"]).collect()}
    assert len(got) == 3 * 40
    checked = 0
    for m, (x, y) in models.items():
        for j, c in enumerate(np.linspace(*grid)):
            row = got[m, j]
            assert row.cutoff == pytest.approx(c, abs=1e-12) and row.nobs == len(x)
            if min(len(set(x[x < c])), len(set(x[x >= c]))) < 2:
                assert row.rank_deficient and row.effect_Z is None and row.bse_Z is None
                continue
            beta, se, _, mse = _ols(x - c, y - y.mean(), 0.0)  # shifts change neither, but help numpy
            assert row.effect_Z == pytest.approx(beta[1], rel=1e-6, abs=1e-8)
            assert row.mse == pytest.approx(mse, rel=1e-6, abs=1e-12)
            if len(x) > 5 and min((x < c).sum(), (x >= c).sum()) > 2:
                assert row.bse_Z == pytest.approx(se[1], rel=1e-5)
                checked += 1
    assert checked > 60


def test_least_norm_equals_the_pseudo_inverse(spark):
    r = np.random.default_rng(6)
    cases = {
        "line_one": (np.array([1.0, 2.0, 3.0, 8.0, 8.0]), r.normal(size=5)), "one_line": (np.array([1.0, 1.0, 6.0, 7.0, 9.0]), r.normal(size=5)),
        "one_one": (np.array([2.0, 2.0, 7.0]), r.normal(size=3)), "none_line": (np.array([6.0, 7.0, 8.5]), r.normal(size=3)),
        "line_none": (np.array([1.0, 2.0, 4.0]), r.normal(size=3)), "none_one": (np.array([8.0]), np.array([2.0])),
        "one_none": (np.array([2.0]), np.array([3.0])), "full": (np.array([1.0, 2.0, 7.0, 8.0, 9.0]), r.normal(size=5)),
    }
    rows = [(m, float(a), float(b)) for m, (x, y) in cases.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "m string, x double, y double")
    got = {(q.m, q.j): q for q in cutoff_effects(df, "y", "x", (4.5, 5.5, 3), ["m"], least_norm=True).collect()}
    for m, (x, y) in cases.items():
        for j, c in enumerate(np.linspace(4.5, 5.5, 3)):
            beta = np.linalg.pinv(_design(x, c)) @ y
            assert got[m, j].effect_Z == pytest.approx(beta[1], rel=1e-9, abs=1e-9), (m, c)
            assert got[m, j].rank_deficient == (m != "full")


def test_default_grid_and_empty_table(spark):
    df = spark.createDataFrame([], "m string, x double, y double")
    assert cutoff_effects(df, "y", "x").count() == 0
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(20)], "x double, y double")
    rows = sorted(cutoff_effects(df, "y", "x").collect(), key=lambda r: r.j)
    assert len(rows) == 101 and rows[0].cutoff == 0.0 and rows[-1].cutoff == 19.0
    assert rows[0].rank_deficient and rows[-1].rank_deficient and not rows[50].rank_deficient
