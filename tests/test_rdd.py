import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltkit.operators import rdd


def _design(x, c):
    z = (x >= c).astype(float)
    xc = x - c
    return np.column_stack([np.ones_like(x), z, xc, z * xc])  # Intercept, Z, Xc, Z:Xc


def _ols(x, y, c, groups=None):
    X = _design(x, c)
    n, k = X.shape
    XtX_inv = np.linalg.inv(X.T @ X)
    beta = XtX_inv @ X.T @ y
    e = y - X @ beta
    if groups is None:
        meat = (X * e[:, None] ** 2).T @ X
        V = XtX_inv @ meat @ XtX_inv * n / (n - k)
    else:
        G = np.unique(groups)
        meat = np.zeros((k, k))
        for g in G:
            s = X[groups == g].T @ e[groups == g]
            meat += np.outer(s, s)
        V = XtX_inv @ meat @ XtX_inv * len(G) / (len(G) - 1) * (n - 1) / (n - k)
    r2 = 1 - (e @ e) / ((y - y.mean()) @ (y - y.mean()))
    return beta, np.sqrt(np.diag(V)), r2, (e @ e) / n


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(7)
    rows = []
    for m in ("a", "b"):
        x = rng.uniform(3, 9, 400)
        y = 0.2 + 0.05 * (x - 6) + 0.3 * (x >= 6) + rng.normal(0, 0.05 + 0.02 * x)
        g = rng.integers(0, 40, 400)
        rows += [(m, float(a), float(b), int(c)) for a, b, c in zip(x, y, g)]
    return spark.createDataFrame(rows, "m string, x double, y double, g int"), rows


@pytest.mark.parametrize("cluster", [None, "g"])
def test_fit_matches_numpy_sandwich(line, cluster):
    df, rows = line
    wide = rdd.fit_wide(df, "y", "x", 6.0, keys=["m"], cluster=cluster)
    coef = {(r.m, r.term): r for r in rdd.coefficients(wide, ["m"]).collect()}
    for m in ("a", "b"):
        x = np.array([r[1] for r in rows if r[0] == m])
        y = np.array([r[2] for r in rows if r[0] == m])
        g = np.array([r[3] for r in rows if r[0] == m])
        beta, se, r2, _ = _ols(x, y, 6.0, g if cluster else None)
        for i, t in enumerate(("Intercept", "Z", "Xc", "Z:Xc")):
            assert coef[(m, t)].coef == pytest.approx(beta[i], rel=1e-9, abs=1e-12)
            assert coef[(m, t)].bse == pytest.approx(se[i], rel=1e-9)
        assert coef[(m, "Z")].rsquared == pytest.approx(r2, rel=1e-9)
        assert coef[(m, "Z")].nobs == len(x)
        p = coef[(m, "Z")].pval
        z = beta[1] / se[1]
        import math
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12)


def test_singleton_clusters_equal_hc1(spark, line):
    df, _ = line
    df = df.withColumn("one", F.monotonically_increasing_id())
    a = {(r.m, r.term): r.bse for r in rdd.coefficients(rdd.fit_wide(df, "y", "x", 6.0, ["m"]), ["m"], False).collect()}
    b = {(r.m, r.term): r.bse for r in rdd.coefficients(rdd.fit_wide(df, "y", "x", 6.0, ["m"], "one"), ["m"], False).collect()}
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)


def test_cutoff_curve_matches_brute_force(line):
    df, rows = line
    grid = (3.0, 7.0, 61)
    cut = {(r.m, r.j): r for r in rdd.cutoff_curve(df, "y", "x", grid, ["m"]).collect()}
    cs = np.linspace(*grid)
    for m in ("a", "b"):
        x = np.array([r[1] for r in rows if r[0] == m])
        y = np.array([r[2] for r in rows if r[0] == m])
        for j, c in enumerate(cs):
            r = cut[(m, j)]
            assert r.cutoff == c
            X = _design(x, c)
            beta, *_ = np.linalg.lstsq(X, y, rcond=None)
            mse = np.mean((y - X @ beta) ** 2)
            assert r.mse == pytest.approx(mse, rel=1e-9)
            if np.sum(x < c) >= 2 and np.sum(x >= c) >= 2:
                assert r.effect_Z == pytest.approx(beta[1], rel=1e-7, abs=1e-9)
            else:
                assert r.effect_Z is None and r.rank_deficient
    best = {r.m: r for r in rdd.optimal_cutoff(rdd.cutoff_curve(df, "y", "x", grid, ["m"]), ["m"]).collect()}
    for m in ("a", "b"):
        mses = [cut[(m, j)].mse for j in range(len(cs))]
        assert best[m].j == int(np.argmin(mses))


def test_default_grid_and_edges(spark):
    # all x on one side; one x on a side; default grid from min/max
    rows = [("r", float(v), float(v) * 0.5) for v in (1.0, 2.0, 3.0, 4.0)] + [("r", 10.0, 1.0)]
    df = spark.createDataFrame(rows, "m string, x double, y double")
    cur = rdd.cutoff_curve(df, "y", "x", None, ["m"]).orderBy("j").collect()
    assert len(cur) == 101 and cur[0].cutoff == 1.0 and cur[-1].cutoff == 10.0
    # at c = min x the left side is empty: MSE is the plain line fit on all rows
    x = np.array([r[1] for r in rows]); y = np.array([r[2] for r in rows])
    b = np.polyfit(x, y, 1)
    assert cur[0].mse == pytest.approx(np.mean((y - np.polyval(b, x)) ** 2), rel=1e-9)
    assert cur[0].rank_deficient and cur[0].effect_Z is None
    # last candidate: right side is the single x = 10 point
    assert cur[-1].rank_deficient


def test_fitted_line(line):
    df, rows = line
    wide = rdd.fit_wide(df, "y", "x", 6.0, keys=["m"])
    pts = rdd.fitted_line(wide, ["m"]).where("m = 'a'").orderBy("i").collect()
    assert len(pts) == 400
    x = np.array([r[1] for r in rows if r[0] == "a"])
    assert pts[0].x == x.min() and pts[-1].x == x.max()
    np.testing.assert_array_equal([p.x for p in pts], np.linspace(x.min(), x.max(), 400))


def test_infinite_and_nan_rows_are_dropped(spark, line):
    df, rows = line
    extra = spark.createDataFrame([("a", float("inf"), 1.0, 1), ("a", 5.0, float("-inf"), 1),
                                   ("a", float("nan"), 0.3, 1), ("a", None, 0.3, 1)],
                                  "m string, x double, y double, g int")
    both = df.unionByName(extra)

    def close(r1, r2):
        for k, v in r1.asDict().items():
            w = r2[k]
            if isinstance(v, float):
                assert w == pytest.approx(v, rel=1e-9, abs=1e-12), k
            else:
                assert v == w, k

    a = sorted(rdd.fit_wide(df, "y", "x", 6.0, ["m"]).collect(), key=lambda r: r.m)
    b = sorted(rdd.fit_wide(both, "y", "x", 6.0, ["m"]).collect(), key=lambda r: r.m)
    assert len(a) == len(b) == 2
    for r1, r2 in zip(a, b):
        close(r1, r2)
    ca = rdd.cutoff_curve(df, "y", "x", (3.0, 7.0, 11), ["m"]).orderBy("m", "j").collect()
    cb = rdd.cutoff_curve(both, "y", "x", (3.0, 7.0, 11), ["m"]).orderBy("m", "j").collect()
    assert len(ca) == len(cb) == 22
    for r1, r2 in zip(ca, cb):
        close(r1, r2)


@pytest.mark.parametrize("scale", [1e-9, 1e-7, 1.0, 1e7])
def test_optimum_does_not_depend_on_the_scale_of_y(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.uniform(3, 7, 400)
    y = (0.1 * x + 1.0 * (x >= 5.0) + rng.normal(0, 0.01, 400)) * scale
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(x, y)], "m string, x double, y double")
    best = rdd.optimal_cutoff(rdd.cutoff_curve(df, "y", "x", (3.0, 7.0, 9), ["m"]), ["m"]).first()
    assert (best.j, best.cutoff, best.rank_deficient) == (4, 5.0, False)


def test_narrow_side_keeps_its_precision(spark):
    rng = np.random.default_rng(5)
    x = np.append(rng.uniform(3, 7, 2000), [7.0, 7.000000001])
    y = np.append(rng.normal(0, 0.3, 2000), [0.2, 0.9])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    last = rdd.cutoff_curve(df, "y", "x", (3.0, 7.0, 5)).orderBy("j").collect()[-1]
    left = np.polyfit(x[:-2] - 7.0, y[:-2], 1)
    sse = ((y[:-2] - np.polyval(left, x[:-2] - 7.0)) ** 2).sum()
    assert last.cutoff == 7.0 and not last.rank_deficient
    assert last.mse == pytest.approx(sse / 2002, rel=1e-9)
    assert last.effect_Z == pytest.approx(0.2 - left[1], rel=1e-6)


def test_null_model_key_is_a_model(spark, line):
    df = line[0] if isinstance(line, tuple) else line
    df = df.withColumn("m", F.when(F.col("m") == "a", F.col("m")))
    assert {r.m for r in rdd.fit_wide(df, "y", "x", 6.0, ["m"]).collect()} == {"a", None}
    curve = rdd.cutoff_curve(df, "y", "x", None, ["m"])
    assert {r.m for r in rdd.optimal_cutoff(curve, ["m"]).collect()} == {"a", None}
