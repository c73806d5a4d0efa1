import math
import random

import numpy as np
import pytest

from tiltkit.functions.numeric import ordered_key
from tiltkit.operators import quantile
from tiltkit.operators.quantile import approx_quantiles, bracket_quantiles, exact_quantiles

QS = (0.05, 0.25, 0.5, 0.75, 0.95)


def nearest(vals, q):
    v = sorted(vals)
    n = len(v)
    pos = (n - 1) * q
    r = math.floor(pos + 0.5) if pos - math.floor(pos) != 0.5 else math.floor(pos) + 1
    return v[min(max(int(r), 0), n - 1)]


def test_ordered_key_is_monotone(spark):
    vals = [-math.inf, -1e300, -2.5, -1.0, -5e-324, -0.0, 0.0, 5e-324, 2.2250738585072014e-308,
            1e-300, 0.1, 0.5, 1.0, 1.0000000000000002, 2.0, 3.9999999999999996, 4.0, 1e300, math.inf]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    rows = df.select("i", "v", ordered_key("v").alias("k")).collect()
    # unsigned order == numeric order
    keys = [(r.k + 2**64) % 2**64 for r in sorted(rows, key=lambda r: r.i)]
    for a, b, va, vb in zip(keys, keys[1:], vals, vals[1:]):
        assert (a < b) or (a == b and va == vb), (va, vb)
    # positive normals: the key is the IEEE bit pattern with the sign bit set
    import struct
    for r in rows:
        if r.v is not None and r.v > 0 and math.isfinite(r.v):
            bits = struct.unpack(">q", struct.pack(">d", r.v))[0]
            assert (r.k + 2**64) % 2**64 == bits + 2**63


@pytest.mark.parametrize("seed", [0, 1])
def test_exact_matches_sort(spark, seed):
    rng = random.Random(seed)
    data = []
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 20, "f": 1000}
    for g, n in sizes.items():
        for _ in range(n):
            data.append((g, "x", rng.choice([rng.uniform(-5, 5), float(rng.randint(0, 3)), rng.lognormvariate(0, 3)])))
    for _ in range(3000):  # skewed group, heavy ties
        data.append(("hot", "x", float(rng.randint(0, 5))))
    data.append((None, "x", 1.5))
    data.append((None, "x", -2.0))
    data.append(("a", "x", None))
    data.append(("a", "x", float("nan")))
    df = spark.createDataFrame(data, "g string, h string, v double")
    out = exact_quantiles(df, ["g", "h"], "v", QS, with_stats=True).collect()
    groups = {}
    for g, _, v in data:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert len(out) == len(groups) * len(QS)
    for r in out:
        vals = groups[r.g]
        assert r.n == len(vals)
        assert r.value == nearest(vals, r.q), (r.g, r.q)


def test_approx_within_rank_tolerance(spark):
    rng = np.random.default_rng(3)
    vals = rng.lognormal(size=20000)
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    out = approx_quantiles(df, ["g"], "v", QS, accuracy=1000).collect()
    s = np.sort(vals)
    for r in out:
        rank = np.searchsorted(s, r.value)
        assert abs(rank - r.q * len(s)) <= len(s) / 1000 * 2 + 1


def _mixed(seed):
    rng = random.Random(seed)
    data = [(g, rng.choice([rng.uniform(-5, 5), float(rng.randint(0, 3)), rng.lognormvariate(0, 3)]))
            for g, n in {"a": 1, "b": 2, "c": 3, "d": 20, "e": 700}.items() for _ in range(n)]
    data += [("hot", float(rng.randint(0, 5))) for _ in range(2000)] + [("wide", rng.gauss(0, 1)) for _ in range(3000)]
    data += [(None, 1.5), (None, -2.0), (None, -0.0), ("a", None), ("a", float("nan")), ("gone", None), ("z", -0.0), ("z", 0.0)]
    return data


@pytest.mark.parametrize("accuracy,slack,window", [(10_000, 3.0, 65_536), (50, 3.0, 65_536), (50, 3.0, 10), (40, 0.0, 65_536)])
def test_bracket_equals_radix(spark, monkeypatch, accuracy, slack, window):
    """Ties, NULLs, groups of one, brackets that miss (no slack), and brackets
    with more values than a window may see."""
    monkeypatch.setattr(quantile, "WINDOW_ROWS", window)
    df = spark.createDataFrame(_mixed(accuracy), "g string, v double").repartition(5)
    qs = (0.0, *QS, 1.0)
    for rule in ("nearest", "lower", "higher"):
        got = bracket_quantiles(df, ["g"], "v", qs, rule, True, accuracy, slack).collect()
        want = exact_quantiles(df, ["g"], "v", qs, rule, True).collect()
        key = lambda r: (str(r.g), r.q, r.value, r.n, round(r.total, 6))
        assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 9 * len(qs)
        if window == 10 or slack == 0.0:
            break


def test_bracket_keeps_little_and_copies_nothing(spark, monkeypatch):
    """What is written of a large group is a small part of it."""
    sizes = []
    real = quantile.materialize
    monkeypatch.setattr(quantile, "materialize", lambda d: sizes.append(real(d)) or sizes[-1])
    df = spark.range(200_000).selectExpr("'g' AS g", "(id * 7919) % 200003 + 0.5 AS v")
    got = {r.q: r.value for r in bracket_quantiles(df, ["g"], "v", QS, accuracy=1000).collect()}
    vals = sorted(i * 7919 % 200003 + 0.5 for i in range(200_000))
    assert got == {q: nearest(vals, q) for q in QS}
    assert max(d.count() for d in sizes) < 200_000 * len(QS) * 0.02


def test_bracket_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert bracket_quantiles(df, ["g"], "v", QS, with_stats=True).count() == 0
