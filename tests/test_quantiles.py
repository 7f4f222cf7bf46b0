"""Exact quantiles against sorted values, and close pairs in crowded buckets against brute force."""

import math

import numpy as np
import pytest

from footfall.operators import pairs, quantiles, ranges

SHARES = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]


@pytest.fixture(scope="module")
def groups():
    """Groups with ties, with one value only, with great and small numbers, infinities, and a few values."""
    rng = np.random.default_rng(3)
    return {
        "ties": rng.integers(0, 5, 900).astype(float), "one": np.full(300, 7.5), "spread": rng.standard_normal(2000) * 10.0 ** rng.integers(-200, 200, 2000),
        "ends": np.concatenate([[-np.inf] * 100, rng.random(500), [np.inf] * 100]), "few": np.array([3.0, 1.0, 2.0]), None: rng.random(700),
    }


@pytest.mark.parametrize("limit,shares", [(16_384, 256), (50, 256), (50, 4), (1, 256)])
def test_quantiles_are_exact(spark, groups, monkeypatch, limit, shares):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    monkeypatch.setattr(quantiles, "SHARES", shares)
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("few", None), ("ties", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5).persist()
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, "v", SHARES, ["k"]).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        vs = np.sort(vs)
        for i, share in enumerate(SHARES):
            at = share * (len(vs) - 1)
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            want = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
            assert got[k][f"q{i}"] == want or (math.isnan(want) and math.isnan(got[k][f"q{i}"])), (k, share)
    df.unpersist()


def test_quantiles_of_odd_tables(spark, monkeypatch):
    empty = spark.createDataFrame([], "k string, v double")
    assert quantiles.exact_quantiles(empty, "v", [0.5]).collect() == [(None,)]
    assert quantiles.exact_quantiles(empty, "v", [0.5], ["k"]).count() == 0
    monkeypatch.setattr(quantiles, "LIMIT", 2)
    odd = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, float("nan"), float("nan"), None)], "q0 double")
    row = quantiles.exact_quantiles(odd, "q0", [0.0, 0.5, 1.0]).first()
    assert row["q0"] == 1.0 and row["q1"] == 3.0 and math.isnan(row["q2"])
    assert quantiles.exact_quantiles(spark.range(1000), "id", [0.5]).first()["q0"] == 499.5


def test_a_coarse_sketch_costs_rounds_only(spark, monkeypatch):
    """With a sketch of little accuracy the ranks still end at the right values."""
    monkeypatch.setattr(quantiles, "LIMIT", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 32)
    df = spark.createDataFrame([(float(v * v % 997),) for v in range(3000)], "v double")
    vs = sorted(v * v % 997 for v in range(3000))
    assert quantiles.exact_quantiles(df, "v", [0.3333]).first()["q0"] == pytest.approx(np.quantile(vs, 0.3333))


@pytest.mark.parametrize("tile", [4096, 100, 16])
@pytest.mark.parametrize("radius", [5.0, 60.0, 5000.0])
def test_close_pairs_of_crowded_buckets(spark, monkeypatch, tile, radius):
    monkeypatch.setattr(ranges, "TILE", tile)
    rng = np.random.default_rng(4)
    xy = rng.integers(0, 1000, (250, 2)).astype(float)
    xy[:60], xy[60:120] = xy[0], rng.integers(0, 8, (60, 2))
    rows = [("a", k, i, float(x), float(y)) for k, n in ((1, 250), (2, 30)) for i, (x, y) in enumerate(xy[-n:])]
    odd = [("a", 1, 900, None, 1.0), ("a", 1, 901, float("nan"), 1.0), ("a", 2, 902, float("inf"), 1.0)]
    df = spark.createDataFrame(rows + odd, "source string, pattern_id long, point_id long, x double, y double")
    got = sorted((r["pattern_id"], r["i"], r["j"]) for r in pairs.close_pairs(df, radius).collect())
    want = sorted((p[1], p[2], q[2]) for p in rows for q in rows if p[1] == q[1] and p[2] < q[2] and (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 <= radius**2)
    assert got == want


def test_a_crowd_within_one_radius_spreads(spark, monkeypatch):
    """All points of one bucket: its pairs lie in many keys, none of which holds many more rows than a tile."""
    monkeypatch.setattr(ranges, "TILE", 64)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("a", 1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((2000, 2)))], "source string, pattern_id long, point_id long, x double, y double")
    left, right, on = pairs._spread(df.selectExpr("pattern_id", "point_id as i"), df.selectExpr("pattern_id", "point_id as j"), ["pattern_id"])
    for side in (left, right):
        sizes = [r["count"] for r in side.groupBy(*on).count().collect()]
        assert len(sizes) == 32 * 32 and max(sizes) < 2 * 64
    assert pairs.close_pairs(df, 2.0).count() == 2000 * 1999 // 2
