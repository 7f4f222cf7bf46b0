"""Counts within radii, neighbours and model profiles of patterns that are taken apart, against brute force."""

import numpy as np
import pytest

from footfall.operators import gibbs, intensity, metrics, pairs, ranges

POINTS = "source string, pattern_id long, point_id long, x double, y double, w double"


@pytest.fixture(scope="module")
def patterns(spark):
    """Patterns of 1 to 600 points on whole places; one has 100 points at one place, some points have no place."""
    rng = np.random.default_rng(1)
    rows = []
    for k, n in enumerate([1, 2, 30, 300, 600]):
        xy, w = rng.integers(0, 3000, (n, 2)).astype(float), rng.random(n)
        if n == 300:
            xy[:100] = xy[0]
        rows += [("a", k, 1000 * k + i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, w))]
    odd = [("a", 2, 9001, None, 5.0, 1.0), ("a", 2, 9002, float("nan"), 5.0, 1.0), ("b", 9, 9003, float("inf"), 0.0, 1.0)]
    return rows, spark.createDataFrame(rows + odd, POINTS)


def distances(rows):
    """pattern -> (point ids, distances, weights)."""
    out = {}
    for k in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == k]
        xy = np.array([r[3:5] for r in mine])
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        out[k] = [r[2] for r in mine], d, np.array([r[5] for r in mine])
    return out


RADII = [0.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2000.0, 50000.0]


@pytest.mark.parametrize("tile,block", [(4096, 128), (64, 8), (200, 128)])
def test_range_counts(patterns, monkeypatch, tile, block):
    monkeypatch.setattr(ranges, "TILE", tile)
    monkeypatch.setattr(ranges, "BLOCK", block)
    rows, df = patterns
    found = {r["point_id"]: r for r in ranges.range_counts(df, RADII, weight="w").collect()}
    assert len(found) == len(rows)
    for ids, d, w in distances(rows).values():
        for i, name in enumerate(ids):
            near = np.array([d[i] <= r for r in RADII])
            assert found[name]["counts"] == near.sum(axis=1).tolist()
            assert np.allclose(found[name]["sums"], near @ w)
    profile = {(r["pattern_id"], r["ir"]): r for r in ranges.range_profile(df, RADII, weight="w").collect()}
    for k, (_, d, w) in distances(rows).items():
        for ir, r in enumerate(RADII):
            c = (d <= r).sum(axis=1)
            got = profile[k, ir]
            assert (got["n"], got["c1"], int(got["c2"])) == (len(w), c.sum(), (c**2).sum())
            assert np.allclose((got["w"], got["v"]), (w.sum(), w @ (d <= r) @ w))
    assert ranges.range_counts(df.limit(0), RADII).count() == 0


def test_counts_of_points_without_a_place(patterns):
    _, df = patterns
    found = pairs.neighbour_counts(df, [10.0, 1e6]).where("point_id > 9000").collect()
    assert len(found) == 6 and all(r["c"] == 0 for r in found)


def test_thresholds_are_the_roots():
    radii = np.array([0.0, 0.1, 1 / 3, 250.0, 12345.678])
    t = ranges.thresholds(radii)
    assert (np.sqrt(t) <= radii).all() and (np.sqrt(np.nextafter(t, np.inf)) > radii).all()


def test_crowded_tiles(spark, patterns, monkeypatch):
    """Every tile holds TILE points or fewer, however many share a place."""
    rows, df = patterns
    keys = list(ranges.KEYS)
    finite = ranges.finite_points(df)
    tiles = ranges.tiled(finite, ranges.crowded(finite, keys, 40), keys, 40)
    sizes = tiles.groupBy("pattern_id", "tile").count().collect()
    assert {r["pattern_id"] for r in sizes} == {3, 4} and sum(r["count"] for r in sizes) == 900
    assert sum(r["count"] > 60 for r in sizes) == 0  # dealt by a hash, so about 40 where all share one place


@pytest.mark.parametrize("small", [512, 20])
def test_nearest_neighbours(patterns, monkeypatch, small):
    monkeypatch.setattr(pairs, "SMALL", small)
    rows, df = patterns
    got = {(r["point_id"], r["k"]): r["d"] for r in pairs.knn_distances(df, (1, 2, 5)).collect()}
    want = {(name, k): np.sort(d[i])[k - 1] for ids, d, _ in distances(rows).values() for k in (1, 2, 5) if len(ids) > k for i, name in enumerate(ids)}
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x]) for x in want)


def test_ball_counts_and_l_share_one_profile(patterns):
    rows, df = patterns
    balls, curve, area = [0.1, 0.5, 2.0], [0.0, 0.25, 1.0], 9e6
    profile = metrics.radius_profile(df, [*balls, *curve], weight="w").persist()
    key = lambda df: sorted(map(str, df.collect()))
    both = metrics.ball_counts(profile, balls)
    assert key(both.where("occupancy = 'all'")) == key(metrics.ball_count(df, balls))
    assert key(both.where("occupancy <> 'all'")) == key(metrics.ball_count(df, balls, by_occupancy=True))
    one = {r["r"]: r for r in metrics.ball_count(df, balls).collect() if r["source"] == "a"}
    every = np.concatenate([[(d[i] <= 500.0).sum() for i in range(len(ids))] for ids, d, _ in distances(rows).values()])
    assert np.isclose(one[0.5]["mean"], every.mean()) and np.isclose(one[0.5]["se"], every.std(ddof=1) / len(every) ** 0.5)
    for weight in (None, "w"):
        got = {r["r"]: r["L"] for r in metrics.average_l(None, curve, area, weight=weight, profile=profile).collect()}
        for r in curve:
            each = [np.sqrt((area / w.sum() / area * (w @ (d <= 1000 * r) @ w) if weight else area / (len(w) * (len(w) - 1)) * (d <= 1000 * r).sum()) / np.pi) / 1000 for _, d, w in distances(rows).values() if len(w) > 1]
            assert np.isclose(got[r], np.mean(each))
    profile.unpersist()


@pytest.mark.parametrize("erode,pin", [(False, True), (True, True), (True, False)])
def test_profile_over_tiles(patterns, monkeypatch, erode, pin):
    """A pattern in tiles has the value it has as a whole, for both models, all radii and two images."""
    _, df = patterns
    window = (0.0, 0.0, 3000.0, 3000.0)
    q = gibbs.Quadrature(window, 24, 20, erode, pin)
    raster = intensity.kde_intensity(df, window, 24, 20, [300.0, 700.0]).persist()
    for kind, alphas in (("strauss", [-1.0, 0.2]), ("dgs", [2.0])):
        out = []
        for tile in (4096, 64):
            monkeypatch.setattr(ranges, "TILE", tile)
            out.append({(r["h"], r["ir"], r["r"], r["ia"], r["alpha"]): r["logcpl"] for r in gibbs.profile(df, raster, q, [100.0, 300.0], alphas, kind).collect()})
        assert out[0].keys() == out[1].keys() and len(out[0]) == 4 * len(alphas)
        assert all(np.isclose(out[0][k], out[1][k], rtol=1e-10) for k in out[0])
    raster.unpersist()
