"""Hand fixtures, invariants, and NumPy brute force for the operators that SQL cannot state."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.operators import cleaning, dpp, gibbs, grid, intensity, metrics, pairs, profiles


def pattern(spark, points, source="A", pattern_id=1):
    rows = [(source, pattern_id, i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "source string, pattern_id long, point_id long, x double, y double")


def test_nearest_neighbours(spark):
    pts = pattern(spark, [(0, 0), (3, 4), (6, 8)])
    by = lambda k: [r["d"] for r in pairs.knn_distance(pts, k).orderBy("point_id").collect()]
    assert by(1) == [5, 5, 5]
    assert by(2) == [10, 5, 10]
    assert [r["c"] for r in pairs.neighbour_counts(pts, [5.0]).orderBy("point_id").collect()] == [1, 2, 1]
    assert [r["c"] for r in pairs.neighbour_counts(pts, [1.0, 100.0]).where("ir = 1").collect()] == [2, 2, 2]


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_neighbours_in_uneven_patterns(spark, monkeypatch, k):
    monkeypatch.setattr(pairs, "SMALL", 16)
    rng = np.random.default_rng(3)
    shapes = {
        1: rng.normal(size=(200, 2)),
        2: np.r_[rng.normal(size=(150, 2)) * 1e-4, rng.normal(size=(40, 2)) * 100],  # a crowd and far points
        3: rng.integers(0, 7, (150, 2)),  # twins on a lattice
        4: np.ones((30, 2)),
        5: np.c_[rng.normal(size=60), np.zeros(60)],
        6: np.array([(0, 0), (3, 4)]),
    }
    pts = None
    for number, xy in shapes.items():
        one = pattern(spark, xy.tolist(), pattern_id=number)
        pts = one if pts is None else pts.unionByName(one)
    nowhere = spark.createDataFrame([("A", 1, 999, None, 1.0), ("A", 1, 998, float("nan"), 1.0)], pts.schema)
    found = {(r["pattern_id"], r["point_id"]): r["d"] for r in pairs.knn_distance(pts.unionByName(nowhere), k).collect()}
    wanted = {}
    for number, xy in shapes.items():
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=-1))
        np.fill_diagonal(d, np.inf)
        if len(xy) > k:
            wanted |= {(number, i): v for i, v in enumerate(np.sort(d, axis=1)[:, k - 1])}
    assert found.keys() == wanted.keys()
    assert all(found[key] == pytest.approx(wanted[key]) for key in wanted)


def test_small_patterns(spark):
    one, twins = pattern(spark, [(1, 1)]), pattern(spark, [(1, 1), (1, 1)])
    assert pairs.knn_distance(one, 1).count() == 0
    assert [r["c"] for r in pairs.neighbour_counts(one, [1.0]).collect()] == [0]
    assert [r["d"] for r in pairs.knn_distance(twins, 1).collect()] == [0, 0]
    assert [r["s"] for r in gibbs.point_stat(twins, 5.0, "strauss").collect()] == [0, 0]
    assert pairs.ordered_pairs(one.limit(0), 5.0).count() == 0


def test_bucketed_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    pts = pattern(spark, rng.integers(-50, 50, (80, 2)).tolist())
    near = {(r["i"], r["j"], r["d2"]) for r in pairs.ordered_pairs(pts, 17.0).collect()}
    assert near == {(r["i"], r["j"], r["d2"]) for r in pairs.ordered_pairs(pts).where("d2 <= 289").collect()}


def test_crops_and_erosion(spark):
    pts = pattern(spark, [(0, 0), (10, 5), (10, 10), (11, 5)])
    assert cleaning.crop(pts, (0, 0, 10, 10)).count() == 3
    assert cleaning.crop_half_open(pts, (0, 10, 0, 10)).count() == 1
    assert cleaning.erode((0, 0, 10, 10), 2) == (2, 2, 8, 8)
    assert cleaning.erode((0, 0, 10, 10), -1) == (0, 0, 10, 10)


def test_dedup_keeps_by_sequence(spark):
    df = spark.createDataFrame([(1, 7, 0, 5.0), (1, 7, 1, 6.0), (1, 8, 2, None)], "t long, o long, seq long, x double")
    assert [r["x"] for r in cleaning.dedup_in_snapshot(df, "t", "o", "seq").orderBy("o").collect()] == [6.0, None]
    assert [r["x"] for r in cleaning.dedup_in_snapshot(df, "t", "o", "seq", "first").where("o = 7").collect()] == [5.0]
    assert cleaning.drop_missing(df.withColumn("y", F.lit(float("nan"))), ["y"]).count() == 0


def test_occupancy_borders(spark):
    df = spark.createDataFrame([(30,), (31,), (60,), (61,)], "n int")
    assert [r[0] for r in df.select(metrics.occupancy_class(F.col("n"))).collect()] == ["low", "med", "med", "high"]


def test_histogram_density_integrates_to_one(spark):
    pts = pattern(spark, [(0, 0), (0, 1000), (0, 3000), (0, 7000)])
    got = metrics.nn_distance_density(pairs.knn_distance(pts, 1), [0.0, 1.0, 2.0, 5.0]).orderBy("r").collect()
    assert [round(r["density"], 6) for r in got] == [0.5, 0.25, round(0.25 / 3, 6)]


def test_local_maxima(spark):
    rows = [("rise", i, s) for i, s in enumerate([1, 2, 3])] + [("fall", i, s) for i, s in enumerate([3, 2, 1])] + [("peak", i, s) for i, s in enumerate([1, 5, 2, 9])] + [("flat", i, 1) for i in range(3)]
    df = spark.createDataFrame([(g, i, float(s)) for g, i, s in rows], "g string, i int, s double")
    assert {(r["g"], r["i"]) for r in profiles.local_maxima(df, "s", "i", ["g"]).collect()} == {("rise", 2), ("fall", 0), ("peak", 1), ("peak", 3)}
    assert {(r["g"], r["i"]) for r in profiles.best_interior(df, "s", "i", ["g"]).collect()} == {("rise", 2), ("fall", 0), ("peak", 1), ("flat", 0)}


def test_assign_grid_ties_and_borders(spark):
    cells = spark.createDataFrame([(i % 3, i // 3, float(i % 3), float(i // 3)) for i in range(6)], "x_rounded int, y_rounded int, x double, y double")
    pts = spark.createDataFrame([(0.5, 0.5), (9.0, -4.0), (1.6, 1.0)], "px double, py double")
    got = grid.assign_grid(pts, cells, "px", "py").collect()
    assert [r["grid_index"] for r in got] == [0, 2, 5]


def test_unknown_cell_is_an_error(spark):
    cells = spark.createDataFrame([(0, 0.5, 0.5)], "grid_index int, x double, y double")
    with pytest.raises(ValueError):
        grid.cells_to_physical(spark.createDataFrame([(4,)], "grid_index int"), cells)
    with pytest.raises(ValueError):
        grid.make_grid(spark, (0.0, 0.0, 0.0, 1.0), 2, 2)


def test_infer_window(spark):
    pts = pattern(spark, [(0, 0), (100, 0)])
    assert grid.infer_window(pts) == (-1.0, -1.0, 101.0, 1.0)
    assert grid.infer_window(pts, 0.5) == (-0.5, -0.5, 100.5, 0.5)
    assert grid.infer_window(pts.limit(0)) == (0.0, 0.0, 1.0, 1.0)


def test_kde_against_brute_force(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((30, 2)) * 10
    window, h = (0.0, 0.0, 10.0, 10.0), 1.5
    got = intensity.kde_intensity(pattern(spark, xy.tolist()), window, 4, 3, [h]).orderBy("grid_index").toPandas()
    u = intensity.centres(window, 4, 3)
    k = np.exp(-((xy[:, None] - u[None]) ** 2).sum(2) / (2 * h * h)).sum(0) / (2 * math.pi * h * h)
    phi = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
    edge = np.prod([phi((10 - u[:, i]) / h) - phi((0 - u[:, i]) / h) for i in (0, 1)], axis=0)
    assert np.allclose(got["value"], k / edge)
    assert intensity.kde_intensity(pattern(spark, [(99, 99)]), window, 4, 3, [h]).agg(F.sum("value")).first()[0] == 0


def _direct_cpl(xy, b, u, bu, area, r, alpha, kind):
    def delta(d):
        return np.where(d <= r, 1.0 if kind == "strauss" else 2 * np.log(np.maximum(np.sin(np.pi * d / (2 * r)), 1e-12)), 0.0)

    dxu = delta(np.linalg.norm(xy[:, None] - u[None], axis=2))
    apart = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    dxx = np.where(apart > 0, delta(apart), 0.0)  # neither a point nor its twins
    s = dxu.sum(0)
    return sum(b[i] + alpha * dxx[i].sum() - np.log(area * np.exp(bu + alpha * (s - dxu[i])).sum()) for i in range(len(xy)))


@pytest.mark.parametrize("kind, alpha", [("strauss", math.log(0.3)), ("dgs", 1.7)])
def test_profile_equals_direct_sum_and_dataframe_form(spark, kind, alpha):
    rng = np.random.default_rng(3)
    xy = rng.random((12, 2)) * [20, 10]
    pts, q = pattern(spark, xy.tolist()), gibbs.Quadrature((0.0, 0.0, 20.0, 10.0), 8, 4)
    image = rng.random((4, 8)) + 0.5
    raster = spark.createDataFrame([(1.0, x, y, float(image[y, x])) for y in range(4) for x in range(8)], "h double, ix int, iy int, value double")
    u = intensity.centres(q.window, 8, 4)
    b, bu = (np.log(gibbs._bilinear(image, q.window, p)) for p in (xy, u))
    want = _direct_cpl(xy, b, u, bu, 200 / 32, 3.0, alpha, kind)
    assert gibbs.profile(pts, raster, q, [3.0], [alpha], kind).first()["logcpl"] == pytest.approx(want)
    assert gibbs.cpl(pts, raster.drop("h"), q, 3.0, alpha, kind).first()["logcpl"] == pytest.approx(want)


@pytest.mark.parametrize("kind", ["strauss", "dgs"])
@pytest.mark.parametrize("erode, pin, fixed", [(False, True, None), (True, True, None), (True, True, 2.0), (True, False, None)])
def test_profile_in_parts_equals_direct_sum(monkeypatch, kind, erode, pin, fixed):
    monkeypatch.setattr(gibbs, "DISTANCES", 160)
    rng = np.random.default_rng(5)
    xy = np.r_[rng.random((24, 2)) * [20, 10], [[10.0, 5.0], [10.0, 5.0]]]
    q = gibbs.Quadrature((0.0, 0.0, 20.0, 10.0), 8, 4, erode, pin, fixed)
    images, radii, alphas = [(1.0, rng.random((4, 8)) + 0.5), (2.0, rng.random((4, 8)) + 0.5)], [1.0, 3.0], [-0.5, 0.0, 1.5]
    work = gibbs._Profiler(images, q, radii, alphas, kind)
    rows = [(h, radii[ir], alpha, value[i, k, ia]) for g, value in work.pattern(xy) for i, (h, _) in enumerate(images) for k, ir in enumerate(work.groups[g].at) for ia, alpha in enumerate(alphas)]
    got = pd.DataFrame(rows, columns=["h", "r", "alpha", "logcpl"])
    assert len(got) == 12
    for row in got.itertuples():
        u, area, inner = gibbs._cells(q, row.r)
        inside = xy[(xy >= inner[:2]).all(axis=1) & (xy <= inner[2:]).all(axis=1)]
        b, bu = (np.log(gibbs._bilinear(dict(images)[row.h], q.window, p)) for p in (inside, u))
        assert row.logcpl == pytest.approx(_direct_cpl(inside, b, u, bu, area, row.r, row.alpha, kind))


def test_no_interaction_is_poisson(spark):
    pts, q = pattern(spark, [(2, 2), (3, 3), (9, 4)]), gibbs.Quadrature((0.0, 0.0, 10.0, 10.0), 4, 4)
    raster = spark.createDataFrame([(1.0, x, y, 2.0) for y in range(4) for x in range(4)], "h double, ix int, iy int, value double")
    assert gibbs.profile(pts, raster, q, [2.0], [0.0], "strauss").first()["logcpl"] == pytest.approx(-3 * math.log(100.0))
    eroded = q._replace(erode=True)
    assert gibbs.profile(pts, raster, eroded, [2.4], [0.0], "strauss").first()["logcpl"] == pytest.approx(-math.log(4 * 6.25))


def test_elementary_symmetric():
    assert np.allclose(np.exp(dpp.log_elementary_symmetric(np.array([1.0, 2.0, 3.0]), 3)), [1, 6, 11, 6])
    lam = np.array([2.0, 0.5, -1e-18])
    assert np.allclose(np.exp(dpp.log_elementary_symmetric(lam, 2)), [1, 2.5, 1.0])


@pytest.mark.parametrize("conditioned", [True, False])
def test_determinantal_loglik(spark, conditioned):
    cells = [(x, y) for y in range(2) for x in range(3)]
    rho = np.array([0.5, 0.7, 0.9, 0.4, 0.6, 0.8])
    table = spark.createDataFrame([(1.0, i, x, y, float(rho[i])) for i, (x, y) in enumerate(cells)], "h double, cell int, ix int, iy int, rho double")
    picked = {1: [0, 4], 2: [1, 2, 5], 3: [3]}
    samples = spark.createDataFrame([("A", p, c) for p, cs in picked.items() for c in cs], "source string, pattern_id long, cell int")
    ix, iy = np.array(cells, float).T
    kernel = dpp._kernel(ix, iy, rho, 0.8)
    det = sum(np.linalg.slogdet(kernel[np.ix_(c, c)] + 1e-8 * np.eye(len(c)))[1] for c in picked.values())
    eigen = np.linalg.eigvalsh(kernel)
    e = dpp.log_elementary_symmetric(eigen, 3)
    norm = e[2] + e[3] + e[1] if conditioned else 3 * np.log1p(eigen).sum()
    got = dpp.loglik(samples, table, [0.8], conditioned, 1e-8).first()
    assert got["ll"] == pytest.approx(det - norm)


def test_diagonal_kernel_has_closed_form(spark):
    table = spark.createDataFrame([(1.0, i, 100 * i, 0, 0.5) for i in range(4)], "h double, cell int, ix int, iy int, rho double")
    samples = spark.createDataFrame([("A", 1, 0), ("A", 1, 2)], "source string, pattern_id long, cell int")
    got = dpp.loglik(samples, table, [0.1], False, 1e-12).first()["ll"]
    assert got == pytest.approx(2 * math.log(0.25) - 4 * math.log1p(0.25))


@pytest.mark.parametrize("value", ["id", "cast(id as timestamp)", "lpad(cast(id as string), 5, '0')"])
def test_positions(spark, value):
    rows = spark.range(0, 3000, 3).selectExpr(f"{value} t", "id")
    assert cleaning.positions(rows, ["t"], "at").where("at <> id / 3").count() == 0
    assert cleaning.positions(rows, ["t"], "at").count() == 1000
    assert cleaning.positions(rows.limit(0), ["t"], "at").count() == 0


def test_folds_are_balanced_and_repeat(spark):
    df = spark.range(23).withColumnRenamed("id", "pattern_id")
    one, two = (cleaning.assign_folds(df, "pattern_id", 5, 1).orderBy("pattern_id").collect() for _ in range(2))
    assert one == two
    sizes = np.bincount([r["fold"] for r in one])
    assert sizes.max() - sizes.min() <= 1


def test_assign_grid_with_a_hole_and_without_coordinates(spark):
    cells = spark.createDataFrame([(0.0, 0.0), (10.0, 0.0), (20.0, 10.0), (0.0, 10.0)], "x double, y double")
    rows = [(1, 9.0, 9.0), (2, 19.0, 1.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 1.0, 11.0), (6, 5.0, 0.0)]
    got = {r["i"]: r for r in grid.assign_grid(spark.createDataFrame(rows, "i int, px double, py double"), cells, "px", "py").collect()}
    # (10, 10) is no cell: of (0, 10), (10, 0) and (20, 10) the first row by row that is nearest; (20, 0) is none either
    assert [(got[i]["x_grid"], got[i]["y_grid"], got[i]["grid_index"]) for i in (1, 2, 5, 6)] == [(0.0, 0.0, 0), (10.0, 0.0, 1), (0.0, 10.0, 3), (0.0, 0.0, 0)]
    assert all(got[i]["grid_index"] is None and got[i]["x_grid"] is None for i in (3, 4))
    with pytest.raises(ValueError):
        grid.assign_grid(cells, cells.limit(0), "x", "y")


@pytest.mark.parametrize("radii", [[0.5, 1.0, 2.0], [0.1 * i for i in range(301)], [0.05 * 1.2**i for i in range(50)], [0.0, 1.0, 1.5, 4.0, 9.0, 9.5, 10.0, 11.0, 12.0, 30.0]])
def test_first_radius(spark, radii):
    rng = np.random.default_rng(0)
    ds = [*rng.uniform(0, radii[-1] * 1.1, 300), *radii, *[np.nextafter(r, 99) for r in radii], 0.0]
    found = spark.createDataFrame([(float(d),) for d in ds], "d double").select("d", pairs.first_radius(F.col("d"), radii).alias("i")).collect()
    for r in found:
        at = int(np.searchsorted(radii, r["d"]))
        assert r["i"] == (at if at < len(radii) else None)


def test_likelihood_given_sizes(spark):
    """Samples of any size against sums over all subsets."""
    rng = np.random.default_rng(3)
    rho = rng.uniform(0.1, 2.0, 6)
    samples = [[0], [1, 4], [2, 3, 5], [0, 1], [0, 1, 2, 3, 4, 5]]
    want = sum(np.log(rho[s]).sum() - np.log(sum(np.prod(rho[list(c)]) for c in itertools.combinations(range(6), len(s)))) for s in samples)
    raster = spark.createDataFrame([(1.0, i, float(v)) for i, v in enumerate(rho)], "h double, cell int, rho double")
    counts = spark.createDataFrame([(i, sum(i in s for s in samples)) for i in range(6)], "cell int, c long")
    sizes = spark.createDataFrame([(k, sum(len(s) == k for s in samples)) for k in (1, 2, 3, 6)], "k long, t long")
    shared = lambda df: df.withColumn("fold", F.lit(0))
    got = intensity.diag_loglik(shared(raster), shared(counts), shared(sizes), ["fold", "h"], True).first()["ll"]
    assert abs(got - want) < 1e-6


def test_automatic_bandwidth(spark):
    rng = np.random.default_rng(4)
    placed = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(np.clip(rng.normal(5, 1.5, (200, 2)), 0, 9))], "point_id long, ix int, iy int")
    best = intensity.select_bandwidth_discrete(placed, 10, 10, intensity.AUTO_HS).orderBy(F.desc("ll"), "idx").first()["h"]
    got = intensity.estimate_intensity_auto(placed, 10, 10).orderBy("iy", "ix").toPandas()
    plain = intensity.estimate_intensity(placed.groupBy("ix", "iy").agg(F.count("*").alias("c")), 10, 10, [best]).orderBy("iy", "ix").toPandas()
    assert got["h"].unique().tolist() == [best] and np.allclose(got["value"], plain["value"])
    with pytest.raises(ValueError):
        intensity.estimate_intensity_auto(placed.limit(0), 10, 10)
    with pytest.raises(ValueError):
        intensity.estimate_intensity(placed.groupBy("ix", "iy").agg(F.count("*").alias("c")), 10, 10, [0.0])
