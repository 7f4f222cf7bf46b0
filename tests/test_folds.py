"""Cross-validation with folds as a column, against fold after fold."""

import numpy as np
import pytest

from footfall.operators import cleaning, dpp, gibbs, intensity
from footfall.operators.profiles import best_interior
from footfall.sources.tables import read_patterns_csv, write_metrics

WINDOW = (0.0, 0.0, 4000.0, 2000.0)
Q = gibbs.Quadrature(WINDOW, 12, 6)
C = gibbs.Candidates([0.5, 1.0, 1.5], [200.0, 400.0, 800.0], [200.0, 400.0], [-1.0, -0.2])


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = [("a", k, 100 * k + i, float(rng.random() * 4000), float(rng.random() ** 2 * 2000)) for k in range(9) for i in range(int(rng.integers(3, 12)))]
    df = spark.createDataFrame(rows, "source string, pattern_id long, point_id long, x double, y double")
    return df.selectExpr("*", "cast(floor(x / 400) as int) as ix", "cast(floor(y / 400) as int) as iy").persist()


@pytest.fixture(scope="module")
def folded(points):
    return cleaning.assign_folds(points, "pattern_id", 3, 1).persist()


def test_pilots(points, folded):
    got = intensity.lcv_bandwidths(folded, 3, C.pilots, max_n=20)
    parts = [cleaning.members(folded, [f], train=True) for f in range(3)] + [points]
    assert got == [intensity.lcv_bandwidth(p, C.pilots, max_n=20) for p in parts]
    hs = [0.5, 1.0, 3.0]
    assert intensity.select_bandwidths(folded, 3, 10, 5, hs) == {f: dpp.pilot_bandwidth(p, 10, 5, hs) for f, p in zip((0, 1, 2, -1), parts)}


@pytest.mark.parametrize("kind", ["strauss", "dgs"])
def test_pair_models(folded, kind):
    pilots = {0: 400.0, 1: 200.0, 2: 400.0}
    c = C if kind == "strauss" else C._replace(alphas=[0.5, 2.0])
    got = gibbs.run_folds(folded, 3, pilots, Q, kind, c)
    want = []
    for f in range(3):
        train, test = cleaning.members(folded, [f], train=True), cleaning.members(folded, [f])
        r, alpha, surface = gibbs.reestimate(train, pilots[f], Q, kind, c)
        surface.unpersist()
        hs = [pilots[f] * x for x in c.coeffs]
        scores = {x["h"]: x["logcpl"] for x in gibbs.evaluate_bandwidths(train, test, hs, r, alpha, Q, kind).collect()}
        want += [(f, i, h, scores[h], pilots[f], r, alpha) for i, h in enumerate(hs)]
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-10)


@pytest.mark.parametrize("conditioned", [True, False])
def test_determinantal_model(points, conditioned):
    sigmas, coeffs = [0.3, 0.6, 0.9], [0.5, 1.0]
    found = dpp.cross_validate(points, 10, 5, 3, 1.0, conditioned, coeffs=coeffs, sigmas=sigmas)
    folded = cleaning.assign_folds(points, "pattern_id", 3, 1)
    for f in range(3):
        train, test = cleaning.members(folded, [f], train=True), cleaning.members(folded, [f])
        sigma = best_interior(dpp.sigma_profile(train, 10, 5, 1.0, sigmas), "ll", "isig", ["h"]).first()["sigma"]
        scores = {x["h"]: x["ll"] for x in dpp.evaluate_bandwidths(train, test, 10, 5, coeffs, sigma, conditioned).collect()}
        mine = found["folds"].where(f"fold = {f}").orderBy("idx").collect()
        assert [x["sigma"] for x in mine] == [sigma] * 2 and np.allclose([x["ll"] for x in mine], [scores[h] for h in coeffs])


def test_the_number_of_jobs_does_not_depend_on_the_folds(spark, points):
    counts = []
    for k in (2, 4):
        folded = cleaning.assign_folds(points, "pattern_id", k, 1).persist()
        folded.count()
        spark.sparkContext.setJobGroup(f"folds-{k}", "")
        gibbs.run_folds(folded, k, dict.fromkeys(range(k), 400.0), Q, "strauss", C)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{k}")))
        folded.unpersist()
    spark.sparkContext.setJobGroup("", "")
    assert counts[0] == counts[1]


def test_headers_by_file(spark, tmp_path):
    """Columns in any order, quotes, a byte order mark, blank lines; a file without a header is an error."""
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("pattern_id,cell_id,x,y\n1,7,0,0\n1,7,5,5\n\n2,8,0,0\n")
    (folder / "b.csv").write_text('﻿"y","x","pattern_id"\n0.0,500.0,3\n')
    got = sorted(map(tuple, read_patterns_csv(spark, str(folder), None, 4, 4, x0=0.0, y0=0.0, dx=500.0, dy=500.0).collect()))
    assert got == [(1, 7), (2, 8), (3, 1)]
    (folder / "c.csv").write_text("4,1,1\n")
    with pytest.raises(Exception, match="no header"):
        read_patterns_csv(spark, str(folder), None, 4, 4, x0=0.0, y0=0.0, dx=500.0, dy=500.0).collect()


def test_stored_metrics_are_read_again(spark, tmp_path):
    path = f"file://{tmp_path}/metrics"
    write_metrics({"m": spark.range(3)}, path)
    assert write_metrics({"m": spark.range(5)}, path)["m"].count() == 3
    assert write_metrics({"m": spark.range(5)}, path, reuse=False)["m"].count() == 5


@pytest.mark.parametrize("kind", ["strauss", "dgs"])
def test_images_share_exponentials(kind, monkeypatch):
    """Several images of very unlike size in one profile, as one by one; and no more exponentials for more of them."""
    rng = np.random.default_rng(8)
    images = [(float(i), rng.random((6, 12)) * 10.0 ** (4 - 4 * i)) for i in range(4)]
    xy = np.stack([rng.random(30) * 4000, rng.random(30) ** 3 * 2000], axis=1)
    alphas = [-3.0, -0.2] if kind == "strauss" else [0.0, 2.0, 10.0]
    sizes, exp = [], np.exp
    profile = lambda chosen: dict(gibbs._Profiler(chosen, Q, [150.0, 400.0, 2500.0], alphas, kind).pattern(xy))[0]
    together, apart = profile(images), np.concatenate([profile([image]) for image in images])
    assert np.allclose(together, apart, rtol=1e-12)
    monkeypatch.setattr(gibbs.np, "exp", lambda v, *a, **b: (sizes.append(np.size(v)), exp(v, *a, **b))[1])
    counts = []
    for chosen in (images[:1], images):
        sizes.clear()
        profile(chosen)
        counts.append(sum(sizes))
    assert counts[1] < 1.5 * counts[0] + 4 * Q.nx * Q.ny
