"""Stacked log-determinants against one matrix at a time, and the number of tasks' rows."""

import numpy as np
import pytest

from footfall.operators import dpp

NX, NY = 6, 4


@pytest.mark.parametrize("jitter", [1e-6, -5e-3])
def test_samples_under_rasters_with_holes(spark, jitter, monkeypatch):
    """A negative jitter makes some matrices of a stack not positive definite; a raster may lack cells."""
    monkeypatch.setattr(dpp, "NUMBERS", 70)
    rng = np.random.default_rng(5)
    rho = {0.0: rng.random(24) + 0.1, 1.0: rng.random(24) / 9 + 0.01, 2.0: rng.random(24) + 0.1}
    rows = [(h, c, c % NX, c // NX, float(v[c])) for h, v in rho.items() for c in range(24) if not (h == 2.0 and c % 3 == 0)]
    rasters = spark.createDataFrame(rows, "h double, cell int, ix int, iy int, rho double")
    samples = {(k, k % 2): sorted(map(int, rng.choice(24, size=3 + k, replace=False))) for k in range(6)}
    cells = spark.createDataFrame([("a", k, f, c) for (k, f), own in samples.items() for c in own], "source string, pattern_id long, fold int, cell int")
    sigmas, uses = {0.0: [0.4, 0.9, 2.0], 1.0: [0.4, 0.9, 2.0], 2.0: [0.7]}, {0: [0.0, 1.0], 1: [2.0, 0.0]}
    got = sorted((r["h"], r["isig"], r["k"], round(r["logdet"], 9)) for r in dpp.sample_logdet(cells, rasters, sigmas, jitter, uses=uses).collect())
    want = []
    for (_, f), own in samples.items():
        for h in uses[f]:
            held = np.array([c for c in own if not (h == 2.0 and c % 3 == 0)])
            want += [(h, i, len(held), round(dpp.log_det(dpp._kernel(held % NX, held // NX, rho[h][held], s), jitter), 9)) for i, s in enumerate(sigmas[h])]
    assert got == sorted(want)


def test_tasks_hand_on_sums_not_samples(spark):
    """As many rows as sizes, rasters and sigmas, not as samples."""
    cells = spark.range(600).selectExpr("'a' as source", "id div 3 as pattern_id", "cast(id % 3 + 5 * (id div 300) as int) as cell")
    rasters = dpp._rasters(spark.range(24).selectExpr("0D as h", "cast(id as int) as cell", "cast(id % 6 as int) as ix", "cast(id div 6 as int) as iy", "0.5D as rho"))
    found = dpp._scored_samples(cells.coalesce(1), rasters, [0.3, 0.6], 1e-6, dpp.KEYS, None, True).collect()
    assert sum(r["n"] for r in found) == 2 * 200 and len(found) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
