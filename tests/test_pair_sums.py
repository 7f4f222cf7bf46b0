"""Counts and sums of close pairs by places, against all pairs of rows."""

import numpy as np
import pytest

from footfall.operators import pairs, ranges


@pytest.mark.parametrize("tile", [4096, 9])
def test_pair_sums(spark, tile, monkeypatch):
    """Coincident points, rows that share an id at one place or at two, far places, a pattern without pairs."""
    monkeypatch.setattr(ranges, "TILE", tile)
    monkeypatch.setattr(pairs, "FEW", 0 if tile == 9 else pairs.FEW)
    rng = np.random.default_rng(6)
    rows = [(g, int(rng.integers(0, 60)), int(rng.integers(0, 9)), int(rng.integers(-4, 30))) for g in "ab" for _ in range(120)]
    rows += [("c", 1, 0, 0), ("c", 1, 0, 0), ("c", 2, 50, 50)]
    points = spark.createDataFrame(rows, "flag string, point_id long, x long, y long")
    want = {}
    for k, a in enumerate(rows):
        for b in rows[:k]:
            d2 = (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
            if a[0] == b[0] and a[1] != b[1] and d2 <= 16:
                n, s = want.get(a[0], (0, 0))
                want[a[0]] = n + 1, s + d2
    assert {r["flag"]: (r["n_pairs"], r["sum_d2"]) for r in pairs.close_pair_sums(points, 4.0, ["flag"]).collect()} == want


def test_copies(spark):
    """Thirty points at each place."""
    points = spark.range(3000).selectExpr("'a' as flag", "id as point_id", "id % 100 as x", "0L as y")
    found = pairs.close_pair_sums(points, 1.0, ["flag"]).first()
    assert (found["n_pairs"], found["sum_d2"]) == (100 * 30 * 29 // 2 + 99 * 900, 99 * 900)
