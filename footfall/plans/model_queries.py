"""Queries over intensity estimation and the two kinds of models (I1-I12, P1-P11, D1-D10). Coarse candidate grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import dpp, gibbs, grid, intensity
from ..operators.metrics import clip_at_percentile
from . import fixtures as fx
from .fixtures import sql
from .support import Query, register, rounded

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
QX, QY = 16, 8
QUAD = gibbs.Quadrature(fx.WINDOW, QX, QY)
ALPHAS = {"strauss": [math.log(0.25), math.log(0.5)], "dgs": [1.0, 2.5]}
RADII = [400.0, 800.0]
HS = [0.5, 1.0, 2.0]
_HS = "(VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) t(h)"
_KDE_HS = "(VALUES (500.0::DOUBLE), (1000.0::DOUBLE)) t(h)"
_Q = "SELECT CAST(i AS INT) AS u, CAST(i % 16 AS INT) AS ix, CAST(i // 16 AS INT) AS iy, (i % 16 + 0.5) * 1250.0::DOUBLE AS ux, (i // 16 + 0.5) * 1250.0::DOUBLE AS uy FROM range(128) r(i)"
_COARSE = "SELECT q.ix, q.iy, count(point_id) + 1.0::DOUBLE AS value FROM q LEFT JOIN pts ON least(x // 1250, 15) = q.ix AND least(y // 1250, 7) = q.iy GROUP BY 1, 2"


def query(oracle: str | None = None):
    return register(QUERIES, ORACLE_SQL, oracle)


def _coarse(points: DataFrame) -> DataFrame:
    """Counts plus one on the 16 x 8 grid, as an intensity raster."""
    spark = points.sparkSession
    at = points.groupBy(F.least(F.expr("x div 1250"), F.lit(15)).cast("int").alias("ix"), F.least(F.expr("y div 1250"), F.lit(7)).cast("int").alias("iy")).agg(F.count("*").alias("c"))
    return grid.make_grid(spark, fx.WINDOW, QX, QY).select("ix", "iy").join(at, ["ix", "iy"], "left").select(F.lit(0.0).alias("h"), "ix", "iy", (F.coalesce("c", F.lit(0)) + 1.0).alias("value"))


def _lookup(x: str, y: str) -> str:
    """Bilinear value of `coarse` at x, y as four joins over the fractional cell."""
    return f"""(SELECT sum(value * CASE WHEN c.ix = floor(fx)::INT THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END * CASE WHEN c.iy = floor(fy)::INT THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END)
        FROM coarse c, (SELECT least(greatest({x} / 20000.0::DOUBLE * 15, 0), 15 - 1e-6) AS fx, least(greatest({y} / 10000.0::DOUBLE * 7, 0), 7 - 1e-6) AS fy)
        WHERE c.ix IN (floor(fx)::INT, floor(fx)::INT + 1) AND c.iy IN (floor(fy)::INT, floor(fy)::INT + 1))"""


_BASE = {"q": _Q, "coarse": _COARSE}


@query(sql("SELECT h, u AS grid_index, round(coalesce(sum(exp(-((x - ux) ** 2 + (y - uy) ** 2) / (2 * h * h)) / (2 * pi() * h * h)), 0) * 1e6, 6) AS value FROM q CROSS JOIN " + _KDE_HS + " CROSS JOIN pts GROUP BY 1, 2", "pts", q=_Q))
def kde_intensity_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intensity.kde_intensity(fx.points(spark, sf_dir), fx.WINDOW, QX, QY, [500.0, 1000.0], edge=False)
    return rounded(found.select("h", "grid_index", (F.col("value") * 1e6).alias("value")))


@query()
def kde_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the edge factor, which needs the error function."""
    found = intensity.kde_intensity(fx.points(spark, sf_dir), fx.WINDOW, QX, QY, [500.0, 1000.0])
    return rounded(found.select("h", "grid_index", (F.col("value") * 1e6).alias("value")))


@query(sql("SELECT idx, h, round(avg(ln(f)), 6) AS score FROM (SELECT idx, h, a.point_id, sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (2 * h * h))) / (2 * pi() * h * h * ((SELECT count(*) FROM s) - 1)) AS f FROM s a JOIN s b ON a.point_id <> b.point_id CROSS JOIN (VALUES (0, 500.0::DOUBLE), (1, 1000.0)) t(idx, h) GROUP BY 1, 2, 3) GROUP BY 1, 2", "pts",
    s="SELECT * FROM pts ORDER BY md5('1-' || point_id), point_id LIMIT 2000"))
def lcv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out scores on the sample of 2,000 points that is the operator's own bound."""
    return rounded(intensity.lcv_scores(fx.points(spark, sf_dir), [500.0, 1000.0]))


_LATTICE = {
    "wx": f"SELECT h, i, j, k / sum(k) OVER (PARTITION BY h, i) AS w FROM (SELECT h, a.i AS i, b.j AS j, exp(-0.5 * ((a.i - b.j) / h) ** 2) AS k FROM range(40) a(i), range(40) b(j), {_HS})",
    "wy": f"SELECT h, i, j, k / sum(k) OVER (PARTITION BY h, i) AS w FROM (SELECT h, a.i AS i, b.j AS j, exp(-0.5 * ((a.i - b.j) / h) ** 2) AS k FROM range(20) a(i), range(20) b(j), {_HS})",
}
_KDE = {
    "sh": "SELECT ix, iy, count(*) / (SELECT count(*)::DOUBLE FROM cells) AS p FROM cells GROUP BY 1, 2",
    "k1": "SELECT h, wx.i AS tx, iy, sum(p * w) AS p FROM sh JOIN wx ON wx.j = ix GROUP BY 1, 2, 3",
    "kde": "SELECT k1.h, tx AS ix, wy.i AS iy, sum(p * w) AS value FROM k1 JOIN wy ON wy.j = k1.iy AND wy.h = k1.h GROUP BY 1, 2, 3",
}


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(fx.points(spark, sf_dir)).groupBy("ix", "iy").agg(F.count("*").alias("c"))


@query(sql("SELECT h, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round(value * 1000, 6) AS value FROM kde", "cells", **_LATTICE, **_KDE))
def discrete_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.discrete_kde(_counts(spark, sf_dir), fx.NX, fx.NY, HS).withColumn("value", F.col("value") * 1000))


@query(sql("""SELECT k.h, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round((CASE WHEN ix >= 30 AND iy < 4 THEN 0 ELSE value END / s + 1e-10) * 1000, 6) AS value FROM kde k
    JOIN (SELECT h, sum(value) AS s FROM kde WHERE NOT (ix >= 30 AND iy < 4) GROUP BY 1) t ON t.h = k.h""", "cells", **_LATTICE, **_KDE))
def estimate_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = grid.create_mask(fx.grid(spark), fx.clean_grid(spark)).select(F.col("x_rounded").alias("ix"), F.col("y_rounded").alias("iy"), "masked")
    found = intensity.estimate_intensity(_counts(spark, sf_dir), fx.NX, fx.NY, HS, mask=mask, normalize=True)
    return rounded(found.withColumn("value", F.col("value") * 1000))


@query(sql("SELECT k.h, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, round((value / s + 1e-10) * 1000, 6) AS value FROM kde k JOIN (SELECT h, sum(value) AS s FROM kde GROUP BY 1) t ON t.h = k.h WHERE k.h = 1", "cells", **_LATTICE, **_KDE))
def grid_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intensity.grid_kde(_counts(spark, sf_dir), fx.NX, fx.NY, 1.0).withColumn("value", F.col("value") * 1000))


_CV = {
    "fo": "SELECT *, CAST((row_number() OVER (ORDER BY md5('1-' || pattern_id), pattern_id) - 1) % 3 AS INT) AS fold FROM (SELECT DISTINCT pattern_id FROM pts)",
    "dc": "SELECT DISTINCT pattern_id, fold, ix, iy FROM cells JOIN fo USING (pattern_id)",
    "own": "SELECT fold, ix, iy, count(*) AS c FROM dc GROUP BY 1, 2, 3",
    "tr": "SELECT f.fold, a.ix, a.iy, a.c - coalesce(o.c, 0) AS c FROM (SELECT DISTINCT fold FROM own) f CROSS JOIN (SELECT ix, iy, sum(c) AS c FROM own GROUP BY 1, 2) a LEFT JOIN own o ON o.fold = f.fold AND o.ix = a.ix AND o.iy = a.iy",
    "sh": "SELECT fold, ix, iy, c / sum(c::DOUBLE) OVER (PARTITION BY fold) AS p FROM tr",
    "k1": "SELECT fold, h, wx.i AS tx, iy, sum(p * w) AS p FROM sh JOIN wx ON wx.j = ix GROUP BY ALL",
    "rho": "SELECT fold, k1.h, tx AS ix, wy.i AS iy, sqrt(greatest(sum(p * w) + 1e-10, 1e-16)) AS rho FROM k1 JOIN wy ON wy.j = k1.iy AND wy.h = k1.h GROUP BY ALL",
    "nt": "SELECT fold, count(DISTINCT pattern_id) AS t FROM dc GROUP BY 1",
    "fit": "SELECT fold, h, sum(c * ln(rho + 1e-12)) AS fit FROM rho JOIN own USING (fold, ix, iy) GROUP BY 1, 2",
    "nrm": "SELECT fold, h, sum(ln(1 + rho)) AS nrm FROM rho GROUP BY 1, 2",
}


@query(sql("SELECT CAST(CASE h WHEN 0.5 THEN 0 WHEN 1.0 THEN 1 ELSE 2 END AS INT) AS idx, h, round(sum(fit - t * nrm), 4) AS ll FROM fit JOIN nrm USING (fold, h) JOIN nt USING (fold) GROUP BY h", "cells", **_LATTICE, **_CV))
def select_bandwidth_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = fx.cells(fx.points(spark, sf_dir))
    return rounded(intensity.select_bandwidth_discrete(placed, fx.NX, fx.NY, HS, 3, unit="pattern_id", per_point=False, conditioned=False), 4)


_SIZES = _CV | {
    "sz": "SELECT fold, k, count(*) AS t FROM (SELECT fold, pattern_id, count(*) AS k FROM dc GROUP BY 1, 2) GROUP BY 1, 2",
    "ek": "SELECT fold, h, list_reduce(list_prepend(list_transform(range(0, 201), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END), list([rho])), lambda a, b: list_transform(range(1, 202), lambda i: a[i] + b[1] * coalesce(a[i - 1], 0))) AS e FROM rho GROUP BY 1, 2",
    "paid": "SELECT fold, h, sum(t * ln(greatest(e[k + 1], 1e-12))) AS paid FROM ek JOIN sz USING (fold) GROUP BY 1, 2",
}


@query(sql("SELECT CAST(CASE h WHEN 0.5 THEN 0 WHEN 1.0 THEN 1 ELSE 2 END AS INT) AS idx, h, round(sum(fit - paid), 4) AS ll FROM fit JOIN paid USING (fold, h) GROUP BY h", "cells", **_LATTICE, **_SIZES))
def select_bandwidth_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole patterns as samples, given their sizes."""
    placed = fx.cells(fx.points(spark, sf_dir))
    return rounded(intensity.select_bandwidth_discrete(placed, fx.NX, fx.NY, HS, 3, unit="pattern_id", per_point=False), 4)


@query()
def intensity_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity with a bandwidth chosen by cross-validation, fitted again on all points."""
    return rounded(intensity.estimate_intensity_auto(fx.cells(fx.points(spark, sf_dir)), fx.NX, fx.NY, normalize=True, edge_correction=True))


@query()
def select_bandwidth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point a sample of its own, folds by a hash of the point."""
    return rounded(intensity.select_bandwidth_discrete(fx.cells(fx.points(spark, sf_dir)), fx.NX, fx.NY, HS, 3), 4)


@query(sql(f"SELECT point_id, round({_lookup('p.x', 'p.y')} + 1e-9, 6) AS value FROM pts p", "pts", **_BASE))
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = fx.points(spark, sf_dir)
    found = intensity.bilinear_sample(pts, _coarse(pts).drop("h"), fx.WINDOW, QX, QY)
    return rounded(found.select("point_id", (F.col("value") + 1e-9).alias("value")))  # many values are exact ties of the sixth place


@query(sql("""SELECT u AS grid_index, round(least(v, (SELECT quantile_cont(v, 0.99) FROM d)), 6) AS value FROM d""", "pts", q=_Q,
    d="SELECT u, sum(exp(-((x - ux) ** 2 + (y - uy) ** 2) / (2 * 1e6)) / (2 * pi() * 1e6)) / (SELECT count(*) FROM pts) * 1e6 AS v FROM q CROSS JOIN pts GROUP BY 1"))
def aggregate_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intensity.aggregate_density(fx.points(spark, sf_dir), fx.WINDOW, QX, QY, 1000.0)
    return rounded(found.select("grid_index", (F.col("value") * 1e6).alias("value")))


def _delta(d: str, r: str, kind: str) -> str:
    return "1.0::DOUBLE" if kind == "strauss" else f"2 * ln(greatest(sin(pi() * {d} / (2 * {r})), 1e-12))"


def _stat_sql(kind: str) -> str:
    return sql(f"SELECT p.source, p.pattern_id, p.point_id, round(coalesce(sum(CASE WHEN d2 > 0 AND d2 <= 640000 THEN {_delta('sqrt(d2)', '800.0', kind)} END), 0), 6) AS s FROM pts p LEFT JOIN pairs q ON q.i = p.point_id GROUP BY 1, 2, 3", "pairs")


@query(_stat_sql("strauss"))
def strauss_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gibbs.point_stat(fx.points(spark, sf_dir), 800.0, "strauss"))


@query(_stat_sql("dgs"))
def dgs_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gibbs.point_stat(fx.points(spark, sf_dir), 800.0, "dgs"))


@query(sql(f"SELECT source, pattern_id, u AS grid_index, round(sum({_delta('d', '800.0', 'dgs')}), 6) AS s FROM (SELECT *, sqrt((x - ux) ** 2 + (y - uy) ** 2) AS d FROM pts CROSS JOIN q) WHERE d <= 800 GROUP BY 1, 2, 3", "pts", q=_Q))
def dgs_cell_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gibbs.cell_stat(fx.points(spark, sf_dir), QUAD, 800.0, "dgs"))


def _cpl_views(kind: str, radii: list[float], alphas: list[float]) -> dict[str, str]:
    """Direct sums: every pattern, candidate, point and cell."""
    return _BASE | {
        "cand": "SELECT * FROM (VALUES " + ", ".join(f"({ir}, {r!r}::DOUBLE, {ia}, {a!r}::DOUBLE)" for ir, r in enumerate(radii) for ia, a in enumerate(alphas)) + ") t(ir, r, ia, alpha)",
        "bp": f"SELECT p.*, ln(greatest({_lookup('p.x', 'p.y')}, 1e-10)) AS b FROM pts p",
        "bq": f"SELECT q.*, ln(greatest({_lookup('q.ux', 'q.uy')}, 1e-10)) AS bu FROM q",
        "xu": f"SELECT ir, r, source, pattern_id, point_id, u, bu, CASE WHEN d <= r THEN {_delta('d', 'r', kind)} ELSE 0 END AS dl FROM (SELECT *, sqrt((x - ux) ** 2 + (y - uy) ** 2) AS d FROM pts CROSS JOIN bq CROSS JOIN (SELECT DISTINCT ir, r FROM cand))",
        "su": "SELECT *, sum(dl) OVER (PARTITION BY ir, source, pattern_id, u) AS s FROM xu",
        "zi": "SELECT ir, ia, point_id, ln(1250.0 * 1250.0 * sum(exp(bu + alpha * (s - dl)))) AS z FROM su JOIN cand USING (ir) GROUP BY 1, 2, 3",
        "si": f"SELECT ir, p.point_id, coalesce(sum(CASE WHEN d2 > 0 AND sqrt(d2) <= r THEN {_delta('sqrt(d2)', 'r', kind)} END), 0) AS s FROM pts p CROSS JOIN (SELECT DISTINCT ir, r FROM cand) LEFT JOIN pairs q ON q.i = p.point_id GROUP BY 1, 2",
    }


def _cpl_sql(kind: str) -> str:
    return sql("SELECT source, pattern_id, round(sum(b + alpha * si.s - z), 5) AS logcpl FROM bp JOIN zi USING (point_id) JOIN si USING (point_id, ir) JOIN cand USING (ir, ia) GROUP BY 1, 2", "pairs", **_cpl_views(kind, [800.0], [ALPHAS[kind][1]]))


def _profile_sql(kind: str) -> str:
    return sql("SELECT r, alpha, round(sum(b + alpha * si.s - z), 4) AS logcpl FROM bp JOIN zi USING (point_id) JOIN si USING (point_id, ir) JOIN cand USING (ir, ia) GROUP BY 1, 2", "pairs", **_cpl_views(kind, RADII, ALPHAS[kind]))


def _cpl(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    pts = fx.points(spark, sf_dir)
    return rounded(gibbs.cpl(pts, _coarse(pts).drop("h"), QUAD, 800.0, ALPHAS[kind][1], kind), 5)


def _profile(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    pts = fx.points(spark, sf_dir)
    surface = gibbs.profile(pts, _coarse(pts), QUAD, RADII, ALPHAS[kind], kind)
    return surface.select("r", "alpha", F.round("logcpl", 4).alias("logcpl"))


@query(_cpl_sql("strauss"))
def strauss_cpl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cpl(spark, sf_dir, "strauss")


@query(_cpl_sql("dgs"))
def dgs_cpl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cpl(spark, sf_dir, "dgs")


@query(_profile_sql("strauss"))
def strauss_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "strauss")


@query(_profile_sql("dgs"))
def dgs_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir, "dgs")


@query()
def strauss_bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model patterns scored under intensities of the data patterns."""
    pts = fx.points(spark, sf_dir)
    part = lambda s: pts.where(F.col("source") == s)
    return rounded(gibbs.evaluate_bandwidths(part("Data"), part("Model"), [500.0, 1000.0], 800.0, ALPHAS["strauss"][1], QUAD, "strauss"), 4)


@query()
def strauss_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates and folds over the coarse cells; the first iterations."""
    return rounded(gibbs.refine(fx.points(spark, sf_dir), QUAD, "strauss", gibbs.candidates("strauss"), n_iter=2))


@query()
def dgs_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gibbs.refine(fx.points(spark, sf_dir), QUAD, "dgs", gibbs.candidates("dgs"), n_iter=2))


@query()
def dgs_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all candidate bandwidths in all folds."""
    found = gibbs.cross_validate(fx.points(spark, sf_dir), QUAD, "dgs", gibbs.candidates("dgs"))
    for name in ("surface0", "surface1"):
        found[name].unpersist()
    return rounded(found["folds"], 4)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns on the 16 x 8 grid."""
    pts = fx.points(spark, sf_dir)
    return pts.select("source", "pattern_id", F.least(F.expr("x div 1250"), F.lit(15)).cast("int").alias("ix"), F.least(F.expr("y div 1250"), F.lit(7)).cast("int").alias("iy"))


@query(sql("""SELECT a.source, a.pattern_id, count(*) AS n, round(sum(a.rho * b.rho * exp(-((a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2) / (2 * 0.7 ** 2))), 6) AS total
    FROM s a JOIN s b ON a.source = b.source AND a.pattern_id = b.pattern_id GROUP BY 1, 2""", "pts", **_BASE,
    s="SELECT DISTINCT source, pattern_id, CAST(least(x // 1250, 15) AS INT) AS ix, CAST(least(y // 1250, 7) AS INT) AS iy, sqrt(value / 100) AS rho FROM pts JOIN coarse ON coarse.ix = least(x // 1250, 15) AND coarse.iy = least(y // 1250, 7)"))
def kernel_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = _coarse(fx.points(spark, sf_dir)).select("ix", "iy", F.sqrt(F.col("value") / 100).alias("rho"))
    samples = _samples(spark, sf_dir).distinct().join(F.broadcast(raster), ["ix", "iy"]).withColumn("cell", F.col("iy") * QX + F.col("ix"))
    return rounded(dpp.kernel_entries(samples, 0.7).groupBy("source", "pattern_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query()
def dpp_sigma_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood, its two parts and sample sizes for a few interaction ranges, conditioned on sizes."""
    return rounded(dpp.sigma_profile(_samples(spark, sf_dir), QX, QY, 1.0, [0.3, 0.6, 0.9]), 4)


@query()
def dpp_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dpp.sigma_profile(_samples(spark, sf_dir), QX, QY, 1.0, [0.3, 0.6, 0.9], conditioned=False), 4)


@query()
def dpp_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with rho = 1 on every cell, for both kinds of likelihood."""
    samples = _samples(spark, sf_dir)
    rows = [(kind, dpp.evaluate_uniform(samples, QX, QY, 0.6, conditioned)) for kind, conditioned in (("conditioned", True), ("plain", False))]
    return rounded(spark.createDataFrame(rows, "kind string, ll double"), 4)


@query()
def dpp_bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model samples scored under intensities of the data points."""
    samples = _samples(spark, sf_dir)
    part = lambda s: samples.where(F.col("source") == s)
    return rounded(dpp.evaluate_bandwidths(part("Data"), part("Model"), QX, QY, [0.5, 1.0], 0.6), 4)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the 16 x 8 grid."""
    return fx.points(spark, sf_dir).select(
        "source", "pattern_id", "point_id", F.least(F.expr("x div 1250"), F.lit(15)).cast("int").alias("ix"), F.least(F.expr("y div 1250"), F.lit(7)).cast("int").alias("iy"))


@query()
def dpp_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all candidate bandwidths in all folds, with all interaction ranges."""
    return rounded(dpp.cross_validate(_placed(spark, sf_dir), QX, QY, conditioned=True)["folds"], 4)


@query()
def dpp_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation in all folds, repeated from the bandwidth that the last one chose, with a few candidates."""
    few = {"coeffs": [0.5, 1.0, 2.0], "sigmas": [0.3, 0.6, 0.9], "pilots": [0.5, 1.0, 2.0]}
    return rounded(dpp.refine(_placed(spark, sf_dir), QX, QY, n_iter=2, conditioned=True, **few), 4)


@query(sql("""SELECT count(*) AS n, round(sum(ln((ra * ra + 1e-6) * (rb * rb + 1e-6) - (ra * rb * exp(-d2 / (2 * 0.7 ** 2))) ** 2)), 4) AS logdet FROM
    (SELECT a.rho AS ra, b.rho AS rb, (a.ix - b.ix) ** 2 + (a.iy - b.iy) ** 2 AS d2 FROM s2 a JOIN s2 b ON a.source = b.source AND a.pattern_id = b.pattern_id AND a.rn = 1 AND b.rn = 2)""", "pts", **_BASE,
    s2="""SELECT *, row_number() OVER (PARTITION BY source, pattern_id ORDER BY iy, ix) AS rn FROM (SELECT DISTINCT source, pattern_id, CAST(least(x // 1250, 15) AS INT) AS ix, CAST(least(y // 1250, 7) AS INT) AS iy, sqrt(value / 100) AS rho
        FROM pts JOIN coarse ON coarse.ix = least(x // 1250, 15) AND coarse.iy = least(y // 1250, 7))"""))
def sample_logdet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-determinants of the first two cells of every pattern, summed."""
    pattern = W.partitionBy("source", "pattern_id")
    two = _samples(spark, sf_dir).distinct().withColumn("rn", F.row_number().over(pattern.orderBy("iy", "ix"))).where("rn <= 2").withColumn("both", F.count("*").over(pattern)).where("both = 2")
    raster = _coarse(fx.points(spark, sf_dir)).select("h", (F.col("iy") * QX + F.col("ix")).alias("cell"), "ix", "iy", F.sqrt(F.col("value") / 100).alias("rho"))
    placed = two.select("source", "pattern_id", (F.col("iy") * QX + F.col("ix")).alias("cell"))
    return rounded(dpp.sample_logdet(placed, raster, [0.7]).agg(F.count("*").alias("n"), F.sum("logdet").alias("logdet")), 4)


@query(sql("SELECT grid_index, round(least(v, (SELECT quantile_cont(v, 0.99) FROM d)), 6) AS v FROM d", "cells", d="SELECT grid_index, count(*) / (SELECT count(*) FROM cells)::DOUBLE * 1000 AS v FROM cells GROUP BY 1"))
def clipped_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = fx.cells(fx.points(spark, sf_dir)).groupBy("grid_index").agg(F.count("*").alias("c"))
    n = visits.agg(F.sum("c").cast("double").alias("n"))
    return rounded(clip_at_percentile(visits.crossJoin(F.broadcast(n)).select("grid_index", (F.col("c") / F.col("n") * 1000).alias("v")), "v"))
