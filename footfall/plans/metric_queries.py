"""Queries over the validation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, metrics, pairs, quantiles
from . import fixtures as fx
from .fixtures import sql
from .support import Query, register, rounded

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MIN_REPS = 2
AREA = 20000.0 * 10000.0
CLASS = "CASE WHEN n <= 30 THEN 'low' WHEN n <= 60 THEN 'med' ELSE 'high' END"
BREAKS = [0.1 * i for i in range(51)]
BALLS = [0.5, 1.0, 2.0, 4.0, 8.0]
RADII = [0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0]


def query(oracle: str | None = None):
    return register(QUERIES, ORACLE_SQL, oracle)


def _listed(values) -> str:
    return "(VALUES " + ", ".join(f"({v!r}::DOUBLE)" for v in values) + ")"


def _nn_sql(near: str) -> str:
    return sql(
        "SELECT n, source, round(avg(nn), 6) AS mean, round(stddev_samp(nn) / sqrt(count(*)), 6) AS se FROM per WHERE n IN (SELECT n FROM lv) GROUP BY n, source",
        near, per=f"SELECT source, pattern_id, count(*) AS n, avg(d) / 1000 AS nn FROM {near} GROUP BY 1, 2",
        lv=f"SELECT n FROM (SELECT n, source, count(*) AS c FROM per GROUP BY 1, 2) GROUP BY n HAVING count(*) = 2 AND min(c) >= {MIN_REPS}")


@query(_nn_sql("near1"))
def nn_by_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.nn_by_occupancy(fx.points(spark, sf_dir), 1, MIN_REPS))


@query(_nn_sql("near2"))
def nn2_by_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.nn_by_occupancy(fx.points(spark, sf_dir), 2, MIN_REPS))


@query(sql("SELECT source, pattern_id, point_id, round(d, 6) AS d FROM near2", "near2"))
def knn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.knn_distance(fx.points(spark, sf_dir), 2))


@query(sql("SELECT source, pattern_id, i, j, round(sqrt(d2), 6) AS d FROM pairs WHERE i < j AND d2 <= 1500 * 1500", "pairs"))
def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.close_pairs(fx.points(spark, sf_dir), 1500.0))


@query("""WITH p AS (SELECT l_suppkey AS pattern_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS point_id,
    CAST(l_quantity * 400 AS BIGINT) AS x, (l_partkey * 37 + l_linenumber) % 10000 AS y FROM lineitem)
    SELECT a.pattern_id, count(*) AS n_pairs, CAST(sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS BIGINT) AS sum_d2 FROM p a JOIN p b
    ON a.pattern_id = b.pattern_id AND a.point_id < b.point_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 250000 GROUP BY 1""")
def crowded_close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs of crowded patterns: the bucketed join's case."""
    near = pairs.ordered_pairs(fx.crowded(spark, sf_dir), 500.0).where("i < j")
    return near.groupBy("pattern_id").agg(F.count("*").alias("n_pairs"), F.sum("d2").alias("sum_d2"))


_FLAGS = """SELECT l_returnflag AS flag, l_orderkey * 8 + l_linenumber AS id, CAST(round(l_extendedprice * 100) AS BIGINT) % IF(l_linenumber = 1, 200, 20000) AS x,
    (l_partkey * 37 + l_linenumber * 11) % 10000 AS y FROM lineitem"""


@query(f"""WITH p AS ({_FLAGS.replace("IF(l_linenumber = 1, 200, 20000)", "CASE WHEN l_linenumber = 1 THEN 200 ELSE 20000 END")}),
    q AS (SELECT flag, id, x, y, y // 20 + unnest([-1, 0, 1]) AS b FROM p)
    SELECT p.flag, count(*) AS n_pairs, CAST(sum((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS BIGINT) AS sum_d2 FROM p JOIN q
    ON p.flag = q.flag AND p.y // 20 = q.b AND p.id < q.id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 400 GROUP BY 1""")
def strip_close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs of three patterns that hold all line items, a quarter of each on a narrow strip, which few buckets hold."""
    fx.read_table(spark, sf_dir, "lineitem").createOrReplaceTempView("__lineitem")
    points = spark.sql(_FLAGS.replace("FROM lineitem", "FROM __lineitem")).withColumnRenamed("id", "point_id")
    return pairs.close_pair_sums(points, 20.0, ["flag"])


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice::DOUBLE, 0.01), 6) AS q0, round(quantile_cont(l_extendedprice::DOUBLE, 0.25), 6) AS q1,
    round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice::DOUBLE, 0.999), 6) AS q3 FROM lineitem GROUP BY 1""")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.read_table(spark, sf_dir, "lineitem")
    return rounded(quantiles.exact_quantiles(lines, "l_extendedprice", [0.01, 0.25, 0.5, 0.999], ["l_returnflag"]))


@query(sql("SELECT n, source, count(*) AS patterns FROM sizes WHERE n IN (SELECT n FROM lv) GROUP BY n, source", "sizes",
    lv=f"SELECT n FROM (SELECT n, source, count(*) AS c FROM sizes GROUP BY 1, 2) GROUP BY n HAVING count(*) = 2 AND min(c) >= {MIN_REPS}"))
def restrict_to_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fx.points(spark, sf_dir).groupBy("source", "pattern_id").agg(F.count("*").alias("n"))
    return sizes.join(metrics.common_levels(sizes, 2, MIN_REPS), "n", "left_semi").groupBy("n", "source").agg(F.count("*").alias("patterns"))


@query(sql("SELECT * FROM occ", "occ"))
def snapshot_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.snapshot_occupancy(fx.snapshots(spark, sf_dir), "t", "object_identifier")


@query(sql("SELECT t, round(frac_standing, 6) AS frac_standing FROM fracs", "fracs"))
def fraction_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fraction_standing(fx.snapshots(spark, sf_dir), "t"))


@query(sql(f"SELECT source, {CLASS} AS occupancy, count(*) AS patterns FROM sizes GROUP BY 1, 2", "sizes"))
def occupancy_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fx.points(spark, sf_dir).groupBy("source", "pattern_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("source", metrics.occupancy_class(F.col("n")).alias("occupancy")).agg(F.count("*").alias("patterns"))


def _with_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = fx.snapshots(spark, sf_dir)
    return snaps.join(metrics.snapshot_occupancy(snaps, "t", "object_identifier"), "t").join(metrics.fraction_standing(snaps, "t"), "t")


@query(sql("""SELECT (SELECT occupancy FROM occ WHERE occupancy <= 20 GROUP BY 1 ORDER BY count(*) DESC, occupancy LIMIT 1) AS mode, round(avg(occupancy), 6) AS mean,
    quantile_cont(occupancy, 0.5) AS median, round(stddev_samp(occupancy), 6) AS sd, count(*) AS n_snapshots FROM occ WHERE occupancy <= 20""", "occ"))
def occupancy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.occupancy_summary(_with_occupancy(spark, sf_dir), "t", 20))


@query(sql("SELECT least(CAST(floor((occupancy - lo) * 10 / (hi - lo)) AS BIGINT), 9) AS bin, count(*) AS n FROM occ, ends WHERE occupancy <= 20 GROUP BY 1", "occ",
    ends="SELECT min(occupancy)::DOUBLE AS lo, max(occupancy)::DOUBLE AS hi FROM occ WHERE occupancy <= 20"))
def occupancy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.occupancy_histogram(_with_occupancy(spark, sf_dir), "t", 20, 10)


@query(sql("""SELECT round(CASE WHEN f THEN floor(u + 0.5) ELSE floor(u) + 0.5 END * (30.0::DOUBLE / 20), 6) AS cx,
    round(CASE WHEN f THEN floor(v + 0.5) ELSE floor(v) + 0.5 END * (1.0::DOUBLE / 11), 6) AS cy, count(*) AS n FROM (
    SELECT u, v, (u - floor(u + 0.5)) ** 2 + 3 * (v - floor(v + 0.5)) ** 2 < (u - floor(u) - 0.5) ** 2 + 3 * (v - floor(v) - 0.5) ** 2 AS f FROM uv) GROUP BY 1, 2""", "occ", "fracs",
    uv="SELECT occupancy / (30.0::DOUBLE / 20) AS u, frac_standing / (1.0::DOUBLE / 11) AS v FROM occ JOIN fracs USING (t) WHERE occupancy <= 30"))
def occupancy_vs_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = cleaning.one_row_per_snapshot(_with_occupancy(spark, sf_dir), "t", ["occupancy", "frac_standing"])
    return rounded(metrics.hexbins(cleaning.crop_occupancy(one, 30), "occupancy", "frac_standing", 20, (0.0, 30.0), (0.0, 1.0)))


@query(sql(f"""SELECT t.source, t.occupancy, round((b.lo + b.hi) / 2, 6) AS r, round(coalesce(c, 0) / (total * (b.hi - b.lo)), 6) AS density
    FROM tot t CROSS JOIN bins b LEFT JOIN cnt c ON c.source = t.source AND c.occupancy = t.occupancy AND c.lo = b.lo""", "near1", "sizes",
    edges=f"SELECT v AS lo, lead(v) OVER (ORDER BY v) AS hi FROM {_listed(BREAKS)} t(v)", bins="SELECT * FROM edges WHERE hi IS NOT NULL",
    ds=f"SELECT source, {CLASS} AS occupancy, d / 1000 AS d FROM near1 JOIN sizes USING (source, pattern_id) WHERE d / 1000 BETWEEN 0 AND {BREAKS[-1]!r}",
    cnt="SELECT source, occupancy, lo, count(*) AS c FROM ds JOIN bins ON (d > lo AND d <= hi) OR (lo = 0 AND d = 0) GROUP BY 1, 2, 3",
    tot="SELECT source, occupancy, sum(c) AS total FROM cnt GROUP BY 1, 2"))
def nn_distance_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.nn_distance_density(pairs.knn_distance(fx.points(spark, sf_dir), 1), BREAKS))


@query(sql("""SELECT source, occupancy, round(r, 6) AS r, round(sum(c * exp(-0.5 * ((r - d) / h) ** 2) / (m * h * 2.5066282746310002)), 6) AS density FROM bw JOIN vals USING (source, occupancy)
    CROSS JOIN (SELECT i * (5.0::DOUBLE / 63) AS r FROM range(64) t(i)) GROUP BY source, occupancy, r""", "near1", "sizes",
    ds=f"SELECT source, {CLASS} AS occupancy, round(d / 500) / 2 AS d FROM near1 JOIN sizes USING (source, pattern_id)",
    vals="SELECT source, occupancy, d, count(*) AS c FROM ds WHERE d BETWEEN 0 AND 5 GROUP BY 1, 2, 3",
    bw="""SELECT source, occupancy, m, 1.06 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * m ** (-0.2) * CASE occupancy WHEN 'high' THEN 2.25 ELSE 1.5 END AS h FROM (
        SELECT source, occupancy, count(*)::DOUBLE AS m, stddev_samp(d) AS sd, (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) / 1.34 AS iqr
        FROM ds WHERE d BETWEEN 0 AND 5 GROUP BY 1, 2 HAVING count(DISTINCT d) > 1)"""))
def nn_distance_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .support import stored

    near = stored(pairs.knn_distance(fx.points(spark, sf_dir), 1).withColumn("d", F.round(F.col("d") / 500)), "near")
    return rounded(metrics.nn_distance_kde(near, (0.0, 5.0), {"low": 1.5, "med": 1.5, "high": 2.25}, 64, 2))


_COUNTS = f"SELECT p.source, p.pattern_id, p.point_id, r, count(q.i) AS c FROM pts p CROSS JOIN {_listed(BALLS)} t(r) LEFT JOIN pairs q ON q.source = p.source AND q.pattern_id = p.pattern_id AND q.i = p.point_id AND sqrt(q.d2) <= r * 1000 GROUP BY ALL"


@query(sql("SELECT source, pattern_id, point_id, CAST(round(r * 1000) AS BIGINT) AS r, c FROM counts", "pairs", counts=_COUNTS))
def neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.neighbour_counts(fx.points(spark, sf_dir), [r * 1000 for r in BALLS])
    return found.select("source", "pattern_id", "point_id", F.round("r").cast("long").alias("r"), "c")


@query(sql("SELECT source, 'all' AS occupancy, round(r, 6) AS r, round(avg(c), 6) AS mean, round(stddev_samp(c) / sqrt(count(*)), 6) AS se FROM counts GROUP BY source, r", "pairs", counts=_COUNTS))
def ball_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ball_count(fx.points(spark, sf_dir), BALLS))


@query(sql(f"""SELECT source, occupancy, round(r, 6) AS r, round(mean, 6) AS mean, round(se, 6) AS se, round(mean - 1.96 * se, 6) AS lower, round(mean + 1.96 * se, 6) AS upper FROM (
    SELECT source, {CLASS} AS occupancy, r, avg(c) AS mean, stddev_samp(c) / sqrt(count(*)) AS se FROM counts JOIN sizes USING (source, pattern_id) GROUP BY ALL)""", "pairs", "sizes", counts=_COUNTS))
def ball_count_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confidence_band(metrics.ball_count(fx.points(spark, sf_dir), BALLS, by_occupancy=True)))


@query(sql(f"""SELECT source, round(r, 6) AS r, round(avg(sqrt({AREA!r} / (n * (n - 1)) * c / pi())) / 1000, 6) AS L FROM (
    SELECT s.source, s.pattern_id, n, r, count(p.i) AS c FROM sizes s CROSS JOIN {_listed(RADII)} t(r)
    LEFT JOIN pairs p ON p.source = s.source AND p.pattern_id = s.pattern_id AND sqrt(p.d2) <= r * 1000 WHERE n > 1 GROUP BY ALL) GROUP BY source, r""", "pairs", "sizes"))
def average_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_l(fx.points(spark, sf_dir), RADII, AREA))


_VISITS = "SELECT grid_index, count(*) / 1e6::DOUBLE AS lam FROM cells GROUP BY 1"


@query(sql(f"""SELECT source, round(r, 6) AS r, round(avg(sqrt({AREA!r} / tot / {AREA!r} * coalesce(s, 0) / pi())) / 1000, 6) AS L FROM (
    SELECT z.source, z.pattern_id, tot, r, sum(a.w * b.w) AS s FROM per z CROSS JOIN {_listed(RADII)} t(r)
    LEFT JOIN pairs p ON p.source = z.source AND p.pattern_id = z.pattern_id AND sqrt(p.d2) <= r * 1000
    LEFT JOIN w a ON a.point_id = p.i LEFT JOIN w b ON b.point_id = p.j GROUP BY ALL) GROUP BY source, r""", "pairs", "cells", visits=_VISITS,
    w="SELECT source, pattern_id, point_id, 1 / lam AS w FROM cells JOIN visits USING (grid_index)",
    per="SELECT source, pattern_id, sum(w) AS tot FROM w GROUP BY 1, 2 HAVING count(*) > 1"))
def average_l_inhom(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = fx.cells(fx.points(spark, sf_dir))
    visits = placed.groupBy("grid_index").agg((F.count("*") / 1e6).alias("lambda"))
    weighted = placed.join(visits, "grid_index").withColumn("w", 1 / F.col("lambda"))
    return rounded(metrics.average_l(weighted, RADII, AREA, weight="w"))


@query(sql("""SELECT fold, n_cand, round(score, 6) AS score, round(value, 6) AS value FROM (SELECT k AS n_cand, 0 AS fold, sum(s) AS score, avg(v) AS value FROM (
    SELECT pattern_id % 3 AS f, pattern_id % 4 AS k, sum(x)::DOUBLE AS s, avg(y) AS v FROM pts GROUP BY 1, 2) GROUP BY k)""", "pts"))
def sum_over_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fx.points(spark, sf_dir).groupBy((F.col("pattern_id") % 3).alias("f"), (F.col("pattern_id") % 4).alias("n_cand")).agg(F.sum("x").cast("double").alias("score"), F.avg("y").alias("value"))
    return rounded(metrics.sum_over_folds(scores, "n_cand", "value", "score").withColumn("fold", F.lit(0)))


@query(sql("""SELECT round(avg(s), 6) AS s_mean, round(stddev_pop(s), 6) AS s_sd, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_sd FROM (
    SELECT pattern_id % 3 AS f, avg(x) AS s, avg(y) AS v FROM pts GROUP BY 1)""", "pts"))
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = fx.points(spark, sf_dir).groupBy((F.col("pattern_id") % 3).alias("f")).agg(F.avg("x").alias("s"), F.avg("y").alias("v"))
    return rounded(metrics.cv_summary(folds, ["s", "v"]))


@query(sql("SELECT grid_index, round(least(v, top), 6) AS v FROM visits, (SELECT quantile_cont(v, 0.9) AS top FROM visits)", "cells", visits="SELECT grid_index, count(*)::DOUBLE AS v FROM cells GROUP BY 1"))
def clip_at_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = fx.cells(fx.points(spark, sf_dir)).groupBy("grid_index").agg(F.count("*").cast("double").alias("v"))
    return rounded(metrics.clip_at_percentile(visits, "v", 90.0))


@query(sql("""SELECT round(r, 6) AS r, coef, power, round(coef * r ** power, 6) AS value FROM (SELECT DISTINCT round(d / 1000, 2) AS r FROM near1 WHERE d > 0) CROSS JOIN (VALUES (0.5::DOUBLE, 2.0::DOUBLE), (1.5, 1.0)) t(coef, power)
    WHERE r BETWEEN 0.5 AND 2""", "near1"))
def power_law_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    radii = pairs.knn_distance(fx.points(spark, sf_dir), 1).select(F.round(F.col("d") / 1000, 2).alias("r"), "d").where("d > 0").select("r").distinct()
    return rounded(metrics.zoom(metrics.power_law_refs(metrics.for_log_axis(radii), [(0.5, 2.0), (1.5, 1.0)]), {"r": (0.5, 2.0)}))


def _bundle_sql() -> str:
    """Every metric of the bundle by itself: pairs by the first radius that holds them, and sums along the radii."""
    curve, balls = [round(0.01 * i, 10) for i in range(301)], metrics.log_spaced(0.5, 50.0, 50)
    listed = lambda values: "(VALUES " + ", ".join(f"({r!r}::DOUBLE)" for r in values) + ") t(r)"
    nn = lambda k: f"""SELECT 'nn{k}_by_occupancy' AS metric, source, CAST(n AS VARCHAR) AS level, NULL::DOUBLE AS r, avg(nn) AS value, stddev_samp(nn) / sqrt(count(*)) AS se
        FROM per{k} WHERE n IN (SELECT n FROM (SELECT n, source, count(*) AS c FROM per{k} GROUP BY 1, 2) GROUP BY n HAVING count(*) = 2 AND min(c) >= {MIN_REPS}) GROUP BY n, source"""  # noqa: E731
    density = lambda k: f"""SELECT 'nn{k}_density', t.source, t.occupancy, (e.lo + hi) / 2, coalesce(c.c, 0) / (total * (hi - e.lo)), NULL FROM (SELECT source, occupancy, sum(c) AS total FROM cnt{k} GROUP BY 1, 2) t CROSS JOIN edges{k} e
        LEFT JOIN cnt{k} c ON c.source = t.source AND c.occupancy = t.occupancy AND c.lo = e.lo"""  # noqa: E731
    ball = lambda level, name: f"SELECT '{name}', source, {level}, r, avg(c), stddev_samp(c) / sqrt(count(*)) FROM counts JOIN sizes USING (source, pattern_id) GROUP BY ALL"
    views = {
        "visits": _VISITS, "w": "SELECT source, pattern_id, point_id, 1 / lam AS w FROM cells JOIN visits USING (grid_index)",
        "balls": f"SELECT r FROM {listed(balls)}", "curve": f"SELECT r FROM {listed(curve)}",
        "at_ball": "SELECT p.source, p.pattern_id, p.i, b.r, count(*) AS c FROM (SELECT *, sqrt(d2) / 1000 AS d FROM pairs) p ASOF JOIN balls b ON p.d <= b.r GROUP BY ALL",
        "counts": "SELECT p.source, p.pattern_id, p.point_id, b.r, coalesce(sum(a.c), 0) AS c FROM pts p CROSS JOIN balls b LEFT JOIN at_ball a ON a.source = p.source AND a.pattern_id = p.pattern_id AND a.i = p.point_id AND a.r <= b.r GROUP BY ALL",
        "at_curve": "SELECT p.source, p.pattern_id, b.r, count(*) AS c, sum(x.w * y.w) AS v FROM (SELECT *, sqrt(d2) / 1000 AS d FROM pairs) p JOIN w x ON x.point_id = p.i JOIN w y ON y.point_id = p.j ASOF JOIN curve b ON p.d <= b.r GROUP BY ALL",
        "whole": "SELECT source, pattern_id, count(*) AS n, sum(w) AS tot FROM w GROUP BY ALL HAVING count(*) > 1",
        "sums": "SELECT z.source, z.pattern_id, n, tot, b.r, coalesce(sum(c), 0) AS c, coalesce(sum(v), 0) AS v FROM whole z CROSS JOIN curve b LEFT JOIN at_curve a ON a.source = z.source AND a.pattern_id = z.pattern_id AND a.r <= b.r GROUP BY ALL",
    }
    for k, most in ((1, 5.0), (2, 6.0)):
        views[f"per{k}"] = f"SELECT source, pattern_id, count(*) AS n, avg(d) / 1000 AS nn FROM near{k} GROUP BY 1, 2"
        views[f"edges{k}"] = "SELECT lo, hi FROM (VALUES " + ", ".join(f"({most * i / 99!r}::DOUBLE, {most * (i + 1) / 99!r}::DOUBLE)" for i in range(99)) + ") t(lo, hi)"
        views[f"cnt{k}"] = f"SELECT source, {CLASS} AS occupancy, lo, count(*) AS c FROM near{k} JOIN sizes USING (source, pattern_id) JOIN edges{k} ON (d / 1000 > lo AND d / 1000 <= hi) OR (lo = 0 AND d = 0) GROUP BY ALL"
    body = " UNION ALL ".join([
        nn(1), nn(2), density(1), density(2), ball("'all'", "ball_count"), ball(CLASS, "ball_count_occ"),
        f"SELECT 'L', source, 'hom.', r, avg(sqrt({AREA!r} / (n * (n - 1)) * c / pi())) / 1000, NULL FROM sums GROUP BY source, r",
        f"SELECT 'L', source, 'inhom.', r, avg(sqrt({AREA!r} / tot / {AREA!r} * v / pi())) / 1000, NULL FROM sums GROUP BY source, r",
    ])
    return sql(f"SELECT metric, source, level, round(r, 6) AS r, round(value, 6) AS value, round(se, 6) AS se FROM ({body})", "near1", "near2", "pairs", "sizes", "cells", **views)


@query(_bundle_sql())
def validation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the bundle's metrics, written and read again, in one table."""
    from ..sources.tables import write_metrics
    from .support import stored, work_path

    placed = fx.cells(fx.points(spark, sf_dir))
    visits = placed.groupBy("grid_index").agg((F.count("*") / 1e6).alias("lambda"))
    weighted = placed.join(visits, "grid_index").withColumn("w", 1 / F.col("lambda"))
    tables = write_metrics(metrics.validation_metrics(weighted, AREA, "w", min_reps=MIN_REPS, store=stored), work_path(spark, "metrics"))
    level = {"L": "correction", "nn1_by_occupancy": "n", "nn2_by_occupancy": "n"}
    out = None
    for name, df in tables.items():
        value = next(c for c in ("mean", "density", "L") if c in df.columns)
        more = [F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("r", "se")]
        one = df.select(F.lit(name).alias("metric"), "source", F.col(level.get(name, "occupancy")).cast("string").alias("level"), F.col(value).alias("value"), *more)
        out = one if out is None else out.unionByName(one)
    return rounded(out)
