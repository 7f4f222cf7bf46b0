"""Queries over the grid operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, pairs
from ..sources.tables import read_grid
from . import fixtures as fx
from .fixtures import sql
from .support import Query, register, rounded, work_path

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
QUAD = "SELECT CAST(i AS INT) AS u, (i % 16 + 0.5) * 1250.0::DOUBLE AS ux, (i // 16 + 0.5) * 1250.0::DOUBLE AS uy FROM range(128) r(i)"


def query(oracle: str | None = None):
    return register(QUERIES, ORACLE_SQL, oracle)


@query(sql("SELECT u AS grid_index, ux AS x, uy AS y, count(point_id) AS n FROM q LEFT JOIN pts ON floor(x / 1250) * 1250 = ux - 625 AND floor(y / 1250) * 1250 = uy - 625 GROUP BY 1, 2, 3", "pts", q=QUAD))
def make_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadrature grid of 16 x 8 cells with the points in each."""
    q = grid.make_grid(spark, fx.WINDOW, 16, 8)
    at = fx.points(spark, sf_dir).select(F.expr("x div 1250").cast("int").alias("ix"), F.expr("y div 1250").cast("int").alias("iy"), "point_id")
    return q.join(at, ["ix", "iy"], "left").groupBy("grid_index", "x", "y").agg(F.count("point_id").alias("n"))


@query(sql("""SELECT point_id, CAST(gy * 40 + gx AS INT) AS grid_index, gx * 500.0::DOUBLE + 250 AS x_grid, gy * 500.0::DOUBLE + 250 AS y_grid FROM (
    SELECT point_id, least(greatest(ceil(x / 500.0::DOUBLE) - 1, 0), 39) AS gx, least(greatest(ceil(y / 500.0::DOUBLE) - 1, 0), 19) AS gy FROM allpts)""", "allpts"))
def assign_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest cells; a point half-way between two centres goes to the lower one, points outside to the border."""
    return grid.assign_grid(fx.all_points(spark, sf_dir), fx.grid(spark), "x", "y").select("point_id", "grid_index", "x_grid", "y_grid")


@query(sql("""SELECT point_id, CAST(grid_index AS INT) AS grid_index, gx AS x_grid, gy AS y_grid FROM (
    SELECT point_id, grid_index, g.x AS gx, g.y AS gy, row_number() OVER (PARTITION BY point_id ORDER BY greatest(abs(p.x - g.x), abs(p.y - g.y)),
        CASE WHEN grid_index = least(greatest(ceil(p.y / 500.0::DOUBLE) - 1, 0), 19) * 40 + least(greatest(ceil(p.x / 500.0::DOUBLE) - 1, 0), 39) THEN 0 ELSE 1 END, grid_index) AS rn
    FROM allpts p CROSS JOIN cleangrid g) WHERE rn = 1""", "allpts", "cleangrid"))
def assign_clean_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest cells of a grid with a hole."""
    return grid.assign_grid(fx.all_points(spark, sf_dir), fx.clean_grid(spark), "x", "y").select("point_id", "grid_index", "x_grid", "y_grid")


@query(sql("""SELECT point_id, CAST(least(greatest(round_even((y + 47.111084::DOUBLE) / 511.111083::DOUBLE, 0), 0), 25) * 160 + least(greatest(round_even(x / 502.958588::DOUBLE, 0), 0), 159) AS INT) AS cell_id FROM allpts""", "allpts"))
def physical_to_cell_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.all_points(spark, sf_dir).select("point_id", grid.physical_to_cell_id(F.col("x"), F.col("y")).alias("cell_id"))


@query(sql("SELECT DISTINCT grid_index, grid_index % 40 + 0.5::DOUBLE AS ux, grid_index // 40 + 0.5::DOUBLE AS uy FROM cells", "cells"))
def unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    ux, uy = grid.unflatten(F.col("grid_index"), 40)
    return rounded(fx.cells(fx.points(spark, sf_dir)).select("grid_index", ux.cast("double").alias("ux"), uy.cast("double").alias("uy")).distinct())


@query(sql("SELECT point_id, ix * 500.0::DOUBLE + 250 AS x, iy * 500.0::DOUBLE + 250 AS y FROM cells", "cells"))
def cells_to_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cells_to_physical(fx.cells(fx.points(spark, sf_dir)).select("point_id", "grid_index"), fx.grid(spark)).select("point_id", "x", "y")


@query(sql("SELECT grid_index, masked, count(point_id) AS n FROM (SELECT grid.grid_index, cleangrid.grid_index IS NULL AS masked FROM grid LEFT JOIN cleangrid USING (x, y)) LEFT JOIN cells USING (grid_index) GROUP BY 1, 2", "grid", "cleangrid", "cells"))
def create_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = grid.create_mask(fx.grid(spark), fx.clean_grid(spark)).select("grid_index", "masked")
    return mask.join(fx.cells(fx.points(spark, sf_dir)).select("grid_index", "point_id"), "grid_index", "left").groupBy("grid_index", "masked").agg(F.count("point_id").alias("n"))


@query(sql("SELECT grid_index, count(point_id) AS n FROM grid LEFT JOIN cells USING (grid_index) WHERE x_rounded >= 30 AND y_rounded < 4 GROUP BY 1", "grid", "cells"))
def cells_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = grid.cells_outside(fx.grid(spark), fx.clean_grid(spark)).select("grid_index")
    return outside.join(fx.cells(fx.points(spark, sf_dir)).select("grid_index", "point_id"), "grid_index", "left").groupBy("grid_index").agg(F.count("point_id").alias("n"))


@query(sql("SELECT grid_index, count(*) AS n FROM cells WHERE ix BETWEEN 5 AND 20 AND iy BETWEEN 3 AND 9 GROUP BY 1", "cells"))
def grid_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = grid.grid_subset(fx.grid(spark), 5, 20, 3, 9)
    return fx.cells(fx.points(spark, sf_dir)).join(F.broadcast(part.select("grid_index")), "grid_index").groupBy("grid_index").agg(F.count("*").alias("n"))


@query(sql("""SELECT x, y, CAST(dense_rank() OVER (ORDER BY x) - 1 AS INT) AS x_rounded, CAST(dense_rank() OVER (ORDER BY y) - 1 AS INT) AS y_rounded,
    CAST((dense_rank() OVER (ORDER BY y) - 1) * (SELECT count(DISTINCT ix) FROM cells WHERE ix % 3 = 1) + dense_rank() OVER (ORDER BY x) - 1 AS INT) AS grid_index
    FROM (SELECT DISTINCT ix * 500.0::DOUBLE + 250 AS x, iy * 500.0::DOUBLE + 250 AS y FROM cells WHERE ix % 3 = 1)""", "cells"))
def reindex_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The occupied cells of every third column as a grid of their own."""
    used = fx.cells(fx.points(spark, sf_dir)).where("ix % 3 = 1").selectExpr("ix * 500D + 250D as x", "iy * 500D + 250D as y").distinct()
    return grid.reindex_grid(used).select("x", "y", "x_rounded", "y_rounded", "grid_index")


@query(sql("SELECT g.grid_index, count(c.grid_index) AS visits FROM grid g LEFT JOIN (SELECT DISTINCT source, pattern_id, grid_index FROM cells) c ON c.grid_index = g.grid_index GROUP BY 1", "grid", "cells"))
def aggregate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fx.cells(fx.points(spark, sf_dir)).select("source", "pattern_id", "grid_index").distinct()
    return grid.aggregate_counts(samples, fx.grid(spark))


@query(sql("""SELECT kind, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM (
    SELECT 'pad' AS kind, a - 250.0::DOUBLE AS xmin, b - 250.0::DOUBLE AS ymin, c + 250.0::DOUBLE AS xmax, d + 250.0::DOUBLE AS ymax FROM m
    UNION ALL SELECT 'share', a - 0.01 * (c - a)::DOUBLE, b - 0.01 * (d - b)::DOUBLE, c + 0.01 * (c - a)::DOUBLE, d + 0.01 * (d - b)::DOUBLE FROM m)""", "pts",
    m="SELECT min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM pts"))
def infer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = fx.points(spark, sf_dir)
    rows = [("pad", *map(float, grid.infer_window(pts, 250.0))), ("share", *map(float, grid.infer_window(pts)))]
    return rounded(spark.createDataFrame(rows, "kind string, xmin double, ymin double, xmax double, ymax double"))


@query(sql("""SELECT min(x) - sx / 2 AS xmin, max(x) + sx / 2 AS xmax, min(y) - sy / 2 AS ymin, max(y) + sy / 2 AS ymax FROM used,
    (SELECT quantile_cont(d, 0.5) AS sx FROM (SELECT x - lag(x) OVER (ORDER BY x) AS d FROM (SELECT DISTINCT x FROM used))),
    (SELECT quantile_cont(d, 0.5) AS sy FROM (SELECT y - lag(y) OVER (ORDER BY y) AS d FROM (SELECT DISTINCT y FROM used))) GROUP BY sx, sy""", "cells",
    used="SELECT DISTINCT ix * 500.0::DOUBLE + 250 AS x, iy * 500.0::DOUBLE + 250 AS y FROM cells WHERE ix < 35"))
def infer_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = fx.cells(fx.points(spark, sf_dir)).where("ix < 35").selectExpr("ix * 500D + 250D as x", "iy * 500D + 250D as y").distinct()
    return grid.infer_rect_from_grid(used)


@query(sql("SELECT grid_index, count(point_id) AS n FROM cleangrid LEFT JOIN cells USING (grid_index) GROUP BY 1", "cleangrid", "cells"))
def read_grid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean grid written as Parquet, read with its schema, and the points in each of its cells."""
    path = work_path(spark, "grid")
    fx.clean_grid(spark).write.parquet(path)
    at = fx.cells(fx.points(spark, sf_dir)).select("grid_index", "point_id")
    return read_grid(spark, path).join(at, "grid_index", "left").groupBy("grid_index").agg(F.count("point_id").alias("n"))


@query(sql("SELECT g.grid_index, round(sqrt(greatest(coalesce(v, 0), 1e-16)), 6) AS rho FROM cleangrid g LEFT JOIN (SELECT grid_index, count(*) / 100.0::DOUBLE AS v FROM cells GROUP BY 1) c ON c.grid_index = g.grid_index", "cleangrid", "cells"))
def convert_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = fx.cells(fx.points(spark, sf_dir)).groupBy("ix", "iy").agg((F.count("*") / 100).alias("value"))
    return rounded(grid.convert_intensities(raster, fx.clean_grid(spark)).select("grid_index", "rho"))


@query(sql("SELECT source, pattern_id, point_id, u AS grid_index, round(sqrt((x - ux) ** 2 + (y - uy) ** 2), 6) AS d FROM pts JOIN q ON abs(x - ux) <= 800 AND abs(y - uy) <= 800 AND sqrt((x - ux) ** 2 + (y - uy) ** 2) <= 800", "pts", q=QUAD))
def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.cross_pairs(fx.points(spark, sf_dir), fx.WINDOW, 16, 8, 800.0))
