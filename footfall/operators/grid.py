"""Grids: making them, placing points on them, and counting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import Window


def make_grid(spark: SparkSession, window: Window, nx: int, ny: int) -> DataFrame:
    """grid_index, ix, iy and cell centres x, y, row by row from the lower left, with the cell's area."""
    xmin, ymin, xmax, ymax = window
    dx, dy = (xmax - xmin) / nx, (ymax - ymin) / ny
    if dx <= 0 or dy <= 0:
        raise ValueError(f"empty window {window}")
    return spark.range(nx * ny).select(
        F.col("id").cast("int").alias("grid_index"), (F.col("id") % nx).cast("int").alias("ix"), F.expr(f"cast(id div {nx} as int)").alias("iy"),
    ).select("grid_index", "ix", "iy", (F.lit(xmin) + (F.col("ix") + 0.5) * dx).alias("x"), (F.lit(ymin) + (F.col("iy") + 0.5) * dy).alias("y"), F.lit(dx * dy).alias("area"))


def cell_on_regular_axis(v: Column, origin: float, step: float, n: int) -> Column:
    """Nearest of n centres origin + i * step, rounded half to even and clamped to the axis."""
    return F.least(F.greatest(F.rint((v - origin) / step), F.lit(0.0)), F.lit(float(n - 1))).cast("int")


def physical_to_cell_id(x: Column, y: Column, ncols: int = 160, nrows: int = 26, x0: float = 0.0, y0: float = -47.111084, dx: float = 502.958588, dy: float = 511.111083) -> Column:
    """Cell number iy * ncols + ix of the full grid."""
    return cell_on_regular_axis(y, y0, dy, nrows) * ncols + cell_on_regular_axis(x, x0, dx, ncols)


def unflatten(cell: Column, ncols: int = 160) -> tuple[Column, Column]:
    """Cell centre in cells."""
    return cell % ncols + 0.5, F.floor(cell / ncols) + 0.5


#: A grid that goes to every task has so many cells at most.
MOST_CELLS = 1_000_000


def _on_axis(axis: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Place of the nearest centre, the lower one of two."""
    at = np.clip(np.searchsorted(axis, v), 1, max(len(axis) - 1, 1))
    above = np.minimum(at, len(axis) - 1)
    return np.where(v - axis[at - 1] <= axis[above] - v, at - 1, above)


def _nearest_cell(xs: np.ndarray, ys: np.ndarray, there: np.ndarray):
    """there: whether the cell exists, by place on the y axis and on the x axis."""
    rows, columns = np.nonzero(there)

    @F.pandas_udf("x_rounded int, y_rounded int, x_grid double, y_grid double")
    def nearest(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        px, py = x.to_numpy(float), y.to_numpy(float)
        known = ~(np.isnan(px) | np.isnan(py))
        ix, iy = _on_axis(xs, np.where(known, px, xs[0])), _on_axis(ys, np.where(known, py, ys[0]))
        for part in np.array_split(np.flatnonzero(~there[iy, ix]), max(1, len(px) // 256)):
            away = np.maximum(np.abs(px[part, None] - xs[columns]), np.abs(py[part, None] - ys[rows]))
            best = np.where(np.isnan(away), np.inf, away).argmin(axis=1)
            ix[part], iy[part] = columns[best], rows[best]
        found = pd.DataFrame({"x_rounded": pd.array(ix, "Int32"), "y_rounded": pd.array(iy, "Int32"), "x_grid": xs[ix], "y_grid": ys[iy]})
        found.loc[~known] = None
        return found

    return nearest


def assign_grid(df: DataFrame, grid: DataFrame, x: str, y: str) -> DataFrame:
    """Each point's nearest cell of the grid in the largest-coordinate metric: x_grid, y_grid, x_rounded, y_rounded (places
    on the axes of the grid's distinct centres), grid_index (row by row over both axes).

    That is the nearest centre on each axis, the lower one of two, where the grid has this cell, which is always among
    the nearest; where it does not, the nearest cell that it has, of equally near ones the first row by row. A point
    without a coordinate (null or NaN) has no cell: nulls. Only the grid, of MOST_CELLS at most, comes to the driver.
    """
    cells = grid.select(F.col("x").cast("double"), F.col("y").cast("double")).distinct().limit(MOST_CELLS + 1).collect()
    if not 0 < len(cells) <= MOST_CELLS:
        raise ValueError(f"a grid has 1 to {MOST_CELLS} cells")
    xs, ys = (np.unique([r[i] for r in cells]) for i in (0, 1))
    there = np.zeros((len(ys), len(xs)), bool)
    there[np.searchsorted(ys, [r[1] for r in cells]), np.searchsorted(xs, [r[0] for r in cells])] = True
    found = df.withColumn("__cell", _nearest_cell(xs, ys, there)(F.col(x).cast("double"), F.col(y).cast("double")))
    return found.select("*", "__cell.*").drop("__cell").withColumn("grid_index", F.col("y_rounded") * len(xs) + F.col("x_rounded"))


def cells_to_physical(df: DataFrame, grid: DataFrame, cell: str = "grid_index") -> DataFrame:
    """Attach the cell centres; an unknown cell is an error."""
    centres = grid.select(F.col("grid_index").alias(cell), "x", "y")
    if df.join(F.broadcast(centres), cell, "left_anti").limit(1).count():
        raise ValueError("a cell is not on the grid")
    return df.join(F.broadcast(centres), cell)


def create_mask(grid: DataFrame, selection: DataFrame) -> DataFrame:
    """grid with masked: true where the cell is not in the selection (by centre)."""
    chosen = selection.select("x", "y").distinct().withColumn("__in", F.lit(True))
    return grid.join(F.broadcast(chosen), ["x", "y"], "left").withColumn("masked", F.col("__in").isNull()).drop("__in")


def cells_outside(grid: DataFrame, selection: DataFrame) -> DataFrame:
    return grid.join(F.broadcast(selection.select("x", "y")), ["x", "y"], "left_anti")


def grid_subset(grid: DataFrame, ix0: int, ix1: int, iy0: int, iy1: int) -> DataFrame:
    """Closed sub-rectangle by axis numbers."""
    return grid.where(F.col("x_rounded").between(ix0, ix1) & F.col("y_rounded").between(iy0, iy1))


def reindex_grid(grid: DataFrame) -> DataFrame:
    """Both axes numbered densely from 0 and cells row by row. Ranks run over the axes' distinct values."""
    axes = {}
    for c in ("x", "y"):
        axes[c] = grid.select(c).distinct().withColumn(f"{c}_rounded", (F.dense_rank().over(W.orderBy(c)) - 1).cast("int"))
    ncols = axes["x"].count()
    out = grid.drop("x_rounded", "y_rounded", "grid_index").join(F.broadcast(axes["x"]), "x").join(F.broadcast(axes["y"]), "y")
    return out.withColumn("grid_index", F.col("y_rounded") * ncols + F.col("x_rounded"))


def aggregate_counts(samples: DataFrame, grid: DataFrame, cell: str = "grid_index") -> DataFrame:
    """Visits of every cell over all samples, 0 where none."""
    visits = samples.groupBy(cell).agg(F.count("*").alias("visits"))
    return grid.select(F.col("grid_index").alias(cell)).join(visits, cell, "left").fillna(0, ["visits"])


def infer_window(df: DataFrame, pad: float | None = None) -> Window:
    """Bounding rectangle of all points, padded by a distance, or (None) by 1 % of each axis's range (1.0 where it is 0).
    Without points: the unit square."""
    r = df.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).first()
    if r["a"] is None:
        return (0.0, 0.0, 1.0, 1.0)
    px, py = (pad, pad) if pad is not None else (0.01 * (r["c"] - r["a"]) or 1.0, 0.01 * (r["d"] - r["b"]) or 1.0)
    return (r["a"] - px, r["b"] - py, r["c"] + px, r["d"] + py)


def infer_rect_from_grid(grid: DataFrame) -> DataFrame:
    """One row: xmin, xmax, ymin, ymax, half a median step beyond the outer centres (half of 1.0 on a single-valued axis)."""
    sides = []
    for c in ("x", "y"):
        axis = grid.select(F.col(c).cast("double").alias(c)).distinct()
        step = axis.withColumn("d", F.col(c) - F.lag(c).over(W.orderBy(c)))
        half = F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(1.0)) / 2
        sides.append(step.agg((F.min(c) - half).alias(f"{c}min"), (F.max(c) + half).alias(f"{c}max")))
    return sides[0].crossJoin(sides[1])


def convert_intensities(raster: DataFrame, target: DataFrame, fill: float = 0.0) -> DataFrame:
    """Square roots of a raster's values (ix, iy, value) on the cells of a target grid (x_rounded, y_rounded); cells that
    the raster lacks get the fill."""
    values = raster.select(F.col("ix").alias("x_rounded"), F.col("iy").alias("y_rounded"), "value")
    joined = target.join(F.broadcast(values), ["x_rounded", "y_rounded"], "left")
    return joined.withColumn("rho", F.sqrt(F.greatest(F.coalesce("value", F.lit(fill)), F.lit(1e-16)))).drop("value")
