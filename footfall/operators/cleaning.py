"""Filters, deduplication and pattern tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import Window

#: Values that split the rows to be ranked into ranges.
CUTS = 255


def crop(df: DataFrame, window: Window, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside the closed window (xmin, ymin, xmax, ymax)."""
    return df.where(F.col(x).between(window[0], window[2]) & F.col(y).between(window[1], window[3]))


def crop_half_open(df: DataFrame, rect: Window, y_shift: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    """xmin <= x < xmax and ymin <= y + y_shift < ymax for rect = (xmin, xmax, ymin, ymax)."""
    shifted = F.col(y) + y_shift
    return df.where((F.col(x) >= rect[0]) & (F.col(x) < rect[1]) & (shifted >= rect[2]) & (shifted < rect[3]))


def erode(window: Window, r: float) -> Window:
    """The window shrunk by r on all sides; unchanged for r <= 0."""
    return window if r <= 0 else (window[0] + r, window[1] + r, window[2] - r, window[3] - r)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null or NaN in the columns."""
    return df.dropna(subset=list(columns))


def with_size(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Every row with its pattern's number of points. Counts are partial sums, joined back: no pattern is gathered."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias(name)), list(keys))


def min_points(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Points of patterns that have n points or more."""
    large = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= n).select(*keys)
    return df.join(large, list(keys), "left_semi")


def more_than_k(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Points of patterns with more than k points."""
    return min_points(df, keys, k + 1)


def crop_occupancy(df: DataFrame, limit: int, column: str = "occupancy") -> DataFrame:
    return df.where(F.col(column) <= limit)


def split_standing(df: DataFrame, column: str = "stand_or_walk") -> tuple[DataFrame, DataFrame]:
    """Standing (0) and walking (1) rows."""
    return df.where(F.col(column) == 0), df.where(F.col(column) == 1)


def dedup_in_snapshot(df: DataFrame, time: str, ident: str, seq: str, keep: str = "last") -> DataFrame:
    """One row for each (time, ident): the first or last by seq, the explicit input order. A row without seq is taken only
    where no other is.

    An aggregate of whole rows by struct order, so repeated detections combine before the exchange."""
    rest = [c for c in df.columns if c not in (time, ident, seq)]
    row = F.struct(seq, *rest)
    picked = df.groupBy(time, ident).agg((F.max(row) if keep == "last" else F.min(F.struct(F.col(seq).isNull(), row.alias("r")))["r"]).alias("r"))
    return picked.select(time, ident, "r.*").select(*df.columns)


def positions(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows, distinct in the order columns, with their place from 0 in that order: rows are ranked inside CUTS + 1 ranges
    between values of the first order column drawn by hash, and shifted by the counts of the ranges below. Only those
    counts pass through one task."""
    first = order[0]
    drawn = rows.select(F.col(first).alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(CUTS)
    cuts = drawn.agg(F.collect_list("v").alias("__cuts"))  # CUTS values at most
    at = F.size(F.filter("__cuts", lambda c: c <= F.col(first)))
    ranged = rows.crossJoin(F.broadcast(cuts)).withColumn("__range", at).drop("__cuts")
    below = F.sum("c").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("c")).select("__range", F.coalesce(below, F.lit(0)).alias("__below"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__nth", inside).join(F.broadcast(counts), "__range").withColumn(name, F.col("__below") + F.col("__nth") - 1).drop("__range", "__nth", "__below")


def to_patterns(df: DataFrame, time: str, x: str, y: str, ident: str | None = None, seq: str = "seq", n_min: int = 1, complete: bool = True) -> DataFrame:
    """(pattern_index, time, ident, seq, x, y): missing values and repeats dropped, patterns of n_min points or more,
    numbered densely from 0 in time order. Only the distinct times are ranked. With complete=False a row needs no place,
    only a time."""
    clean = drop_missing(df, [time, x, y] if complete else [time])
    if ident:
        clean = dedup_in_snapshot(clean, time, ident, seq)
    clean = min_points(clean, [time], n_min)
    # one row per snapshot, not per point, is put in order
    index = positions(clean.select(time).distinct(), [time], "pattern_index")
    return clean.join(index, time).select("pattern_index", time, *([ident] if ident else []), seq, x, y)


def unique_cells(df: DataFrame, keys: Sequence[str], cell: str = "grid_index") -> DataFrame:
    return df.select(*keys, cell).distinct()


def one_row_per_snapshot(df: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """Columns that are equal inside a snapshot, once for each."""
    return df.groupBy(time).agg(*[F.min(c).alias(c) for c in columns])


def first_n_patterns(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the first n patterns in the order of the key."""
    return df.join(positions(df.select(key).distinct(), [key], "__at").where(F.col("__at") < n).select(key), key, "left_semi")


def _turn(ident: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(ident).cast("string")))


def sample_points(df: DataFrame, n: int, seed: int, ident: str = "point_id") -> DataFrame:
    """n rows without replacement: those with the smallest md5 of seed and id."""
    return df.withColumn("__turn", _turn(ident, seed)).orderBy("__turn", ident).limit(n).drop("__turn")


def assign_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Add fold, from 0: patterns are shuffled by md5 and dealt in turn, so folds differ by one pattern at most."""
    turns = df.select(key).distinct().where(F.col(key).isNotNull()).withColumn("__turn", _turn(key, seed))
    folds = positions(turns, ["__turn", key], "__at").select(key, F.pmod("__at", F.lit(k)).cast("int").alias("fold"))
    return df.join(folds, key)


def members(df: DataFrame, folds: Sequence[int], train: bool = False) -> DataFrame:
    """Rows of the folds, or (train) of the other ones."""
    inside = F.col("fold").isin(*folds)
    return df.where(~inside if train else inside)


def superimpose(df: DataFrame, source: str = "source") -> DataFrame:
    """All patterns of a source as one pooled pattern; coincident points stay."""
    return df.select(source, "x", "y")


def bind_sources(sets: dict[str, DataFrame]) -> DataFrame:
    """Sets stacked by name, labelled by source."""
    out = None
    for name, df in sets.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def attach_velocity(points: DataFrame, velocity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Velocities by snapshot and person; null where there is none."""
    return points.join(velocity, list(keys), "left")
