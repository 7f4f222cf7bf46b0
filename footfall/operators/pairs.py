"""Pairs of points inside patterns, and of points with grid cells."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import ranges

KEYS = ranges.KEYS
#: Patterns of so many points or fewer are searched whole; larger ones halve their squares DEPTH times at most.
SMALL, DEPTH = 512, 20
#: Ids that are sent to all tasks; more are met by a shuffle.
FEW = 1_000_000


def _d2():
    return (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))


def ordered_pairs(points: DataFrame, rmax: float | None = None, keys: Sequence[str] = KEYS, carried: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, d2) for all i <> j of a pattern with squared distance d2 <= rmax^2 (None: no bound); carried: columns
    that come along, with i or j behind their names.

    With a bound, points meet by buckets of side rmax: each point is looked for in its own bucket and the eight around it,
    so a crowded pattern costs its close pairs, not the square of its size, and its buckets spread over tasks. Crowded
    buckets are cut: see _spread(). Points with a null or non-finite coordinate have no close pairs.
    """
    if rmax is not None:
        points = ranges.finite_points(points)
    side = lambda a: points.select(*keys, F.col("point_id").alias(a), *[F.col(c).alias(f"{c}{a}") for c in ("x", "y", *carried)])
    left, right, on = side("i"), side("j"), list(keys)
    if rmax is not None:
        bucket = lambda v: F.floor(F.col(v) / F.lit(float(rmax)))
        left = left.withColumn("bx", bucket("xi")).withColumn("by", bucket("yi"))
        around = lambda v: F.explode(F.array(bucket(v) - 1, bucket(v), bucket(v) + 1))
        right = right.withColumn("bx", around("xj")).withColumn("by", around("yj"))
        on += ["bx", "by"]
        # where no bucket holds a third of a tile, its points and those of nine buckets make a tile's square of pairs at most
        if not left.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > ranges.TILE // 3).isEmpty():
            left, right, on = _spread(left, right, on)
    pairs = left.join(right, on).where(F.col("i") != F.col("j")).select(*keys, "i", "j", _d2().alias("d2"), *[f"{c}{a}" for c in carried for a in "ij"])
    return pairs if rmax is None else pairs.where(F.col("d2") <= F.lit(float(rmax) ** 2))


def _spread(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join with further key columns: a key of more than TILE x TILE pairs is cut by its own counts into
    parts of about TILE rows on each side, and every part of one side meets every part of the other once. So a crowd within
    one radius spreads over as many keys as its pairs make tiles, while a row is sent once for each part it meets."""
    on, tile = list(on), ranges.TILE
    counts = left.groupBy(*on).agg(F.count("*").alias("n")).join(right.groupBy(*on).agg(F.count("*").alias("m")), on)
    heavy = counts.where(F.col("n") * F.col("m") > tile * tile).select(*on, F.ceil(F.col("n") / tile).alias("parts_i"), F.ceil(F.col("m") / tile).alias("parts_j"))
    out = []
    for df, mine, other in ((left, "i", "j"), (right, "j", "i")):
        parts = lambda a: F.coalesce(f"parts_{a}", F.lit(1))
        cut = df.join(heavy, on, "left").withColumn(f"part_{mine}", F.pmod(F.xxhash64(mine), parts(mine)))
        met = cut.withColumn(f"part_{other}", F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1))).drop("parts_i", "parts_j")
        out.append(ranges.dealt(met, [*on, "part_i", "part_j"]))
    return out[0], out[1], [*on, "part_i", "part_j"]


def close_pairs(points: DataFrame, rmax: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every unordered pair once (i < j), with its distance."""
    return ordered_pairs(points, rmax, keys).where("i < j").select(*keys, "i", "j", F.sqrt("d2").alias("d"))


def _row_pair_sums(points: DataFrame, rmax: float, keys: Sequence[str]) -> DataFrame:
    """(keys, n_pairs, sum_d2) over all unordered pairs of rows: coincident points are one place with a weight."""
    places = ranges.finite_points(points).groupBy(*keys, "x", "y").agg(F.count("*").alias("w"))
    near = ordered_pairs(places.withColumn("point_id", F.struct("x", "y")), rmax, keys, ["w"]).where("i < j")
    apart = near.select(*keys, (F.col("wi") * F.col("wj")).alias("n"), (F.col("wi") * F.col("wj") * F.col("d2")).alias("s"))
    twins = places.where("w > 1").select(*keys, F.expr("w * (w - 1) div 2").alias("n"), (F.lit(0) * F.col("w") * (F.col("x") - F.col("x"))).alias("s"))
    return apart.unionByName(twins).groupBy(*keys).agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("sum_d2"))


def close_pair_sums(points: DataFrame, rmax: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_pairs, sum_d2): the number of close_pairs() and the sum of their squared distances, for patterns with any.

    Points that coincide meet others once, by their number, so what is sent grows with the places, not with the pairs of
    the points. Rows of one point_id are no pair: their own sums are taken off."""
    keys = list(keys)
    points = points.select(*keys, F.col("point_id").alias("__owner"), "x", "y")
    own = [*keys, "__owner"]
    repeated = points.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").select(*own)
    again = points.join(F.broadcast(repeated) if repeated.limit(FEW + 1).count() <= FEW else repeated, own, "left_semi")
    same = _row_pair_sums(again, rmax, own).groupBy(*keys).agg(F.sum("n_pairs").alias("n"), F.sum("sum_d2").alias("s"))
    less = lambda a, b: (F.col(a) - F.coalesce(b, F.lit(0))).alias(a)
    return _row_pair_sums(points, rmax, keys).join(same, keys, "left").select(*keys, less("n_pairs", "n"), less("sum_d2", "s")).where("n_pairs > 0")


def _nearest_of_few(points: DataFrame, ks: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """(keys, point_id, k, d2) within patterns of SMALL points or fewer: one pass over whole patterns."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pts = batch.column("pts")
            at, flat = pts.offsets.to_numpy(), pts.values
            xs, ys = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            row, point, rank, found = [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                d2 = (xs[a:b, None] - xs[a:b]) ** 2 + (ys[a:b, None] - ys[a:b]) ** 2
                np.fill_diagonal(d2, np.inf)
                have = [k for k in ks if k < b - a]
                if not have:
                    continue
                d2.partition([k - 1 for k in have], axis=1)
                for k in have:
                    row.append(np.full(b - a, i)), point.append(np.arange(a, b)), rank.append(np.full(b - a, k, np.int32)), found.append(d2[:, k - 1])
            if row:
                taken = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keys), flat.field("point_id").take(pa.array(np.concatenate(point))), pa.array(np.concatenate(rank)), pa.array(np.concatenate(found))], [*keys, "point_id", "k", "d2"])

    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in [*keys, "point_id"])
    return ranges.gathered(points, keys, ["point_id", "x", "y"]).mapInArrow(search, f"{kinds}, k int, d2 double")


def knn_distances(points: DataFrame, ks: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, point_id, k, d) distance to the k-th nearest other point for each k, in patterns of more than k points.

    Patterns of SMALL points or fewer are taken whole. The places of larger ones are searched in squares that halve from
    level to level. A place's level is the deepest one at which its own square holds more than k points (the greatest k),
    so the k-th neighbour lies within that square's diagonal, two squares around it at most. As the next level's squares
    hold k points or fewer, 4 k places share a square and its level at most, and each place is compared with 100 k others a
    level at most, however crowded its pattern is. Coincident points count as one place with a weight. Points with a null
    or non-finite coordinate take no part.
    """
    keys, ks = list(keys), sorted(set(ks))
    points = ranges.finite_points(points).select(*keys, "point_id", "x", "y")
    frames = ranges.crowded(points, keys, SMALL)
    if frames.isEmpty():
        found = _nearest_of_few(points, ks, keys)
    else:
        few = points.join(frames.select(*keys), keys, "left_anti")
        found = _nearest_of_few(few, ks, keys).unionByName(_nearest_of_many(points.join(frames.select(*keys), keys, "left_semi"), ks, keys))
    return found.select(*keys, "point_id", "k", F.sqrt("d2").alias("d"))


def knn_distance(points: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, point_id, d): knn_distances() for one k."""
    return knn_distances(points, [k], keys).drop("k")


def _nearest_of_many(points: DataFrame, ks: Sequence[int], keys: Sequence[str]) -> DataFrame:
    k = max(ks)
    places = points.groupBy(*keys, "x", "y").agg(F.count("*").alias("w"))
    frame = places.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.count("*").alias("m"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).cast("double").alias("extent"),
    ).withColumn("depth", F.when(F.col("m") > SMALL, F.lit(DEPTH)).otherwise(F.lit(0))).drop("m")
    share = lambda c, low: F.coalesce((F.col(c) - F.col(low)) / F.nullif(F.col("extent"), F.lit(0.0)), F.lit(0.0))
    placed = places.join(frame, keys).select(*keys, "x", "y", "w", "depth", share("x", "x0").alias("u"), share("y", "y0").alias("v"))

    squares = F.expr("shiftleft(1L, level)")

    def square(c: str) -> Column:
        return F.least(F.floor(F.col(c) * squares), squares - 1)

    cell = [*keys, "level", "cx", "cy"]
    tree = placed.where("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(0), "depth"))).withColumn("cx", square("u")).withColumn("cy", square("v"))
    full = tree.groupBy(*cell).agg(F.sum("w").alias("held")).where(F.col("held") > k).select(*cell)
    deepest = tree.join(full, cell, "left_semi").groupBy(*keys, "x", "y").agg(F.max("level").alias("level"))
    searched = placed.join(deepest, [*keys, "x", "y"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    levels = searched.groupBy(*keys).agg(F.collect_set("level").alias("levels"))  # DEPTH + 1 at most
    right = placed.join(levels, keys).withColumn("level", F.explode("levels")).select(
        *keys, "level", square("u").alias("cx"), square("v").alias("cy"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("w").alias("wj"))

    def around(c: str) -> Column:
        return F.explode(F.sequence(F.greatest(square(c) - 2, F.lit(0).cast("long")), F.least(square(c) + 2, squares - 1)))

    left = searched.where(F.col("w") <= k).withColumn("cx", around("u")).withColumn("cy", around("v")).select(
        *cell, F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("w").alias("wi"))
    pairs = left.join(right, cell).where((F.col("xi") != F.col("xj")) | (F.col("yi") != F.col("yj"))).select(*keys, "xi", "yi", "wi", "wj", _d2().alias("d2"))
    near = W.partitionBy(*keys, "xi", "yi").orderBy("d2")
    nearest = pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    held = F.col("wi") - 1 + F.sum("wj").over(near.rowsBetween(W.unboundedPreceding, W.currentRow))
    wanted = F.explode(F.array(*map(F.lit, ks)))
    reached = nearest.withColumn("held", held).withColumn("k", wanted).where("held >= k and k >= wi").groupBy(*keys, F.col("xi").alias("x"), F.col("yi").alias("y"), "k").agg(F.min("d2").cast("double").alias("d2"))
    twins = searched.withColumn("k", wanted).where("w > k").select(*keys, "x", "y", "k", F.lit(0.0).alias("d2"))
    return points.join(reached.unionByName(twins), [*keys, "x", "y"]).select(*keys, "point_id", "k", "d2")


def first_radius(d: Column, radii: Sequence[float]) -> Column:
    """Number (from 0) of the first of the ascending radii that is d or more, null if none is: by arithmetic on evenly or
    logarithmically spaced radii, corrected by the radii themselves, else by comparing with each."""
    rs = [float(r) for r in radii]
    steps, n = [b - a for a, b in zip(rs, rs[1:])], len(rs)
    even = n > 8 and max(steps) - min(steps) <= 1e-6 * max(steps)
    ratios = [b / a for a, b in zip(rs, rs[1:])] if rs[0] > 0 else []
    if even:
        guess = (d - rs[0]) / (rs[-1] - rs[0]) * (n - 1)
    elif n > 8 and ratios and max(ratios) - min(ratios) <= 1e-6 * max(ratios):
        guess = F.ln(F.greatest(d, F.lit(rs[0] / 2)) / rs[0]) / math.log(rs[-1] / rs[0]) * (n - 1)
    else:
        below = sum(((d > r).cast("int") for r in rs[1:]), (d > rs[0]).cast("int"))
        return F.when(d <= rs[-1], below)
    at = F.least(F.greatest(F.ceil(guess).cast("int") - 1, F.lit(0)), F.lit(n - 1))
    listed = F.array(*map(F.lit, rs))
    more = sum(((d > F.get(listed, F.least(at + i, F.lit(n - 1)))).cast("int") for i in (1, 2)), (d > F.get(listed, at)).cast("int"))
    less = ((at > 0) & (d <= F.get(listed, F.greatest(at - 1, F.lit(0))))).cast("int")
    return F.when(d <= rs[-1], F.least(at + more - less, F.lit(n - 1)))


def neighbour_counts(points: DataFrame, radii: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, point_id, ir, r, c): the number of other points within each radius, zeros included. Points with a null or
    non-finite coordinate have no neighbours."""
    rs = sorted(float(r) for r in radii)
    counted = ranges.range_counts(points, rs, keys)
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    lost = points.where(~(finite("x") & finite("y"))).select(*keys, "point_id", F.array_repeat(F.lit(0).cast("long"), len(rs)).alias("counts"))
    radius = F.get(F.array(*map(F.lit, rs)), F.col("ir"))
    return counted.unionByName(lost).select(*keys, "point_id", F.posexplode("counts").alias("ir", "c")).select(*keys, "point_id", "ir", radius.alias("r"), "c")


def cross_pairs(points: DataFrame, window: tuple[float, float, float, float], nx: int, ny: int, r: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, point_id, grid_index, d): all pairs of a point and a quadrature cell centre at distance r or less.

    The cells around a point follow from its coordinates, so nothing is joined or shuffled."""
    xmin, ymin, xmax, ymax = window
    dx, dy = (xmax - xmin) / nx, (ymax - ymin) / ny

    def span(v: str, low: float, step: float, n: int):
        at = F.floor((F.col(v) - low) / step).cast("int")
        reach = math.ceil(r / step) + 1
        cells = F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(n - 1)))
        return F.explode(F.when(F.least(at + reach, F.lit(n - 1)) >= F.greatest(at - reach, F.lit(0)), cells))

    near = points.withColumn("ix", span("x", xmin, dx, nx)).withColumn("iy", span("y", ymin, dy, ny))
    ux, uy = F.lit(xmin) + (F.col("ix") + 0.5) * dx, F.lit(ymin) + (F.col("iy") + 0.5) * dy
    d = F.sqrt((F.col("x") - ux) * (F.col("x") - ux) + (F.col("y") - uy) * (F.col("y") - uy))
    return near.withColumn("d", d).where(F.col("d") <= r).withColumn("grid_index", F.col("iy") * nx + F.col("ix")).select(*keys, "point_id", "grid_index", "d")
