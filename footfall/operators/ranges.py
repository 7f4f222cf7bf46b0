"""How many points, or how much weight, lie within each of many radii of a point, without rows for pairs.

Small patterns are one tile. Larger ones are cut by a quadtree until a square holds TILE points or fewer. Of two tiles, or
two blocks of points inside them, the least and greatest distance of their boxes tell the radii that hold all of their
pairs and those that hold none; only for the radii between are distances taken, of one block to a run of blocks, and
counted at once. A tile of points is what a task holds; tiles that any radius passes through are sent to it one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("source", "pattern_id")
#: Points of a tile and of a block, and how often a square is halved at most.
TILE, BLOCK, DEPTH = 4096, 128, 20
#: Distances of boxes are rounded, so only those that differ by more decide.
SLACK = 1e-9
REST = "array<struct<k:int,n:bigint,w:double>>"
#: Tiles sent to Python in one batch: each may hold TILE points.
BATCH = 64


def thresholds(radii: Sequence[float]) -> np.ndarray:
    """For each radius the greatest square of a distance whose root is not above it."""
    t = np.square(np.asarray(radii, float))
    for _ in range(4):
        t = np.where(np.sqrt(t) > radii, np.nextafter(t, -np.inf), t)
        up = np.nextafter(t, np.inf)
        t = np.where(np.sqrt(up) <= radii, up, t)
    return t


def finite_points(points: DataFrame) -> DataFrame:
    """Points whose coordinates are numbers; the others have no neighbours."""
    good = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    return points.where(good("x") & good("y"))


def crowded(points: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """(keys, x0, y0, extent): the frames of patterns of more than `most` points."""
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).cast("double")
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").cast("double").alias("x0"), F.min("y").cast("double").alias("y0"), extent.alias("extent"))
    return sizes.where(F.col("n") > most).drop("n")


def tiled(points: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS, most: int | None = None) -> DataFrame:
    """The points of the patterns framed, with tile, a string: the largest quadtree square that holds `most` points or
    fewer. Where more share one place, they are dealt by a hash."""
    keys, most, squares = list(keys), most or TILE, 1 << DEPTH
    fine = lambda c, low: F.least(F.floor(F.coalesce((F.col(c) - F.col(low)) / F.nullif(F.col("extent"), F.lit(0.0)), F.lit(0.0)) * squares), F.lit(squares - 1)).cast("long")
    placed = points.join(frames, keys).withColumn("__cx", fine("x", "x0")).withColumn("__cy", fine("y", "y0")).drop("x0", "y0", "extent")
    finest = placed.groupBy(*keys, "__cx", "__cy").agg(F.count("*").alias("n"))
    up = lambda c: F.expr(f"shiftright({c}, {DEPTH} - level)")
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))).select("*", up("__cx").alias("sx"), up("__cy").alias("sy"))
    full = levels.groupBy(*keys, "level", "sx", "sy").agg(F.sum("n").alias("held")).where(F.col("held") > most)
    deepest = levels.join(full, [*keys, "level", "sx", "sy"]).groupBy(*keys, "__cx", "__cy").agg(F.max(F.struct("level", "held")).alias("__full"))
    found = placed.join(deepest, [*keys, "__cx", "__cy"], "left").withColumn("level", F.least(F.coalesce("__full.level", F.lit(-1)) + 1, F.lit(DEPTH)))
    parts = F.when(F.col("__full.level") == DEPTH, F.ceil(F.col("__full.held") / most)).otherwise(F.lit(1))
    name = F.concat_ws("/", "level", up("__cx"), up("__cy"), F.pmod(F.xxhash64("point_id"), parts))
    return found.withColumn("tile", name).drop("__cx", "__cy", "__full", "level")


def _blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which each BLOCK of them is compact, and where the blocks begin."""
    n = len(x)
    slab = BLOCK * max(1, math.ceil(math.sqrt(n / BLOCK)))
    by_x = np.argsort(x, kind="stable")
    order = np.concatenate([by_x[at : at + slab][np.argsort(y[by_x[at : at + slab]], kind="stable")] for at in range(0, n, slab)]) if n else by_x
    return order, np.append(np.arange(0, n, BLOCK), n)


class Place:
    """Points of a tile in blocks, with the boxes of these."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None):
        self.order, self.edges = _blocks(x, y)
        self.x, self.y = x[self.order], y[self.order]
        self.w = None if w is None else w[self.order]
        at = self.edges[:-1]
        self.box = np.stack([np.minimum.reduceat(self.x, at), np.minimum.reduceat(self.y, at), np.maximum.reduceat(self.x, at), np.maximum.reduceat(self.y, at)])


def _add(counts: np.ndarray, sums: np.ndarray | None, q: Place, s: Place, t: np.ndarray) -> None:
    """Adds for each point of q, in its blocks' order, the points and weights of s within each threshold."""
    sizes = np.diff(s.edges)
    for b in range(len(q.edges) - 1):
        mine = slice(q.edges[b], q.edges[b + 1])
        x, y = q.x[mine], q.y[mine]
        x0, y0, x1, y1 = q.box[:, b]
        gap = lambda a0, a1, b0, b1: np.maximum(0.0, np.maximum(b0 - a1, a0 - b1))
        far = lambda a0, a1, b0, b1: np.maximum(b1 - a0, a1 - b0)
        least = gap(x0, x1, s.box[0], s.box[2]) ** 2 + gap(y0, y1, s.box[1], s.box[3]) ** 2
        most = far(x0, x1, s.box[0], s.box[2]) ** 2 + far(y0, y1, s.box[1], s.box[3]) ** 2
        turn = np.argsort(least + most, kind="stable")
        held = (most[turn] * (1 + SLACK))[:, None] <= t
        out = (least[turn] * (1 - SLACK))[:, None] > t
        n = len(turn)
        first = np.where(held.all(axis=0), n, np.argmin(held, axis=0))  # blocks before it are inside the radius
        last = np.where(out.all(axis=0), 0, n - np.argmin(out[::-1], axis=0))  # those from it on are outside
        counts[mine] += np.concatenate([[0], np.cumsum(sizes[turn])])[first]
        if sums is not None:
            sums[mine] += np.concatenate([[0], np.cumsum(np.add.reduceat(s.w, s.edges[:-1])[turn])])[first]
        open_ = np.flatnonzero(first < last)
        if not len(open_):
            continue
        low, high = first[open_].min(), last[open_].max()
        columns = np.concatenate([np.arange(s.edges[i], s.edges[i + 1]) for i in turn[low:high]])
        starts = np.concatenate([[0], np.cumsum(sizes[turn[low:high]])])
        d2 = (x[:, None] - s.x[columns]) ** 2 + (y[:, None] - s.y[columns]) ** 2
        for k in open_:
            part = slice(starts[first[k] - low], starts[last[k] - low])
            near = d2[:, part] <= t[k]
            counts[mine, k] += np.count_nonzero(near, axis=1)
            if sums is not None:
                sums[mine, k] += near @ s.w[columns[part]]


def _few(x: np.ndarray, y: np.ndarray, w: np.ndarray | None, t: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Counts and sums among a few points, each at the first threshold that holds the pair, then added up."""
    n, k = len(x), len(t) + 1
    bins = np.searchsorted(t, ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2).ravel()) + np.repeat(np.arange(n) * k, n)
    added = lambda weights: np.bincount(bins, weights, n * k).reshape(n, k)[:, :-1].cumsum(axis=1)
    return added(None).astype(np.int64), None if w is None else added(np.tile(w, n))


def counter(radii: Sequence[float], weighted: bool):
    """Work on sorted rows of a tile's points, and then of those tiles that it has to meet."""
    t = thresholds(radii)

    def close(held: dict) -> tuple:
        q, counts, sums = held["place"], held["counts"], held["sums"]
        back = np.empty(len(q.order), np.int64)
        back[q.order] = np.arange(len(q.order))
        return held["row"], counts[back] - 1, None if sums is None else sums[back] - held["w"][:, None]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            pts, roles = batch.column("pts"), batch.column("role").to_pylist()
            offsets, flat = pts.offsets.to_numpy(), pts.values
            number = lambda c: flat.field(c).to_numpy(zero_copy_only=False).astype(float)
            xs, ys, ws = number("x"), number("y"), number("w") if weighted else None
            for i, role in enumerate(roles):
                part = slice(offsets[i], offsets[i + 1])
                x, y, w = xs[part], ys[part], None if ws is None else np.nan_to_num(ws[part])
                if role:  # another tile for the one at hand
                    _add(held["counts"], held["sums"], held["place"], Place(x, y, w), t)
                    continue
                if held is not None:
                    yield close(held)
                    held = None
                row = batch.slice(i, 1)
                if not row.column("tile")[0].as_py() and len(x) <= 2 * BLOCK:
                    counts, sums = _few(x, y, w, t)
                    yield row, counts - 1, None if sums is None else sums - w[:, None]
                    continue
                place = Place(x, y, w)
                counts = np.zeros((len(x), len(t)), np.int64)
                sums = None if w is None else np.zeros((len(x), len(t)))
                _add(counts, sums, place, place, t)
                for told in row.column("rest")[0].as_py() or ():
                    counts[:, told["k"] :] += told["n"]
                    if sums is not None:
                        sums[:, told["k"] :] += told["w"]
                held = {"row": row, "place": place, "counts": counts, "sums": sums, "w": w}
        if held is not None:
            yield close(held)

    return work


def _listed(array: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, array.size + 1, array.shape[1]), pa.int32()), pa.array(array.ravel()))


def _rows(points: DataFrame, radii: Sequence[float], keys: Sequence[str], weight: str | None) -> DataFrame:
    """Per tile its points (role 0) with what the tiles wholly inside or outside each radius add (rest), followed by the
    points of the tiles to meet (role 1)."""
    keys = list(keys)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)
    inside = finite_points(points).select(*keys, "point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), w.alias("w"))
    fields = F.struct("point_id", "x", "y", *(["w"] if weight else []))
    listed = lambda df: df.agg(F.collect_list(fields).alias("pts"))  # TILE points at most
    alone = lambda df: listed(dealt(df, keys).groupBy(*keys)).select(*keys, F.lit("").alias("tile"), F.lit(0).alias("role"), F.expr(f"cast(null as {REST})").alias("rest"), "pts")
    frames = crowded(inside, keys, TILE)
    if frames.isEmpty():
        return alone(inside)
    tiles = tiled(inside, frames, keys).groupBy(*keys, "tile")
    own = listed(tiles)
    box = tiles.agg(*[f(c).alias(n) for c in ("x", "y") for n, f in ((f"{c}0", F.min), (f"{c}1", F.max))], F.count("*").alias("n"), F.sum("w").alias("w"))
    a, b = box.select(*keys, *[F.col(c).alias(f"{c}a") for c in box.columns[len(keys) :]]), box.select(*keys, *[F.col(c).alias(f"{c}b") for c in box.columns[len(keys) :]])
    gap = lambda v: F.greatest(F.lit(0.0), F.col(f"{v}0b") - F.col(f"{v}1a"), F.col(f"{v}0a") - F.col(f"{v}1b"))
    far = lambda v: F.greatest(F.col(f"{v}1b") - F.col(f"{v}0a"), F.col(f"{v}1a") - F.col(f"{v}0b"))
    t = F.array(*[F.lit(float(x)) for x in thresholds(radii)])
    below = lambda c: F.size(F.filter(t, lambda x: x < c))
    met = a.join(b, keys).where("tilea <> tileb").select(*keys, "tilea", "tileb", "nb", "wb",
        below((gap("x") * gap("x") + gap("y") * gap("y")) * (1 - SLACK)).alias("none"), below((far("x") * far("x") + far("y") * far("y")) * (1 + SLACK)).alias("k"))
    told = met.where("none = k").groupBy(*keys, "tilea", "k").agg(F.sum("nb").alias("n"), F.sum("wb").alias("w"))
    rest = told.groupBy(*keys, F.col("tilea").alias("tile")).agg(F.collect_list(F.struct("k", "n", "w")).alias("rest"))  # as long as the list of radii
    heads = own.join(rest, [*keys, "tile"], "left").select(*keys, "tile", F.lit(0).alias("role"), "rest", "pts")
    more = met.where("none < k").select(*keys, F.col("tilea"), F.col("tileb").alias("tile")).join(own, [*keys, "tile"]).select(*keys, F.col("tilea").alias("tile"), F.lit(1).alias("role"), F.expr(f"cast(null as {REST})").alias("rest"), "pts")
    spread = dealt(heads.unionByName(more), [*keys, "tile"]).sortWithinPartitions(*keys, "tile", "role")
    return spread.unionByName(alone(inside.join(frames.select(*keys), keys, "left_anti")))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, BATCH) for batch in batches for at in range(0, batch.num_rows, BATCH))


def _schema(points: DataFrame, columns: Sequence[str], more: str) -> str:
    return ", ".join([*[f"`{c}` {points.schema[c].dataType.simpleString()}" for c in columns], more])


def range_counts(points: DataFrame, radii: Sequence[float], keys: Sequence[str] = KEYS, weight: str | None = None) -> DataFrame:
    """(keys, point_id, counts[, sums]): for every point with finite coordinates the number, and with `weight` the summed
    weight (null or NaN: 0), of the other points within each of the ascending radii, as arrays along them."""
    rs = [float(r) for r in radii]
    work = counter(rs, weight is not None)
    names = [*keys, "point_id", "counts", *(["sums"] if weight else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, counts, sums in work(_each(batches)):
            ids = row.column("pts").values.field("point_id").slice(row.column("pts").offsets[0].as_py(), len(counts))
            same = pa.array(np.zeros(len(counts), np.int64))
            yield pa.RecordBatch.from_arrays([*(row.column(k).take(same) for k in keys), ids, _listed(counts), *([_listed(sums)] if sums is not None else [])], names)

    schema = _schema(points, [*keys, "point_id"], "counts array<bigint>" + (", sums array<double>" if weight else ""))
    return _rows(points, rs, keys, weight).mapInArrow(run, schema)


def range_profile(points: DataFrame, radii: Sequence[float], keys: Sequence[str] = KEYS, weight: str | None = None) -> DataFrame:
    """(keys, n, ir, c1, c2[, w, v]): of every pattern and radius the sum, and the sum of squares, of its points' counts;
    with `weight` also the sum of the weights, and of the products of the weights of all ordered pairs within the radius.
    Tasks add up their tiles, so what is shuffled has a row per tile, not per point."""
    rs = [float(r) for r in radii]
    work = counter(rs, weight is not None)
    exact = pa.decimal128(38, 0)

    def squares(counts: np.ndarray) -> pa.Array:
        if not counts.size or counts.max() < 1 << 25:
            return pa.array((counts * counts).sum(axis=0)).cast(exact)
        high, low = counts >> 20, counts & ((1 << 20) - 1)
        parts = ((high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0))
        return pa.array([(int(a) << 40) + (int(b) << 21) + int(c) for a, b, c in zip(*parts)], exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, counts, sums in work(_each(batches)):
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(rs)], pa.int32()), x)
            found = {"m": pa.array([len(counts)]), "one": one(pa.array(counts.sum(axis=0))), "two": one(squares(counts))}
            if sums is not None:
                pts = row.column("pts")
                w = np.nan_to_num(pts.values.field("w").to_numpy(zero_copy_only=False)[pts.offsets[0].as_py() : pts.offsets[1].as_py()])
                found |= {"w": pa.array([w.sum()]), "prod": one(pa.array(w @ sums))}
            yield pa.RecordBatch.from_arrays([*(row.column(k) for k in keys), *found.values()], [*keys, *found])

    schema = _schema(points, keys, "m bigint, one array<bigint>, two array<decimal(38,0)>" + (", w double, prod array<double>" if weight else ""))
    found = _rows(points, rs, keys, weight).mapInArrow(run, schema)
    each = F.inline(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(rs) - 1)).alias("ir"), *[F.col(c) for c in ("one", "two", *(["prod"] if weight else []))]))
    totals = [F.sum("m").alias("n"), F.sum("one").alias("c1"), F.sum("two").alias("c2"), *([F.sum("w").alias("w"), F.sum("prod").alias("v")] if weight else [])]
    return found.select(*keys, "m", *(["w"] if weight else []), each).groupBy(*keys, "ir").agg(*totals)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df by keys, in as many partitions as the session has for shuffles, which no later step joins for their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def gathered(points: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, pts): the fields of each pattern's points together; for patterns known to be small. The work on a row is far
    more than its bytes tell, so partitions are as many as the session has for shuffles, and not joined."""
    return dealt(points, keys).groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("pts"))
