"""Pairwise-interaction models by conditional pseudolikelihood: Strauss (a count) and Diggle-Gates-Stibbard (a log-sine).

For a point i of a pattern, with b the log-intensity and s the interaction with the pattern's other points,

    b_i + alpha s_i - ln( cell area * sum_u exp(b_u + alpha (s_u - delta_iu)) )

over quadrature cells u, where delta_iu is i's own share of s_u (cells beyond r have none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import Window
from . import cleaning, intensity, pairs, ranges
from .profiles import arg_max

KEYS = pairs.KEYS
SIN_FLOOR = 1e-12
SUMS = "set int, h double, ir int, ia int, logcpl double"
#: Distances that a task holds at once.
DISTANCES = 1 << 22
#: Candidate grids; coefficients come from whole numbers, so 1.0 is among them exactly.
COEFFS = {"strauss": [c / 100 for c in range(50, 151, 5)], "dgs": [c / 100 for c in range(50, 146, 5)]}
PILOTS = {"strauss": [float(h) for h in range(10, 2001, 10)], "dgs": [float(h) for h in range(50, 2001, 50)]}
RADII = {"strauss": [float(r) for r in range(100, 2001, 50)], "dgs": [float(r) for r in range(100, 1001, 50)]}
ALPHAS = {"strauss": [math.log(g / 100) for g in range(5, 101, 5)], "dgs": [a / 20 for a in range(201)]}


class Quadrature(NamedTuple):
    """Window, cells, and how the border is treated: erode drops cells and points nearer to it than r (or than
    fixed_radius), keeping the cell size; without pin the grid is laid anew on the eroded window."""

    window: Window
    nx: int = 160
    ny: int = 64
    erode: bool = False
    pin: bool = True
    fixed_radius: float | None = None


def delta_column(d: Column, r: float, kind: str) -> Column:
    """A neighbour's share of s at distance d <= r."""
    if kind == "strauss":
        return F.lit(1.0)
    return 2 * F.ln(F.greatest(F.sin(math.pi * d / (2.0 * r)), F.lit(SIN_FLOOR)))


def cell_stat(points: DataFrame, q: Quadrature, r: float, kind: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, grid_index, s) of the cells that any point reaches; all others have 0."""
    near = pairs.cross_pairs(points, q.window, q.nx, q.ny, r, keys)
    return near.groupBy(*keys, "grid_index").agg(F.sum(delta_column(F.col("d"), r, kind)).alias("s"))


def point_stat(points: DataFrame, r: float, kind: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, point_id, s) for every point, 0 where no other is near. A point's coincident twins are left out with it."""
    near = pairs.ordered_pairs(points, r, keys).where("d2 > 0").groupBy(*keys, F.col("i").alias("point_id")).agg(F.sum(delta_column(F.sqrt("d2"), r, kind)).alias("s"))
    return points.select(*keys, "point_id").join(near, [*keys, "point_id"], "left").fillna(0.0, ["s"])


def _share(d: np.ndarray, r: float, kind: str) -> np.ndarray:
    return np.ones(len(d)) if kind == "strauss" else 2 * np.log(np.maximum(np.sin(np.pi * d / (2 * r)), SIN_FLOOR))


def _links(xy: np.ndarray, others: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and d of every point and every other place at distance r or less, of one part of the points at a time."""
    size, found = max(1, DISTANCES // max(1, len(others))), []
    for at in range(0, len(xy), size):
        part = xy[at : at + size]
        d = np.sqrt((part[:, None, 0] - others[None, :, 0]) ** 2 + (part[:, None, 1] - others[None, :, 1]) ** 2)
        i, j = np.nonzero(d <= r)
        found.append((at + i, j, d[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _log_products(values: np.ndarray) -> np.ndarray:
    """Sums of logarithms along the second axis: of products where these keep clear of over- and underflow, as a product
    costs less than a logarithm."""
    n = values.shape[1]
    low, high = (values.min(), values.max()) if values.size else (1.0, 1.0)
    steps = max(1, int(600 / max(1.0, abs(math.log(low)), abs(math.log(high)))))
    if steps == 1 or n < 2:
        return np.log(values).sum(axis=1)
    return sum(np.log(values[:, at : at + steps].prod(axis=1)) for at in range(0, n, steps))


class _Group(NamedTuple):
    """Radii that share their window and cells: cell centres and area, and places in the list of radii."""

    inner: Window
    u: np.ndarray
    area: float
    at: list[int]


class _Profiler:
    """What tasks do with patterns, or with tiles of them."""

    def __init__(self, images: list[tuple[float, np.ndarray]], q: Quadrature, radii: Sequence[float], alphas: Sequence[float], kind: str):
        self.images, self.window, self.radii, self.alphas, self.kind = images, q.window, list(map(float, radii)), list(map(float, alphas)), kind
        shared: dict[Window, tuple[np.ndarray, float, list[int]]] = {}
        for ir, r in enumerate(self.radii):
            u, area, inner = _cells(q, r)
            if len(u):
                shared.setdefault(inner, (u, area, []))[2].append(ir)
        self.groups = [_Group(inner, u, area, at) for inner, (u, area, at) in shared.items()]
        self.at_cells: dict[int, list[np.ndarray]] = {}
        self.at_weights: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def offsets(self, g: int) -> list[np.ndarray]:
        """Log-intensity of every image at the cells, found where it is needed first."""
        if g not in self.at_cells:
            self.at_cells[g] = [self.log_at(image, self.groups[g].u) for _, image in self.images]
        return self.at_cells[g]

    def log_at(self, image: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(_bilinear(image, self.window, places), 1e-10))

    def reach(self, g: int) -> float:
        return max(self.radii[ir] for ir in self.groups[g].at)

    def field(self, g: int, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells within reach of the points, and the sums of their shares there for each radius of the group."""
        group, reach = self.groups[g], self.reach(g)
        low, high = xy.min(axis=0) - reach, xy.max(axis=0) + reach
        near = np.flatnonzero(((group.u >= low) & (group.u <= high)).all(axis=1))
        _, cell, d = _links(xy, group.u[near], reach)
        out = np.zeros((len(group.at), len(near)))
        for k, ir in enumerate(group.at):
            close = d <= self.radii[ir]
            out[k] = np.bincount(cell[close], weights=_share(d[close], self.radii[ir], self.kind), minlength=len(near))
        return near, out

    def alpha_parts(self, n: int) -> Iterator[slice]:
        """Alphas in parts of about DISTANCES numbers for n places."""
        size = max(1, DISTANCES // max(1, n))
        return (slice(at, at + size) for at in range(0, len(self.alphas), size))

    def weights(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """exp of every image's log-intensity at the cells over its greatest, and that greatest, so that an interaction's
        exponentials serve all images."""
        if g not in self.at_weights:
            logs = np.stack(self.offsets(g))
            top = logs.max(axis=1)
            self.at_weights[g] = np.exp(logs - top[:, None]), top
        return self.at_weights[g]

    def common(self, g: int, field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest term (but for the images' parts), and the sum of all terms over it, of a pattern's cells by image, radius
        and alpha. Cells without interaction count by their sum of weights."""
        group, alphas, (weights, _) = self.groups[g], np.array(self.alphas), self.weights(g)
        shape = (len(self.images), len(group.at), len(alphas))
        peaks, totals = np.zeros(shape), np.zeros(shape)
        for k in range(len(group.at)):
            met = np.flatnonzero(field[k])
            free = len(met) < field.shape[1]
            rest = weights[:, field[k] == 0].sum(axis=1)
            for part in self.alpha_parts(len(met)):
                a = np.outer(field[k][met], alphas[part])
                top = a.max(axis=0, initial=0.0 if free else -np.inf)
                peaks[:, k, part] = top
                totals[:, k, part] = weights[:, met] @ np.exp(a - top) + rest[:, None] * np.exp(-top)
        return peaks, totals

    def neighbours(self, g: int, xy: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Interaction of each point with the others, for each radius of the group. Places that coincide are left out."""
        group = self.groups[g]
        i, _, e = _links(xy, others, self.reach(g))
        out = np.zeros((len(group.at), len(xy)))
        for k, ir in enumerate(group.at):
            close = (e <= self.radii[ir]) & (e > 0)
            out[k] = np.bincount(i[close], weights=_share(e[close], self.radii[ir], self.kind), minlength=len(xy))
        return out

    def values(self, g: int, xy: np.ndarray, s: np.ndarray, cells: np.ndarray, field: np.ndarray, peaks: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Log-pseudolikelihood of the points by image, radius of the group and alpha. Only cells within r of a point differ
        from the pattern's common sum; sums are shifted by their greatest term."""
        group, alphas, m = self.groups[g], np.array(self.alphas), len(xy)
        own, cell, d = _links(xy, group.u[cells], self.reach(g))
        out = np.zeros(peaks.shape)
        weights, tops = self.weights(g)
        weights, b = weights[:, cells], np.array([self.log_at(values, xy).sum() for _, values in self.images])
        for k, ir in enumerate(group.at):
            near = d <= self.radii[ir]
            o, c, share = own[near], cell[near], _share(d[near], self.radii[ir], self.kind)
            starts = np.flatnonzero(np.diff(o, prepend=-1))  # links stand by points
            # peaks and shifts are the same for all images
            for part in self.alpha_parts(max(len(o), len(cells)) * (1 + len(weights))):
                al, peak = alphas[part], peaks[0, k, part]
                shift, less = peak, np.zeros((len(weights), len(starts), len(al)))
                if len(o):
                    a = np.outer(field[k], al)
                    changed = a[c] - share[:, None] * al
                    shift = np.maximum(peak, changed.max(axis=0))
                    more = np.exp(changed - shift) - np.exp(a - shift)[c]
                    for image, w in enumerate(weights):
                        less[image] = np.add.reduceat(w[c][:, None] * more, starts, axis=0)
                whole = np.exp(peak - shift) * totals[:, k, part]
                logs = _log_products(np.maximum(whole[:, None, :] + less, 1e-300)) + (m - len(starts)) * np.log(np.maximum(whole, 1e-300))
                out[:, k, part] = b[:, None] + al * s[k].sum() - m * (math.log(group.area) + tops[:, None] + shift) - logs
        return out

    def pattern(self, xy: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each group of radii with the values of a whole pattern, if it has points inside the group's window."""
        for g, group in enumerate(self.groups):
            x0, y0, x1, y1 = group.inner
            inside = xy[(xy[:, 0] >= x0) & (xy[:, 0] <= x1) & (xy[:, 1] >= y0) & (xy[:, 1] <= y1)]
            if len(inside):
                cells, part = self.field(g, inside)
                field = np.zeros((len(group.at), len(group.u)))
                field[:, cells] = part
                yield g, self.values(g, inside, self.neighbours(g, inside, inside), cells, part, *self.common(g, field))


def _rows(works: dict[int, _Profiler], sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums by set and group of radii as rows."""
    for (s, g), values in sums.items():
        at, work = np.indices(values.shape).reshape(3, -1), works[s]
        columns = [np.full(values.size, s, np.int32), np.array([h for h, _ in work.images])[at[0]], np.array(work.groups[g].at, np.int32)[at[1]], at[2].astype(np.int32), values.ravel()]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["set", "h", "ir", "ia", "logcpl"])


def _places(pts: pa.Array, row: int) -> np.ndarray:
    part = slice(pts.offsets[row].as_py(), pts.offsets[row + 1].as_py())
    return np.stack([pts.values.field(c).to_numpy(zero_copy_only=False)[part] for c in ("x", "y")], axis=1)


def _whole_patterns(points: DataFrame, keys: Sequence[str], works: dict[int, _Profiler]) -> DataFrame:
    """Sums of tasks over patterns that are small enough for one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, s in enumerate(batch.column("set").to_pylist()):
                for g, value in works[s].pattern(_places(batch.column("pts"), row)):
                    sums[s, g] = sums[s, g] + value if (s, g) in sums else value
        yield from _rows(works, sums)

    if len(works) == 1:  # a constant among the keys would be folded, and the rows dealt anew by size, to a few tasks
        return ranges.gathered(points, keys, ["x", "y"]).withColumn("set", F.lit(next(iter(works)))).mapInArrow(run, SUMS)
    return ranges.gathered(points, [*keys, "set"], ["x", "y"]).mapInArrow(run, SUMS)


def _tiles_of_patterns(points: DataFrame, keys: Sequence[str], works: dict[int, _Profiler]) -> DataFrame:
    """The same for patterns of any size, in two phases. First each tile's shares are added up by pattern and cell, and the
    pattern's common sums follow from its cells. Then each tile meets the tiles within reach of it, one by one, and the
    cells within reach with their sums."""
    keys = [*keys, "set", "g"]
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields} | {"g": "int"}
    typed = lambda cs: ", ".join(f"`{c}` {types[c]}" for c in cs)
    fits = [F.when((F.col("set") == s) & F.col("x").between(g.inner[0], g.inner[2]) & F.col("y").between(g.inner[1], g.inner[3]), i) for s, work in works.items() for i, g in enumerate(work.groups)]
    inside = points.withColumn("g", F.explode(F.array_compact(F.array(*fits))))
    tiles = ranges.tiled(inside, ranges.crowded(inside, keys, 0), keys).groupBy(*keys, "tile")
    own = tiles.agg(F.collect_list(F.struct("x", "y")).alias("pts"))  # TILE points at most

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells, part = works[batch.column("set")[row].as_py()].field(batch.column("g")[row].as_py(), _places(batch.column("pts"), row))
                if len(cells):
                    same = pa.array(np.full(part.size, row))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in keys), pa.array(np.tile(cells, len(part)).astype(np.int32)), pa.array(np.repeat(np.arange(len(part), dtype=np.int32), len(cells))), pa.array(part.ravel())], [*keys, "cell", "k", "s"])

    summed = own.mapInArrow(shares, f"{typed(keys)}, cell int, k int, s double").groupBy(*keys, "cell", "k").agg(F.sum("s").alias("s"))
    field = summed.groupBy(*keys, "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("s"))

    def commons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g, cells, work = batch.column("g")[row].as_py(), batch.column("pts")[row].as_py(), works[batch.column("set")[row].as_py()]
                dense = np.zeros((len(work.groups[g].at), len(work.groups[g].u)))
                for c in cells:
                    dense[:, c["cell"]] = c["s"]
                found = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in work.common(g, dense)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, 1) for c in keys), *found], [*keys, "peaks", "totals"])

    # as many rows as the grid has cells
    common = ranges.gathered(field, keys, ["cell", "s"]).mapInArrow(commons, f"{typed(keys)}, peaks array<double>, totals array<double>")
    reach = F.coalesce(*[F.when((F.col("set") == s) & (F.col("g") == g), F.lit(work.reach(g))) for s, work in works.items() for g in range(len(work.groups))])
    box = tiles.agg(*[f(c).alias(n) for c in ("x", "y") for n, f in ((f"{c}0", F.min), (f"{c}1", F.max))]).withColumn("reach", reach)
    centres = spark_cells(points.sparkSession, works)
    halo = box.join(centres, ["set", "g"]).where("ux between x0 - reach and x1 + reach and uy between y0 - reach and y1 + reach").select(*keys, "tile", "cell")
    cells = halo.join(field, [*keys, "cell"]).groupBy(*keys, "tile").agg(F.collect_list(F.struct("cell", "s")).alias("cells"))
    other = box.select(*keys, *[F.col(c).alias(f"{c}b") for c in ("tile", "x0", "x1", "y0", "y1")])
    apart = lambda v: F.greatest(F.lit(0.0), F.col(f"{v}0b") - F.col(f"{v}1"), F.col(f"{v}0") - F.col(f"{v}1b"))
    met = box.join(other, keys).where("tile <> tileb").where(apart("x") * apart("x") + apart("y") * apart("y") <= F.col("reach") * F.col("reach") * (1 + ranges.SLACK))
    empty = "cast(null as array<double>)"
    heads = own.join(common, keys, "left").join(cells, [*keys, "tile"], "left").select(*keys, "tile", F.lit(0).alias("role"), "pts", "cells", "peaks", "totals")
    more = met.select(*keys, F.col("tile").alias("to"), F.col("tileb").alias("tile")).join(own, [*keys, "tile"]).select(
        *keys, F.col("to").alias("tile"), F.lit(1).alias("role"), "pts", F.expr("cast(null as array<struct<cell:int,s:array<double>>>)").alias("cells"), F.expr(empty).alias("peaks"), F.expr(empty).alias("totals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        held: tuple | None = None

        def close() -> None:
            (at, g), xy, s, near, peaks, totals = held
            work = works[at]
            order = np.array([c["cell"] for c in near], int)
            part = np.array([c["s"] for c in near], float).reshape(len(near), len(work.groups[g].at)).T
            shape = (len(work.images), len(work.groups[g].at), len(work.alphas))
            if peaks is None:
                peaks, totals = work.common(g, np.zeros((shape[1], len(work.groups[g].u))))
            value = work.values(g, xy, s, order, part, np.reshape(peaks, shape), np.reshape(totals, shape))
            sums[at, g] = sums[at, g] + value if (at, g) in sums else value

        for batch in batches:
            for row, (role, s, g) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("role", "set", "g")))):
                xy, work = _places(batch.column("pts"), row), works[s]
                if role:
                    held[2][:] += work.neighbours(g, held[1], xy)
                    continue
                if held is not None:
                    close()
                held = ((s, g), xy, work.neighbours(g, xy, xy), batch.column("cells")[row].as_py() or [], batch.column("peaks")[row].as_py(), batch.column("totals")[row].as_py())
        if held is not None:
            close()
        yield from _rows(works, sums)

    return ranges.dealt(heads.unionByName(more), [*keys, "tile"]).sortWithinPartitions(*keys, "tile", "role").mapInArrow(run, SUMS)


def spark_cells(spark: SparkSession, works: dict[int, _Profiler]) -> DataFrame:
    """(set, g, cell, ux, uy): the centres of each group's cells, by the rule of its grid."""
    out = None
    for s, work in works.items():
        for g, group in enumerate(work.groups):
            xs, ys = np.unique(group.u[:, 0]), np.unique(group.u[:, 1])
            pick = lambda values, at: F.get(F.array(*[F.lit(float(v)) for v in values]), at.cast("int"))
            one = spark.range(len(group.u)).select(F.lit(s).alias("set"), F.lit(g).alias("g"), F.col("id").cast("int").alias("cell"), pick(xs, F.col("id") % len(xs)).alias("ux"), pick(ys, F.floor(F.col("id") / len(xs))).alias("uy"))
            out = one if out is None else out.unionByName(one)
    return out


def _bilinear(image: np.ndarray, window: Window, xy: np.ndarray) -> np.ndarray:
    """Values between cells: the two nearest rows and columns of the image, weighted by nearness."""

    def axis(v: np.ndarray, low: float, high: float, n: int) -> tuple[np.ndarray, np.ndarray]:
        place = np.clip((v - low) / max(high - low, 1e-10) * (n - 1), 0, n - 1 - 1e-6)
        lower = place.astype(int)
        return np.stack([lower, np.minimum(lower + 1, n - 1)]), np.stack([1 - (place - lower), place - lower])

    columns, across = axis(xy[:, 0], window[0], window[2], image.shape[1])
    rows, along = axis(xy[:, 1], window[1], window[3], image.shape[0])
    return np.einsum("rn,cn,rcn->n", along, across, image[rows[:, None], columns[None, :]])


def _cells(q: Quadrature, r: float) -> tuple[np.ndarray, float, Window]:
    """Cells in use at r, their area, and the window that points must lie in."""
    width, height = (q.window[2] - q.window[0]) / q.nx, (q.window[3] - q.window[1]) / q.ny
    u = intensity.centres(q.window, q.nx, q.ny)
    if not q.erode:
        return u, width * height, q.window
    reach = q.fixed_radius if q.pin and q.fixed_radius is not None else r
    inner = cleaning.erode(q.window, reach)
    if not q.pin:
        return intensity.centres(inner, q.nx, q.ny), (inner[2] - inner[0]) * (inner[3] - inner[1]) / (q.nx * q.ny), inner
    keep = (u[:, 0] >= inner[0]) & (u[:, 0] <= inner[2]) & (u[:, 1] >= inner[1]) & (u[:, 1] <= inner[3])
    return u[keep], width * height, inner


def _images(raster: DataFrame, q: Quadrature) -> list[tuple[float, np.ndarray]]:
    rows = raster.select("h", (F.col("iy") * q.nx + F.col("ix")).alias("at"), "value").toArrow()  # nx * ny values for each raster
    h, at, value = (rows.column(c).to_numpy() for c in ("h", "at", "value"))
    images = {}
    for x in np.unique(h):
        image = np.zeros(q.nx * q.ny)
        image[at[h == x]] = value[h == x]
        images[float(x)] = image.reshape(q.ny, q.nx)
    return sorted(images.items())


def profile_sets(points: DataFrame, works: dict[int, _Profiler], keys: Sequence[str] = KEYS) -> DataFrame:
    """(set, h, ir, ia, logcpl): sums over the patterns of each set (a column of points) of their log-pseudolikelihoods under
    that set's own images and candidates, in one job. Patterns of ranges.TILE points or fewer are the unit of work; larger
    ones are taken apart in tiles. Tasks add up what they have, and sums by candidate follow."""
    works = {s: work for s, work in works.items() if work.groups and work.images}
    if not works:
        return points.sparkSession.createDataFrame([], SUMS)
    ident = F.col("point_id") if "point_id" in points.columns else F.xxhash64("x", "y")
    inside = ranges.finite_points(points).where(F.col("set").isin(list(works))).select(*keys, "set", ident.alias("point_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    frames = ranges.crowded(inside, keys, ranges.TILE)
    if frames.isEmpty():
        found = _whole_patterns(inside, keys, works)
    else:
        large = frames.select(*keys)
        found = _whole_patterns(inside.join(large, list(keys), "left_anti"), keys, works).unionByName(_tiles_of_patterns(inside.join(large, list(keys), "left_semi"), keys, works))
    return found.groupBy("set", "h", "ir", "ia").agg(F.sum("logcpl").alias("logcpl"))


def _named(found: DataFrame, radii: Sequence[float], alphas: Sequence[float]) -> DataFrame:
    listed = lambda values, at: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(at))
    return found.select("h", "ir", listed(radii, "ir").alias("r"), "ia", listed(alphas, "ia").alias("alpha"), "logcpl")


def profile(points: DataFrame, raster: DataFrame, q: Quadrature, radii: Sequence[float], alphas: Sequence[float], kind: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(h, ir, r, ia, alpha, logcpl): log-pseudolikelihood of all patterns for every candidate and every raster (h, ix, iy,
    value). A raster is one small image, sent to the tasks."""
    work = _Profiler(_images(raster, q), q, radii, alphas, kind)
    return _named(profile_sets(points.withColumn("set", F.lit(0)), {0: work}, keys), radii, alphas)


def best(surface: DataFrame) -> tuple[float, float, float]:
    """First candidate (by r, then alpha) with the greatest value: r, alpha, logcpl."""
    row = arg_max(surface.withColumn("idx", F.col("ir") * 1_000_000 + F.col("ia")), "logcpl", "idx").first()
    if row is None:
        raise ValueError("no pattern to fit")
    return row["r"], row["alpha"], row["logcpl"]


def cpl(points: DataFrame, raster: DataFrame, q: Quadrature, r: float, alpha: float, kind: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same for one candidate with DataFrame operations only: (keys, logcpl). Uneroded windows only.

    raster: ix, iy, value of one intensity."""
    area = (q.window[2] - q.window[0]) * (q.window[3] - q.window[1]) / (q.nx * q.ny)
    spark = points.sparkSession
    from .grid import make_grid

    b = intensity.bilinear_sample(points.select(*keys, "point_id", "x", "y"), raster, q.window, q.nx, q.ny).select(*keys, "point_id", intensity.offset(F.col("value")).alias("b"))
    cells = intensity.bilinear_sample(make_grid(spark, q.window, q.nx, q.ny), raster, q.window, q.nx, q.ny).select("grid_index", intensity.offset(F.col("value")).alias("bu"))
    near = pairs.cross_pairs(points, q.window, q.nx, q.ny, r, keys).withColumn("delta", delta_column(F.col("d"), r, kind))
    s = near.groupBy(*keys, "grid_index").agg(F.sum("delta").alias("s"))
    empty = cells.agg(F.sum(F.exp("bu")).alias("whole"))
    touched = s.join(F.broadcast(cells), "grid_index")
    sums = touched.groupBy(*keys).agg(F.sum(F.exp("bu") * (F.exp(alpha * F.col("s")) - 1)).alias("more"))
    own = near.join(touched, [*keys, "grid_index"]).groupBy(*keys, "point_id").agg(F.sum(F.exp(F.col("bu") + alpha * F.col("s")) * (F.exp(-alpha * F.col("delta")) - 1)).alias("less"))
    at = point_stat(points, r, kind, keys)
    joined = b.join(at, [*keys, "point_id"]).join(own, [*keys, "point_id"], "left").join(sums, list(keys), "left").crossJoin(F.broadcast(empty))
    z = F.ln(area * F.greatest(F.col("whole") + F.coalesce("more", F.lit(0.0)) + F.coalesce("less", F.lit(0.0)), F.lit(1e-300)))
    return joined.groupBy(*keys).agg(F.sum(F.col("b") + alpha * F.col("s") - z).alias("logcpl"))


class Candidates(NamedTuple):
    coeffs: Sequence[float]
    pilots: Sequence[float]
    radii: Sequence[float]
    alphas: Sequence[float]


def candidates(kind: str) -> Candidates:
    return Candidates(COEFFS[kind], PILOTS[kind], RADII[kind], ALPHAS[kind])


def evaluate_bandwidths(train: DataFrame, test: DataFrame, hs: Sequence[float], r: float, alpha: float, q: Quadrature, kind: str) -> DataFrame:
    """(h, logcpl) of the test patterns for rasters fitted on the training patterns at each h: all in one job."""
    raster = intensity.kde_intensity(train, q.window, q.nx, q.ny, hs)
    return profile(test, raster, q, [r], [alpha], kind).select("h", "logcpl")


def reestimate(points: DataFrame, h: float, q: Quadrature, kind: str, c: Candidates) -> tuple[float, float, DataFrame]:
    """r, alpha and the surface at bandwidth h."""
    surface = profile(points, intensity.kde_intensity(points, q.window, q.nx, q.ny, [h]), q, c.radii, c.alphas, kind).persist()
    r, alpha, _ = best(surface)
    return r, alpha, surface


def training_images(folded: DataFrame, q: Quadrature, wanted: Sequence[tuple[int, float]]) -> dict[tuple[int, float], np.ndarray]:
    """For each (fold, h) the intensity of the points outside the fold, at bandwidth h: all in one job. An image is small."""
    sums = intensity.training_sums(folded, q.window, q.nx, q.ny, wanted).toArrow()
    fold, h, at, value = (sums.column(c).to_numpy() for c in ("fold", "h", "grid_index", "s"))
    out = {}
    for f, x in wanted:
        image, mine = np.zeros(q.nx * q.ny), (fold == f) & (h == x)
        image[at[mine]] = value[mine]
        out[f, x] = (image / intensity.edge_values(q.window, q.nx, q.ny, x)).reshape(q.ny, q.nx)
    return out


def run_folds(folded: DataFrame, k: int, pilots: dict[int, float], q: Quadrature, kind: str, c: Candidates) -> list[tuple]:
    """(fold, idx, h, logcpl, h0, r0, alpha0): in every fold the interaction that its training patterns profile best at its
    pilot bandwidth h0, and the score of its own patterns under each candidate bandwidth c * h0. The folds are a column: a
    stage is one job, whatever their number."""
    folds = range(k)
    first = training_images(folded, q, [(f, pilots[f]) for f in folds])
    # a pattern is profiled under the images of all folds but its own, whose label stands for h
    works = {g: _Profiler([(float(f), first[f, pilots[f]]) for f in folds if f != g], q, c.radii, c.alphas, kind) for g in folds}
    as_set = folded.withColumn("set", F.col("fold"))
    surfaces = _named(profile_sets(as_set, works).groupBy("h", "ir", "ia").agg(F.sum("logcpl").alias("logcpl")), c.radii, c.alphas)
    tops = arg_max(surfaces.withColumn("idx", F.col("ir") * 1_000_000 + F.col("ia")), "logcpl", "idx", ["h"]).collect()
    fitted = {int(row["h"]): (row["r"], row["alpha"]) for row in tops}
    if len(fitted) < k:
        raise ValueError("no pattern to fit")
    hs = {f: [pilots[f] * x for x in c.coeffs] for f in folds}
    images = training_images(folded, q, [(f, h) for f in folds for h in dict.fromkeys(hs[f])])
    works = {f: _Profiler([(h, images[f, h]) for h in dict.fromkeys(hs[f])], q, [fitted[f][0]], [fitted[f][1]], kind) for f in folds}
    scores = {(row["set"], row["h"]): row["logcpl"] for row in profile_sets(as_set, works).collect()}
    return [(f, i, h, scores.get((f, h), float("-inf")), pilots[f], *fitted[f]) for f in folds for i, h in enumerate(hs[f])]


def cross_validate(points: DataFrame, q: Quadrature, kind: str, c: Candidates, k: int = 5, pilot: float | None = None, seed: int = 1, max_n: int = 2000, known: dict | None = None) -> dict:
    """Folds over patterns; scores summed by coefficient; the best coefficient times the pilot (the one passed on, or that
    of all data); r and alpha at the pilot and at the chosen bandwidth. Only scalars and images come to the driver, and the
    number of jobs does not depend on k. surface0 and surface1 are persisted for the caller to release. known: an earlier
    result on the same points, whose pilots, and interaction at the pilot of all data, hold again."""
    spark = points.sparkSession
    folded = cleaning.assign_folds(points, "pattern_id", k, seed).persist()
    from .metrics import sum_over_folds

    try:
        chosen_by_fold = known["pilots"] if known else intensity.lcv_bandwidths(folded, k, c.pilots, max_n=max_n)  # the last is that of all points
        overall = chosen_by_fold[-1]
        pilots = {f: pilot or chosen_by_fold[f] for f in range(k)}
        rows = run_folds(folded, k, pilots, q, kind, c)
        results = spark.createDataFrame(rows, "fold int, idx int, h double, logcpl double, h0 double, r0 double, alpha0 double")
        chosen = arg_max(sum_over_folds(results, "idx", "h", "logcpl"), "logcpl", "idx").first()
        h = c.coeffs[chosen["idx"]] * (pilot or overall)
        r0, alpha0, at_pilot = (known["r0"], known["alpha0"], known["surface0"]) if known else reestimate(points, overall, q, kind, c)
        r1, alpha1, at_best = (r0, alpha0, at_pilot) if h == overall else reestimate(points, h, q, kind, c)
    finally:
        folded.unpersist()
    return {"folds": results, "pilots": chosen_by_fold, "pilot": overall, "h": h, "r0": r0, "alpha0": alpha0, "r1": r1, "alpha1": alpha1, "surface0": at_pilot, "surface1": at_best}


def refine(points: DataFrame, q: Quadrature, kind: str, c: Candidates, n_iter: int = 10, k: int = 5, seed: int = 1, max_n: int = 2000) -> DataFrame:
    """(iteration, h, r, alpha): cross-validation repeated from the last bandwidth; row 0 holds the pilot's values. A bandwidth
    that is chosen again is chosen ever after, so nothing is computed anew from there on."""
    path, found, settled = [], None, False
    for i in range(n_iter):
        if settled:
            path.append((i + 1, *path[-1][1:]))
            continue
        before = found and found["h"]
        found = cross_validate(points, q, kind, c, k, before, seed, max_n, found)
        settled = found["h"] == before
        if i == 0:
            path.append((0, float(found["pilot"]), float(found["r0"]), float(found["alpha0"])))
        path.append((i + 1, float(found["h"]), float(found["r1"]), float(found["alpha1"])))
        if found["surface1"] is not found["surface0"]:
            found["surface1"].unpersist()
    if found:
        found["surface0"].unpersist()
    return points.sparkSession.createDataFrame(path, "iteration int, h double, r double, alpha double")
