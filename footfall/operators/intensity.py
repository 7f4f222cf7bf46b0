"""Spatial intensity: continuous and lattice kernel smoothing, bandwidth choice, lookups at points.

Candidate bandwidths (column h) and folds are columns, so one job serves them all. Grids are small and go to the tasks;
points never meet in one place: each task adds up its own points for every cell, and the sums are added by cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import Window, log_floor, normal_cdf
from . import cleaning
from .grid import make_grid
from .profiles import arg_max

EPS = 1e-10


def offset(value: Column) -> Column:
    """Log-intensity offset of any intensity column."""
    return log_floor(value)


def centres(window: Window, nx: int, ny: int) -> np.ndarray:
    """Cell centres row by row, as an array."""
    x = window[0] + (np.arange(nx) + 0.5) * (window[2] - window[0]) / nx
    y = window[1] + (np.arange(ny) + 0.5) * (window[3] - window[1]) / ny
    return np.stack([np.tile(x, ny), np.repeat(y, nx)], axis=1)


def edge_factor(x: Column, y: Column, window: Window, h: Column) -> Column:
    """Mass of a Gaussian kernel at (x, y) inside the window."""
    span = lambda v, low, high: normal_cdf((F.lit(float(high)) - v) / h) - normal_cdf((F.lit(float(low)) - v) / h)
    return span(x, window[0], window[2]) * span(y, window[1], window[3])


#: Box moments leave out less than this share of a kernel's greatest value, a point.
MISSED = 1e-15
#: Points to a box from which its moments pay.
FULL_BOX = 4
#: Side of a box in bandwidths; half of it over sqrt(2) bandwidths, times sqrt(2), is what the bound goes by.
BOX_SIDE = 1.0


def moment_order(missed: float = MISSED) -> int:
    """Terms an axis after which the expansion of a kernel about a box misses less than `missed` of the kernel's greatest value:
    the n-th Hermite function is at most 1.09 sqrt(2^n n!), and a point lies at most BOX_SIDE / (2 sqrt 2) from the centre in
    its units, so the tail is at most 1.09 sum (BOX_SIDE / 2)^n / sqrt(n!), and both axes miss twice that."""
    term = lambda n: 2 * 1.09 * (BOX_SIDE / 2) ** n / math.sqrt(math.factorial(n))
    order = 1
    while sum(term(n) for n in range(order, order + 60)) > missed:
        order += 1
    return order


def hermite(t: np.ndarray, order: int) -> np.ndarray:
    """The first Hermite functions (-1)^n d^n/dt^n exp(-t^2), one row each."""
    out = np.empty((order, len(t)))
    out[0] = np.exp(-t * t)
    if order > 1:
        out[1] = 2 * t * out[0]
    for n in range(1, order - 1):
        out[n + 1] = 2 * t * out[n] - 2 * n * out[n - 1]
    return out


class KernelSums:
    """Gaussian kernels of points, summed at all places of a grid (axes gx and gy) for one bandwidth.

    Points are gathered in boxes of the bandwidth's size as moments, which add up; a box's moments times the Hermite functions
    at the axes are its kernels at all cells. So a point costs the moments, and the cells are met once, when the sums are
    asked for. Points of thinly filled boxes are met with the axes at once, or, where the bandwidth is small, with the few
    cells that they reach."""

    def __init__(self, gx: np.ndarray, gy: np.ndarray, h: float):
        self.gx, self.gy, self.h = gx, gy, h
        self.order, self.unit = moment_order(), math.sqrt(2.0) * h
        self.factorials = np.array([math.factorial(n) for n in range(self.order)], float)
        self.boxes: dict[tuple[int, int], np.ndarray] = {}
        self.direct = np.zeros((len(gy), len(gx)))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        side = BOX_SIDE * self.h
        box = np.stack([np.floor(x / side), np.floor(y / side)], axis=1).astype(np.int64)
        turn = np.lexsort((box[:, 1], box[:, 0]))
        box, x, y = box[turn], x[turn], y[turn]
        starts = np.flatnonzero(np.append(True, (box[1:] != box[:-1]).any(axis=1))) if len(box) else np.empty(0, int)
        stops = np.append(starts[1:], len(box)).astype(int)
        full = (stops - starts >= FULL_BOX) & (self.direct.size > self.order**2)  # a grid of few cells costs less than moments
        thin = np.repeat(~full, stops - starts)
        for a, b in zip(starts[full].tolist(), stops[full].tolist()):
            bx, by = box[a]
            px = self._powers((x[a:b] - (bx + 0.5) * side) / self.unit)
            py = self._powers((y[a:b] - (by + 0.5) * side) / self.unit)
            key = int(bx), int(by)
            self.boxes[key] = self.boxes.get(key, 0.0) + px @ py.T
        xs, ys = x[thin], y[thin]
        for at in range(0, len(xs), 1024):
            self._meet(xs[at : at + 1024], ys[at : at + 1024])

    def _meet(self, x: np.ndarray, y: np.ndarray) -> None:
        reach = self.h * math.sqrt(2 * math.log(10 / MISSED))  # beyond it a kernel is less than what may be missed
        ix, iy = self._within(x, self.gx, reach), self._within(y, self.gy, reach)
        ex = np.exp(-(((x[:, None] - self.gx[np.clip(ix, 0, len(self.gx) - 1)]) / self.unit) ** 2))
        ey = np.exp(-(((y[:, None] - self.gy[np.clip(iy, 0, len(self.gy) - 1)]) / self.unit) ** 2))
        if ix.shape[1] == len(self.gx) and iy.shape[1] == len(self.gy):
            self.direct += ey.T @ ex
            return
        ex *= (ix >= 0) & (ix < len(self.gx))
        ey *= (iy >= 0) & (iy < len(self.gy))
        cell = np.clip(iy, 0, len(self.gy) - 1)[:, :, None] * len(self.gx) + np.clip(ix, 0, len(self.gx) - 1)[:, None, :]
        self.direct += np.bincount(cell.ravel(), (ey[:, :, None] * ex[:, None, :]).ravel(), self.direct.size).reshape(self.direct.shape)

    @staticmethod
    def _within(v: np.ndarray, axis: np.ndarray, reach: float) -> np.ndarray:
        """Places on the axis that a point may reach, one row a point; some may lie outside the axis."""
        step = (axis[-1] - axis[0]) / max(1, len(axis) - 1)
        width = 2 * math.ceil(reach / step) + 1 if step else 1
        if width * 2 >= len(axis):
            return np.broadcast_to(np.arange(len(axis)), (len(v), len(axis)))
        return np.rint((v - axis[0]) / step).astype(np.int64)[:, None] + np.arange(width) - width // 2

    def _powers(self, t: np.ndarray) -> np.ndarray:
        return np.power(t[None, :], np.arange(self.order)[:, None]) / self.factorials[:, None]

    def values(self) -> np.ndarray:
        """The sums by cell, row by row."""
        side, total = BOX_SIDE * self.h, self.direct.copy()
        rows: dict[int, np.ndarray] = {}
        for (bx, by), moments in self.boxes.items():
            along = hermite((self.gx - (bx + 0.5) * side) / self.unit, self.order)
            rows[by] = rows.get(by, 0.0) + moments.T @ along
        for by, part in rows.items():
            total += hermite((self.gy - (by + 0.5) * side) / self.unit, self.order).T @ part
        return np.maximum(total, 0.0).ravel() / (2 * math.pi * self.h * self.h)


def _kernel_sums(window: Window, nx: int, ny: int, hs: Sequence[float]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each task's sums, over its points, of Gaussian kernels at all cells, by group and bandwidth."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = centres(window, nx, ny)
        gx, gy = u[:nx, 0], u[::nx, 1]
        sums: dict[int, list[KernelSums]] = {}
        for frame in frames:
            for group, part in frame.groupby("grp"):
                for kernel in sums.setdefault(int(group), [KernelSums(gx, gy, float(h)) for h in hs]):
                    kernel.add(part["x"].to_numpy(float), part["y"].to_numpy(float))
        for group, kernels in sums.items():
            for kernel in kernels:
                yield pd.DataFrame({"grp": group, "h": kernel.h, "grid_index": np.arange(nx * ny, dtype=np.int32), "s": kernel.values()})

    return batches


def kde_sums(points: DataFrame, window: Window, nx: int, ny: int, hs: Sequence[float], group: Column | None = None) -> DataFrame:
    """(grp, h, grid_index, s): Gaussian kernels of the points inside the window summed at the cell centres."""
    inside = cleaning.crop(points, window).select((group if group is not None else F.lit(0)).cast("int").alias("grp"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return inside.mapInPandas(_kernel_sums(window, nx, ny, list(hs)), "grp int, h double, grid_index int, s double").groupBy("grp", "h", "grid_index").agg(F.sum("s").alias("s"))


def training_sums(folded: DataFrame, window: Window, nx: int, ny: int, wanted: Sequence[tuple[int, float]]) -> DataFrame:
    """(fold, h, grid_index, s): for each wanted (fold, h) the kernels of the points of the other folds (column fold), in one
    pass: a task sums its points by fold and bandwidth, and hands on what lies outside each wanted fold."""
    hs = sorted({float(h) for _, h in wanted})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u = centres(window, nx, ny)
        gx, gy = u[:nx, 0], u[::nx, 1]
        sums: dict[tuple[int, float], KernelSums] = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                for h in hs:
                    if any(f != fold and x == h for f, x in wanted):
                        sums.setdefault((int(fold), h), KernelSums(gx, gy, h)).add(part["x"].to_numpy(float), part["y"].to_numpy(float))
        values = {key: kernel.values() for key, kernel in sums.items()}
        for f, h in dict.fromkeys(wanted):
            outside = [v for (g, x), v in values.items() if g != f and x == h]
            if outside:
                yield pd.DataFrame({"fold": np.int32(f), "h": float(h), "grid_index": np.arange(nx * ny, dtype=np.int32), "s": sum(outside)})

    inside = cleaning.crop(folded, window).select(F.col("fold").cast("int").alias("fold"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return inside.mapInPandas(batches, "fold int, h double, grid_index int, s double").groupBy("fold", "h", "grid_index").agg(F.sum("s").alias("s"))


def edge_values(window: Window, nx: int, ny: int, h: float) -> np.ndarray:
    """edge_factor() at the cell centres, 1e-10 at least: a product of one number for each row and column."""
    u = centres(window, nx, ny)
    cdf = lambda z: np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
    span = lambda v, low, high: cdf((high - v) / h) - cdf((low - v) / h)
    return np.maximum(np.outer(span(u[::nx, 1], window[1], window[3]), span(u[:nx, 0], window[0], window[2])).ravel(), EPS)


def kde_intensity(points: DataFrame, window: Window, nx: int, ny: int, hs: Sequence[float], edge: bool = True) -> DataFrame:
    """(h, grid_index, ix, iy, x, y, value): kernel sums of all patterns pooled, divided by the edge factor; 0 without
    points."""
    spark = points.sparkSession
    sums = kde_sums(points, window, nx, ny, hs).drop("grp")
    candidates = F.explode(F.array(*[F.lit(float(h)) for h in hs]))
    cells = make_grid(spark, window, nx, ny).withColumn("h", candidates)
    value = F.coalesce("s", F.lit(0.0))
    if edge:
        value = value / F.greatest(edge_factor(F.col("x"), F.col("y"), window, F.col("h")), F.lit(1e-10))
    return cells.join(sums, ["h", "grid_index"], "left").select("h", "grid_index", "ix", "iy", "x", "y", value.alias("value"))


def _leave_one_out(x: np.ndarray, hs: Sequence[float], d: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = frame["id"].to_numpy()
            d2 = ((x[at][:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
            d2[np.arange(len(at)), at] = np.inf
            for k, h in enumerate(hs):
                f = np.exp(-d2 / (2 * h * h)).sum(axis=1) / ((2 * math.pi * h * h) ** (d / 2) * (len(x) - 1))
                yield pd.DataFrame({"idx": k, "h": float(h), "score": np.log(np.maximum(f, 1e-300))})

    return batches


def lcv_scores(points: DataFrame, hs: Sequence[float], d: int = 2, max_n: int = 2000, seed: int = 1, ident: str = "point_id") -> DataFrame:
    """(idx, h, score): mean leave-one-out log-density of a Gaussian KDE, over a sample of max_n points at most. The sample
    is what every task needs, and bounded; the rows of the kernel matrix are dealt to tasks in blocks."""
    columns = ["x", "y"][:d]
    rows = cleaning.sample_points(points, max_n, seed, ident).select(*[F.col(c).cast("double") for c in columns]).collect()
    x = np.array([tuple(r) for r in rows], float).reshape(len(rows), d)
    ids = points.sparkSession.range(len(x)).repartition(max(1, len(x) // 128))
    return ids.mapInPandas(_leave_one_out(x, list(hs), d), "idx int, h double, score double").groupBy("idx", "h").agg(F.avg("score").alias("score"))


def lcv_bandwidth(points: DataFrame, hs: Sequence[float], d: int = 2, max_n: int = 2000, seed: int = 1) -> float:
    best = arg_max(lcv_scores(points, hs, d, max_n, seed), "score", "idx").first()
    if best is None:
        raise ValueError("no points to choose a bandwidth from")
    return best["h"]


#: Parts of a fold in which its sample is drawn first.
SALTS = 64


def lcv_bandwidths(folded: DataFrame, k: int, hs: Sequence[float], max_n: int = 2000, seed: int = 1, ident: str = "point_id") -> list[float]:
    """lcv_bandwidth() of the points outside each of the k folds (column fold), and last that of all points: one job for the
    samples, which are as large as max_n allows, and one for all scores."""
    turn = folded.select("fold", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), ident, F.md5(F.concat(F.lit(f"{seed}-"), F.col(ident).cast("string"))).alias("turn"))
    order = ["turn", ident]
    some = turn.withColumn("salt", F.pmod(F.xxhash64(ident), F.lit(SALTS))).withColumn("nth", F.row_number().over(W.partitionBy("fold", "salt").orderBy(*order))).where(F.col("nth") <= max_n)
    firsts = some.withColumn("nth", F.row_number().over(W.partitionBy("fold").orderBy(*order))).where(F.col("nth") <= max_n)
    rows = sorted(firsts.select(*order, "fold", "x", "y").collect(), key=lambda r: (r["turn"], r[ident]))  # k * max_n at most
    samples = [np.array([(r["x"], r["y"]) for r in rows if r["fold"] != f][:max_n], float).reshape(-1, 2) for f in [*range(k), None]]
    if not len(samples[-1]):
        raise ValueError("no points to choose a bandwidth from")
    widths = [float(h) for h in hs]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sample, part in frame.groupby("sample"):
                x, at = samples[int(sample)], part["id"].to_numpy()
                d2 = ((x[at][:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
                d2[np.arange(len(at)), at] = np.inf
                logs = [np.log(np.maximum(np.exp(-d2 / (2 * h * h)).sum(axis=1) / (2 * math.pi * h * h * max(1, len(x) - 1)), 1e-300)).sum() for h in widths]
                yield pd.DataFrame({"idx": np.arange(len(widths), dtype=np.int32), "h": widths, "score": logs, "n": len(at), "sample": int(sample)})

    todo = folded.sparkSession.createDataFrame([(s, i) for s, x in enumerate(samples) for i in range(len(x))], "sample long, id long")
    found = todo.repartition(max(1, sum(map(len, samples)) // 256), "sample", "id").mapInPandas(score, "idx int, h double, score double, n long, sample long")
    means = found.groupBy("sample", "idx", "h").agg((F.sum("score") / F.sum("n")).alias("score"))
    best = {row["sample"]: row["h"] for row in arg_max(means, "score", "idx", ["sample"]).collect()}
    if len(best) < k + 1:
        raise ValueError("no points to choose a bandwidth from")
    return [best[s] for s in range(k + 1)]


def lattice_weights(spark: SparkSession, n: int, hs: Sequence[float]) -> DataFrame:
    """(h, i, j, w): Gaussian weights between the places of a lattice axis, each row i normalised to 1."""
    cells = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    raw = cells.withColumn("h", F.explode(F.array(*[F.lit(float(h)) for h in hs])))
    u = (F.col("i") - F.col("j")) / F.col("h")
    raw = raw.withColumn("k", F.exp(-0.5 * u * u))
    return raw.withColumn("w", F.col("k") / F.sum("k").over(W.partitionBy("h", "i"))).select("h", "i", "j", "w")


def discrete_kde(counts: DataFrame, nx: int, ny: int, hs: Sequence[float], keys: Sequence[str] = (), wanted: DataFrame | None = None) -> DataFrame:
    """(keys, h, ix, iy, value): shares of the points (counts: keys, ix, iy, c) smoothed on the lattice, first along x,
    then along y, for all bandwidths at once. wanted: keys and h of those to make; else all of hs."""
    spark, keys = counts.sparkSession, list(keys)
    totals = counts.groupBy(*keys).agg(F.sum("c").alias("total"))
    shares = (counts.join(F.broadcast(totals), keys) if keys else counts.crossJoin(F.broadcast(totals))).select(*keys, "ix", "iy", (F.col("c") / F.col("total")).alias("p"))
    wx = lattice_weights(spark, nx, hs).select("h", F.col("i").alias("tx"), F.col("j").alias("ix"), F.col("w").alias("wx"))
    wy = lattice_weights(spark, ny, hs).select("h", F.col("i").alias("ty"), F.col("j").alias("iy"), F.col("w").alias("wy"))
    met = shares.join(wx, "ix") if wanted is None else shares.join(wanted, keys).join(wx, ["h", "ix"])
    along_x = met.groupBy(*keys, "h", "tx", "iy").agg(F.sum(F.col("p") * F.col("wx")).alias("p"))
    both = along_x.join(wy, ["h", "iy"]).groupBy(*keys, "h", "tx", "ty").agg(F.sum(F.col("p") * F.col("wy")).alias("value"))
    return both.select(*keys, "h", F.col("tx").alias("ix"), F.col("ty").alias("iy"), "value")


def normalised(raster: DataFrame, keys: Sequence[str], mask: DataFrame | None = None) -> DataFrame:
    """Values divided by their sum in each group; a uniform value over unmasked cells where the sum is 0 or not finite."""
    inside = F.lit(True)
    if mask is not None:
        raster = raster.join(F.broadcast(mask.select("ix", "iy", "masked")), ["ix", "iy"], "left")
        inside = ~F.coalesce("masked", F.lit(False))
    sums = raster.groupBy(*keys).agg(F.sum("value").alias("__s"), F.sum(inside.cast("int")).alias("__n"), F.count("*").alias("__all"))
    joined = raster.join(F.broadcast(sums), list(keys)) if keys else raster.crossJoin(F.broadcast(sums))
    good = (F.col("__s") > 0) & (F.col("__s") < float("inf"))
    flat = F.when(F.col("__n") > 0, inside.cast("double") / F.col("__n")).otherwise(F.lit(1.0) / F.col("__all"))
    return joined.withColumn("value", F.when(good, F.col("value") / F.col("__s")).otherwise(flat)).drop("__s", "__n", "__all", "masked")


def estimate_intensity(counts: DataFrame, nx: int, ny: int, hs: Sequence[float], keys: Sequence[str] = (), mask: DataFrame | None = None, normalize: bool = False, edge_correction: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """discrete_kde, then optionally edge correction (bandwidth and rectangle both in cells), masked cells to 0,
    normalisation, and always + 1e-10. mask: ix, iy, masked."""
    if min(hs, default=1) <= 0:
        raise ValueError("a bandwidth is positive")
    raster = discrete_kde(counts, nx, ny, hs, keys, wanted)
    if edge_correction:
        e = edge_factor(F.col("ix").cast("double"), F.col("iy").cast("double"), (-0.5, -0.5, nx - 0.5, ny - 0.5), F.col("h"))
        raster = raster.withColumn("value", F.col("value") / F.greatest(e, F.lit(EPS)))
    if mask is not None:
        masked = raster.join(F.broadcast(mask.select("ix", "iy", "masked")), ["ix", "iy"], "left")
        raster = masked.withColumn("value", F.when(F.col("masked"), F.lit(0.0)).otherwise(F.col("value"))).drop("masked")
    if normalize:
        raster = normalised(raster, [*keys, "h"], mask)
    return raster.withColumn("value", F.col("value") + EPS)


#: Candidates for a bandwidth that is to be chosen, in cells.
AUTO_HS = [10 ** (-1 + 2 * i / 9) for i in range(10)]


def estimate_intensity_auto(placed: DataFrame, nx: int, ny: int, hs: Sequence[float] = AUTO_HS, k_folds: int = 5, seed: int = 1, unit: str = "point_id", **options) -> DataFrame:
    """estimate_intensity of all points (ix, iy) with the bandwidth that cross-validation over single points chooses: the
    first of the best candidates, fitted again on all folds. Without points an error."""
    best = arg_max(select_bandwidth_discrete(placed, nx, ny, hs, k_folds, seed, True, unit), "ll", "idx").first()
    if best is None:
        raise ValueError("no points to choose a bandwidth from")
    return estimate_intensity(placed.groupBy("ix", "iy").agg(F.count("*").alias("c")), nx, ny, [best["h"]], **options)


def grid_kde(counts: DataFrame, nx: int, ny: int, h: float) -> DataFrame:
    """Smoothed shares normalised to 1, + 1e-10, without a mask."""
    return estimate_intensity(counts, nx, ny, [h], normalize=True)


def log_elementary_symmetric(values: np.ndarray, most: int) -> np.ndarray:
    """ln e_0 ... ln e_most of the values (negative ones count as 0), by the recursion in log space."""
    out = np.full(most + 1, -np.inf)
    out[0] = 0.0
    with np.errstate(divide="ignore"):
        for v in np.log(np.maximum(values, 0.0)):
            out[1:] = np.logaddexp(out[1:], v + out[:-1])
    return out


def _log_norms(keys: Sequence[str], most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def of_raster(frame: pd.DataFrame) -> pd.DataFrame:
        found = log_elementary_symmetric(frame["rho"].to_numpy(), most)
        return pd.DataFrame({**{c: frame[c].iloc[0] for c in keys}, "k": np.arange(most + 1, dtype=np.int64), "loge": found})

    return of_raster


def diag_loglik(rho: DataFrame, counts: DataFrame, n_samples: DataFrame, keys: Sequence[str], conditioned: bool, eps: float = 1e-12) -> DataFrame:
    """(keys, ll): score of samples under the diagonal model for each raster.

    rho: keys, cell, rho; counts: cell and the keys they share with rho, c; n_samples: those shared keys, t, and, for
    samples of more than one cell, one row for each size k. Conditioned on sizes: sum c ln(rho + eps) - sum_k t_k ln e_k,
    with e_k the elementary symmetric polynomials of a raster, or, without k, for samples of one point each,
    - T ln(sum rho); else - T sum ln(1 + rho). A raster is one small group.
    """
    shared = [k for k in keys if k in counts.columns]
    fit = rho.join(counts, [*shared, "cell"]).groupBy(*keys).agg(F.sum(F.col("c") * F.ln(F.col("rho") + eps)).alias("fit"))
    if conditioned and "k" in n_samples.columns:
        most = n_samples.agg(F.max("k")).first()[0] or 0
        types = {f.name: f.dataType.simpleString() for f in rho.schema.fields}
        norms = rho.select(*keys, "rho").groupBy(*keys).applyInPandas(_log_norms(list(keys), int(most)), ", ".join([*[f"{c} {types[c]}" for c in keys], "k long", "loge double"]))
        sizes = n_samples.select(*shared, F.col("k").cast("long").alias("k"), "t")
        paid = norms.join(F.broadcast(sizes), [*shared, "k"]).groupBy(*keys).agg(F.sum(F.col("t") * F.greatest("loge", F.lit(math.log(eps)))).alias("norm"))
        return fit.join(paid, list(keys)).select(*keys, (F.col("fit") - F.col("norm")).alias("ll"))
    whole = F.ln(F.greatest(F.sum("rho"), F.lit(eps))) if conditioned else F.sum(F.log1p("rho"))
    norm = rho.groupBy(*keys).agg(whole.alias("norm"))
    joined = fit.join(norm, list(keys))
    joined = joined.join(F.broadcast(n_samples), shared) if shared else joined.crossJoin(F.broadcast(n_samples))
    return joined.select(*keys, (F.col("fit") - F.col("t") * F.col("norm")).alias("ll"))


def _inner_folds(placed: DataFrame, unit: str, k_folds: int, seed: int) -> DataFrame:
    return placed.withColumn("fold", F.pmod(F.crc32(F.concat(F.lit(f"{seed}-"), F.col(unit).cast("string"))), F.lit(k_folds)).cast("int"))


def _fold_scores(own: DataFrame, sizes: DataFrame, nx: int, ny: int, hs: Sequence[float], conditioned: bool, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, idx, h, ll) summed over folds, from counts (keys, fold, ix, iy, c) and sample sizes (keys, fold, [k,] t). A fold's
    training counts are the total less its own."""
    keys, both = list(keys), [*keys, "fold"]
    total = own.groupBy(*keys, "ix", "iy").agg(F.sum("c").alias("all"))
    folds = own.select(*both).distinct()
    every = folds.join(total, keys) if keys else folds.join(total)
    train = every.join(own, [*both, "ix", "iy"], "left").select(*both, "ix", "iy", (F.col("all") - F.coalesce("c", F.lit(0))).alias("c"))
    raster = estimate_intensity(train, nx, ny, hs, both)
    rho = raster.select(*both, "h", (F.col("iy") * nx + F.col("ix")).alias("cell"), F.sqrt(F.greatest("value", F.lit(1e-16))).alias("rho"))
    test = own.select(*both, (F.col("iy") * nx + F.col("ix")).alias("cell"), "c")
    scores = diag_loglik(rho, test, sizes, [*both, "h"], conditioned)
    order = F.array_position(F.array(*[F.lit(float(h)) for h in hs]), F.col("h")).cast("int") - 1
    return scores.groupBy(*keys, "h").agg(F.sum("ll").alias("ll")).select(*keys, order.alias("idx"), "h", "ll")


def select_bandwidth_discrete(placed: DataFrame, nx: int, ny: int, hs: Sequence[float], k_folds: int = 5, seed: int = 1, conditioned: bool = True, unit: str = "point_id", per_point: bool = True) -> DataFrame:
    """(idx, h, ll) summed over folds: fit on the other folds, score the fold with the diagonal model.

    placed: points with ix, iy. per_point: every point is a sample of size 1 and folds are dealt by a hash of the point;
    else unit names the pattern, folds deal patterns, and a sample is a pattern's distinct cells. conditioned: the score
    given the samples' sizes, whatever they are. The data are read into counts by fold and cell.
    """
    folded = _inner_folds(placed, unit, k_folds, seed) if per_point else cleaning.assign_folds(placed.select(unit, "ix", "iy").distinct(), unit, k_folds, seed)
    own = folded.groupBy("fold", "ix", "iy").agg(F.count("*").alias("c"))
    if per_point:
        sizes = own.groupBy("fold").agg(F.sum("c").alias("t"))
    elif conditioned:
        sizes = folded.groupBy("fold", unit).agg(F.count("*").alias("k")).groupBy("fold", "k").agg(F.count("*").alias("t"))
    else:
        sizes = folded.groupBy("fold").agg(F.countDistinct(unit).alias("t"))
    return _fold_scores(own, sizes, nx, ny, hs, conditioned)


def outside_of_folds(counts: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """Counts (fold, keys, c) summed over the other folds for each of the k folds, and, as outer -1, over all."""
    outer = F.explode(F.filter(F.sequence(F.lit(-1), F.lit(k - 1)), lambda f: f != F.col("fold")))
    return counts.withColumn("outer", outer).groupBy("outer", *keys).agg(F.sum("c").alias("c"))


def select_bandwidths(folded: DataFrame, k: int, nx: int, ny: int, hs: Sequence[float], k_folds: int = 10, seed: int = 1, unit: str = "point_id") -> dict[int, float]:
    """The bandwidth that select_bandwidth_discrete() would choose over single points for the points outside each of the k
    folds (column fold), and, under -1, for all: in one job."""
    inner = _inner_folds(folded.withColumnRenamed("fold", "out"), unit, k_folds, seed)
    counts = inner.groupBy("out", "fold", "ix", "iy").agg(F.count("*").alias("c")).withColumnsRenamed({"fold": "in", "out": "fold"})
    own = outside_of_folds(counts, k, ["in", "ix", "iy"]).withColumnRenamed("in", "fold")
    sizes = own.groupBy("outer", "fold").agg(F.sum("c").alias("t"))
    scores = _fold_scores(own, sizes, nx, ny, hs, True, ["outer"])
    return {row["outer"]: row["h"] for row in arg_max(scores, "ll", "idx", ["outer"]).collect()}


def bilinear_sample(points: DataFrame, raster: DataFrame, window: Window, nx: int, ny: int, keys: Sequence[str] = ()) -> DataFrame:
    """points with value, the bilinear value of each raster (keys, ix, iy, value) at their place; the extent's edges are
    the outer cells' values. A raster travels as one array of nx * ny values, so points are not shuffled."""
    listed = raster.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("iy") * nx + F.col("ix")).alias("at"), "value"))), lambda s: s["value"]).alias("__image"))
    # bounded: one array of nx * ny doubles for each raster
    both = points.crossJoin(F.broadcast(listed))

    def axis(v: str, low: float, high: float, n: int) -> tuple[Column, Column, Column]:
        c = F.least(F.greatest((F.col(v) - low) / max(high - low, 1e-10) * (n - 1), F.lit(0.0)), F.lit(n - 1 - 1e-6))
        first = F.floor(c).cast("int")
        return first, F.least(first + 1, F.lit(n - 1)), c - first

    x0, x1, dx = axis("x", window[0], window[2], nx)
    y0, y1, dy = axis("y", window[1], window[3], ny)
    at = lambda ix, iy: F.element_at("__image", (iy * nx + ix + 1).cast("int"))
    low = at(x0, y0) * (1 - dx) + at(x1, y0) * dx
    high = at(x0, y1) * (1 - dx) + at(x1, y1) * dx
    return both.withColumn("value", low * (1 - dy) + high * dy).drop("__image")


def aggregate_density(points: DataFrame, window: Window, nx: int, ny: int, h: float, percent: float = 99.0) -> DataFrame:
    """Mean-normalised KDE of pooled positions, clipped at a percentile."""
    from .metrics import clip_at_percentile

    n = cleaning.crop(points, window).agg(F.greatest(F.count("*"), F.lit(1)).alias("__n"))
    mean = kde_intensity(points, window, nx, ny, [h], edge=False).crossJoin(F.broadcast(n)).withColumn("value", F.col("value") / F.col("__n")).drop("__n")
    return clip_at_percentile(mean, "value", percent)
