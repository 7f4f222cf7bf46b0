"""Determinantal models on a grid: per-sample log-determinants, normalisers, profiles and cross-validation.

A sample is a pattern's distinct cells. The kernel between cells is rho_i rho_j exp(-d^beta / (2 sigma^beta)), d in cells;
its entries are computed where they are needed and never stored as a table. Candidates (h, sigma) are columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cleaning, intensity, ranges
from .intensity import log_elementary_symmetric
from .metrics import sum_over_folds
from .profiles import arg_max, best_interior

KEYS = ("source", "pattern_id")
#: Candidates: sigmas, coefficients of the pilot bandwidth (from whole numbers, 1.0 among them), pilot bandwidths.
SIGMAS = [0.1 * i for i in range(2, 100)]
COEFFS = [c / 10 for c in range(9, 101)]
PILOTS = [h / 10 for h in range(1, 101)]
SCORE_JITTER, PROFILE_JITTER = 1e-6, 1e-8


def kernel_entries(samples: DataFrame, sigma: float, beta: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, i, j, value) of every sample's own kernel matrix, from rows (keys, cell, ix, iy, rho)."""
    side = lambda n: samples.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in ("cell", "ix", "iy", "rho")])
    d2 = (F.col("ix_i") - F.col("ix_j")) * (F.col("ix_i") - F.col("ix_j")) + (F.col("iy_i") - F.col("iy_j")) * (F.col("iy_i") - F.col("iy_j"))
    value = F.col("rho_i") * F.col("rho_j") * F.exp(-F.pow(d2.cast("double"), F.lit(beta / 2)) / (2 * sigma**beta))
    return side("i").join(side("j"), list(keys)).select(*keys, F.col("cell_i").alias("i"), F.col("cell_j").alias("j"), value.alias("value"))


def _kernel(ix: np.ndarray, iy: np.ndarray, rho: np.ndarray, sigma: float, beta: float = 2.0) -> np.ndarray:
    d2 = (ix[:, None] - ix[None, :]) ** 2.0 + (iy[:, None] - iy[None, :]) ** 2.0
    return np.outer(rho, rho) * np.exp(-(d2 ** (beta / 2)) / (2 * sigma**beta))


def log_det(matrix: np.ndarray, jitter: float) -> float:
    """ln det(matrix + jitter I) by Cholesky; 0 where it is not positive definite."""
    try:
        return float(2 * np.log(np.diag(np.linalg.cholesky(matrix + jitter * np.eye(len(matrix))))).sum())
    except np.linalg.LinAlgError:
        return 0.0


#: Interaction ranges to try: for all rasters alike, or for each by its h.
Sigmas = Sequence[float] | dict[float, Sequence[float]]


def _sigmas_at(sigmas: Sigmas, h: float) -> list[float]:
    return [float(s) for s in (sigmas[h] if isinstance(sigmas, dict) else sigmas)]


class _Rasters(NamedTuple):
    """Cells of all rasters by number, and each raster's rho on them, NaN where it has none. Rasters are small."""

    cell: np.ndarray
    ix: np.ndarray
    iy: np.ndarray
    rho: dict[float, np.ndarray]


def _rasters(rho: DataFrame) -> _Rasters:
    rows = rho.select("h", "cell", "ix", "iy", "rho").toPandas()  # one row per cell and raster
    cell, at = np.unique(rows["cell"].to_numpy(np.int64), return_index=True)
    images = {}
    for h, part in rows.groupby("h"):
        images[float(h)] = np.full(len(cell), np.nan)
        images[float(h)][np.searchsorted(cell, part["cell"].to_numpy(np.int64))] = part["rho"].to_numpy(float)
    return _Rasters(cell, rows["ix"].to_numpy(float)[at], rows["iy"].to_numpy(float)[at], images)


#: Numbers in the matrices that a task holds at once, unless one matrix has more.
NUMBERS = 1 << 16


def _stacked_log_dets(rhos: np.ndarray, falls: np.ndarray, jitter: float) -> np.ndarray:
    """log_det() of rho_i rho_j * fall_ij for every row of rhos and matrix of falls; stacks of matrices at once."""
    k, diagonal = rhos.shape[1], np.arange(rhos.shape[1])
    out = np.empty((len(rhos), len(falls)))
    many = max(1, NUMBERS // max(1, k * k))
    for at in range(0, len(falls), many):
        some = falls[at : at + many]
        few = max(1, many // len(some))
        for r in range(0, len(rhos), few):
            part = rhos[r : r + few]
            stack = (part[:, None, :, None] * part[:, None, None, :] * some).reshape(-1, k, k)
            stack[:, diagonal, diagonal] += jitter
            try:
                found = 2 * np.log(np.linalg.cholesky(stack)[:, diagonal, diagonal]).sum(axis=1)
            except np.linalg.LinAlgError:  # one of them is not positive definite
                found = np.array([log_det(one, 0.0) for one in stack])
            out[r : r + few, at : at + many] = found.reshape(len(part), len(some))
    return out


class _Scorer:
    """Log-determinants of a sample's own matrices under the rasters and sigmas it is met with."""

    def __init__(self, rasters: _Rasters, sigmas: Sigmas, jitter: float):
        self.rasters, self.jitter = rasters, jitter
        self.sigmas = {h: tuple(_sigmas_at(sigmas, h)) for h in rasters.rho}
        self.whole = {h for h, rho in rasters.rho.items() if not np.isnan(rho).any()}

    def __call__(self, cells: np.ndarray, hs: Sequence[float]) -> Iterator[tuple[tuple[float, ...], int, np.ndarray]]:
        """(rasters, cells that they hold, log-determinants by raster and sigma); rasters of like cells and sigmas share
        the matrices of distances."""
        known = self.rasters
        at = np.sort(np.searchsorted(known.cell, cells)[np.isin(cells, known.cell)])
        alike: dict[tuple, list[float]] = {}
        for h in hs:
            if h in known.rho:
                alike.setdefault((self.sigmas[h], None if h in self.whole else np.isnan(known.rho[h][at]).tobytes()), []).append(h)
        for (own, lost), part in alike.items():
            kept = at if lost is None else at[~np.frombuffer(lost, bool)]
            if len(kept):
                x, y = known.ix[kept], known.iy[kept]
                d2, place = np.unique((x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2, return_inverse=True)
                falls = np.exp(-d2[None, :] / (2 * np.array(own)[:, None] ** 2))[:, place.reshape(len(kept), len(kept))]
                yield tuple(part), len(kept), _stacked_log_dets(np.stack([known.rho[h][kept] for h in part]), falls, self.jitter)


def _scored_samples(samples: DataFrame, rasters: _Rasters, sigmas: Sigmas, jitter: float, keys: Sequence[str], uses: dict[int, list[float]] | None, summed: bool) -> DataFrame:
    """(h, isig, sigma, k, logdet, n), one row per sample, raster and sigma, or (summed) what a task's samples of one size
    add up to."""
    names = ["h", "isig", "sigma", "k", "logdet", "n"]

    def rows(scorer: _Scorer, hs: tuple[float, ...], k: int, logdets: np.ndarray, n: int) -> pd.DataFrame:
        own = scorer.sigmas[hs[0]]
        return pd.DataFrame({"h": np.repeat(hs, len(own)), "isig": np.tile(np.arange(len(own), dtype=np.int32), len(hs)), "sigma": np.tile(own, len(hs)), "k": np.int32(k), "logdet": logdets.ravel(), "n": n}, columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, sums = _Scorer(rasters, sigmas, jitter), {}
        for frame in frames:
            for fold, cells in zip(frame["fold"], frame["cells"]):
                for hs, k, found in scorer(np.asarray(cells, np.int64), list(rasters.rho) if uses is None else uses.get(fold, [])):
                    if not summed:
                        yield rows(scorer, hs, k, found, 1)
                        continue
                    total, n = sums.get((hs, k), (0.0, 0))
                    sums[hs, k] = total + found, n + 1
        for (hs, k), found in sums.items():
            yield rows(scorer, hs, k, *found)

    # a constant among the keys would be folded, and the rows dealt anew by size, to a few tasks
    by = list(keys) if uses is None else [*keys, "fold"]
    placed = ranges.gathered(samples.select(*by, F.col("cell").cast("long").alias("cell")), by, ["cell"])
    placed = placed.withColumn("fold", F.lit(0)) if uses is None else placed
    return placed.select("fold", F.col("pts.cell").alias("cells")).mapInPandas(run, "h double, isig int, sigma double, k int, logdet double, n long")


def sample_logdet(samples: DataFrame, rho: DataFrame, sigmas: Sigmas, jitter: float = SCORE_JITTER, keys: Sequence[str] = KEYS, uses: dict[int, list[float]] | None = None) -> DataFrame:
    """(h, isig, sigma, k, logdet), one row per sample, raster and sigma. samples: keys, cell; rho: h, cell, ix, iy, rho.
    uses: by fold the rasters that its samples are met with; else all. A sample's matrix is as small as the sample."""
    return _scored_samples(samples, _rasters(rho), sigmas, jitter, keys, uses, False).drop("n")


def _normalisers(grid: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for h, isig, sigma in zip(frame["h"], frame["isig"], frame["sigma"], strict=True):
                ix, iy, rho = grid[h]
                eigen = np.maximum(np.linalg.eigvalsh(_kernel(ix, iy, rho, sigma)), 0.0)
                logs = log_elementary_symmetric(eigen, most)
                yield pd.DataFrame({"h": h, "isig": np.int32(isig), "k": np.arange(-1, most + 1, dtype=np.int32), "norm": np.append(np.log1p(eigen).sum(), logs)})

    return batches


def normalisers(spark: SparkSession, rasters: _Rasters, sigmas: Sigmas, most: int) -> DataFrame:
    """(h, isig, k, norm): ln e_k of the kernel's eigenvalues, and at k = -1 ln det(I + L). Candidates are dealt to tasks; the
    grid's size does not depend on the data."""
    grid = {h: tuple(v[~np.isnan(rho)] for v in (rasters.ix, rasters.iy, rho)) for h, rho in rasters.rho.items()}
    todo = [(h, i, s) for h in grid for i, s in enumerate(_sigmas_at(sigmas, h))]
    parts = min(len(todo), 8 * spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(todo, "h double, isig int, sigma double").repartition(max(1, parts)).mapInPandas(_normalisers(grid, most), "h double, isig int, k int, norm double")


def loglik(samples: DataFrame, rho: DataFrame, sigmas: Sigmas, conditioned: bool, jitter: float = SCORE_JITTER, keys: Sequence[str] = KEYS, uses: dict[int, list[float]] | None = None) -> DataFrame:
    """(h, isig, sigma, ll, logdet, logz) for every raster and sigma; conditioned on the sample sizes (sum over sizes of
    count * ln e_k) or not (number of samples * ln det(I + L)). uses: as of sample_logdet()."""
    rasters = _rasters(rho)
    by_size = _scored_samples(samples, rasters, sigmas, jitter, keys, uses, True).groupBy("h", "isig", "sigma", "k").agg(F.sum("logdet").alias("logdet"), F.sum("n").alias("n"))
    # a sample's size is known before its determinants
    most = samples.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    norms = normalisers(samples.sparkSession, rasters, sigmas, int(most))
    if conditioned:
        joined = by_size.join(norms, ["h", "isig", "k"])
    else:
        joined = by_size.join(norms.where("k = -1").drop("k"), ["h", "isig"])
    sums = joined.groupBy("h", "isig", "sigma").agg(F.sum("logdet").alias("logdet"), F.sum(F.col("n") * F.greatest("norm", F.lit(-690.7755278982137))).alias("logz"))
    return sums.select("h", "isig", "sigma", (F.col("logdet") - F.col("logz")).alias("ll"), "logdet", "logz")


def raster_to_rho(raster: DataFrame, nx: int, inside: DataFrame | None = None) -> DataFrame:
    """(h, cell, ix, iy, rho) with rho = sqrt of the value, on the cells of `inside` (ix, iy) where given."""
    kept = raster if inside is None else raster.join(F.broadcast(inside.select("ix", "iy")), ["ix", "iy"], "left_semi")
    return kept.select("h", (F.col("iy") * nx + F.col("ix")).alias("cell"), "ix", "iy", F.sqrt(F.greatest("value", F.lit(1e-16))).alias("rho"))


def _counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("ix", "iy").agg(F.count("*").alias("c"))


def rho_at(placed: DataFrame, nx: int, ny: int, hs: Sequence[float], mask: DataFrame | None = None) -> DataFrame:
    """Intensity of the placed points (ix, iy) at every bandwidth, as rho on the unmasked cells (mask: ix, iy, masked)."""
    raster = intensity.estimate_intensity(_counts(placed), nx, ny, hs, mask=mask)
    return raster_to_rho(raster, nx, None if mask is None else mask.where("not masked"))


def samples_of(placed: DataFrame, nx: int, keys: Sequence[str] = KEYS, mask: DataFrame | None = None) -> DataFrame:
    """(keys, cell): each pattern's distinct unmasked cells."""
    if mask is not None:
        placed = placed.join(F.broadcast(mask.where("not masked").select("ix", "iy")), ["ix", "iy"], "left_semi")
    return placed.select(*keys, (F.col("iy") * nx + F.col("ix")).alias("cell")).distinct()


def sigma_profile(placed: DataFrame, nx: int, ny: int, h: float, sigmas: Sequence[float] = SIGMAS, conditioned: bool = True, mask: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    return loglik(samples_of(placed, nx, keys, mask), rho_at(placed, nx, ny, [h], mask), sigmas, conditioned, PROFILE_JITTER, keys)


def reestimate_sigma(placed: DataFrame, nx: int, ny: int, h: float, sigmas: Sequence[float] = SIGMAS, conditioned: bool = True, mask: DataFrame | None = None, keys: Sequence[str] = KEYS) -> float:
    """The best local maximum inside the candidates, else an end, else (flat) the first greatest value."""
    return best_interior(sigma_profile(placed, nx, ny, h, sigmas, conditioned, mask, keys), "ll", "isig", ["h"]).first()["sigma"]


def evaluate_bandwidths(train: DataFrame, test: DataFrame, nx: int, ny: int, hs: Sequence[float], sigma: float, conditioned: bool = True, mask: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(h, ll) of the test patterns under intensities fitted on the training points: all bandwidths in one job."""
    return loglik(samples_of(test, nx, keys, mask), rho_at(train, nx, ny, hs, mask), [sigma], conditioned, SCORE_JITTER, keys).select("h", "ll")


def evaluate_uniform(test: DataFrame, nx: int, ny: int, sigma: float, conditioned: bool = True, mask: DataFrame | None = None, keys: Sequence[str] = KEYS) -> float:
    """Score with rho = 1 on every cell."""
    spark = test.sparkSession
    cells = spark.range(nx * ny).select(F.lit(0.0).alias("h"), F.col("id").cast("int").alias("cell"), (F.col("id") % nx).cast("int").alias("ix"), F.expr(f"cast(id div {nx} as int)").alias("iy"), F.lit(1.0).alias("rho"))
    if mask is not None:
        cells = cells.join(F.broadcast(mask.where("not masked").select("ix", "iy")), ["ix", "iy"], "left_semi")
    row = loglik(samples_of(test, nx, keys, mask), cells, [sigma], conditioned, SCORE_JITTER, keys).first()
    return row["ll"] if row else 0.0


def pilot_bandwidth(placed: DataFrame, nx: int, ny: int, hs: Sequence[float] = PILOTS, k_folds: int = 10) -> float:
    return arg_max(intensity.select_bandwidth_discrete(placed, nx, ny, hs, k_folds), "ll", "idx").first()["h"]


class _Folds:
    """Patterns dealt to folds, and what cross-validation asks of them. A raster is named by a number in place of h, so that
    one job meets the rasters of all folds."""

    def __init__(self, placed: DataFrame, nx: int, ny: int, k: int, seed: int, mask: DataFrame | None, keys: Sequence[str]):
        self.nx, self.ny, self.k, self.mask, self.keys = nx, ny, k, mask, list(keys)
        self.folded = cleaning.assign_folds(placed, "pattern_id", k, seed).persist()
        fold = self.folded.select("pattern_id", "fold").distinct()
        self.samples = samples_of(self.folded, nx, keys, mask).join(fold, "pattern_id").persist()
        counts = self.folded.groupBy("fold", "ix", "iy").agg(F.count("*").alias("c"))
        self.train = intensity.outside_of_folds(counts, k, ["ix", "iy"])

    def rho(self, wanted: list[tuple[int, float]]) -> DataFrame:
        """Rasters of the points outside each fold, as rho, for (fold, h) by their place in the list."""
        spark = self.folded.sparkSession
        named = spark.createDataFrame([(f, h, float(i)) for i, (f, h) in enumerate(wanted)], "outer int, h double, name double")
        hs = sorted({h for _, h in wanted})
        raster = intensity.estimate_intensity(self.train, self.nx, self.ny, hs, ["outer"], self.mask, wanted=named.select("outer", "h").distinct())
        inside = None if self.mask is None else self.mask.where("not masked")
        return raster_to_rho(raster.join(named, ["outer", "h"]).drop("outer", "h").withColumnRenamed("name", "h"), self.nx, inside)

    def uses(self, rasters: list[int], own: bool) -> dict[int, list[float]]:
        """By fold which rasters, of those whose folds are listed, its samples meet: its own, or all others."""
        return {g: [float(i) for i, f in enumerate(rasters) if (g == f) == own] for g in range(self.k)}

    def release(self) -> None:
        self.samples.unpersist()
        self.folded.unpersist()


def cross_validate(placed: DataFrame, nx: int, ny: int, k: int = 5, pilot: float | None = None, conditioned: bool = False, sigma: float | None = None, mask: DataFrame | None = None, coeffs: Sequence[float] = COEFFS, sigmas: Sequence[float] = SIGMAS, pilots: Sequence[float] = PILOTS, seed: int = 1, uniform: bool = False, keys: Sequence[str] = KEYS) -> dict:
    """Folds over patterns: pilot bandwidth, sigma, candidates c * h on the fold's patterns; scores summed by coefficient;
    sigma again at the chosen bandwidth. The folds are a column, so a stage is one job, whatever their number. Only
    scalars and rasters come to the driver."""
    spark, folds = placed.sparkSession, range(k)
    data = _Folds(placed, nx, ny, k, seed, mask, keys)
    try:
        chosen_h = {f: pilot for f in (*folds, -1)} if pilot else intensity.select_bandwidths(data.folded, k, nx, ny, pilots)
        if sigma is not None:
            fitted = dict.fromkeys(folds, sigma)
        else:
            first = loglik(data.samples, data.rho([(f, chosen_h[f]) for f in folds]), sigmas, True, PROFILE_JITTER, keys, data.uses(list(folds), own=False))
            fitted = {int(row["h"]): row["sigma"] for row in best_interior(first, "ll", "isig", ["h"]).collect()}
        todo = [(f, i, c * chosen_h[f]) for f in folds for i, c in enumerate(coeffs)]
        by_raster = {float(n): [fitted[f]] for n, (f, _, _) in enumerate(todo)}
        found = loglik(data.samples, data.rho([(f, h) for f, _, h in todo]), by_raster, conditioned, SCORE_JITTER, keys, data.uses([f for f, _, _ in todo], own=True))
        scores = {row["h"]: row["ll"] for row in found.collect()}
        rows = [(f, i, h, scores.get(float(n), float("-inf")), chosen_h[f], fitted[f]) for n, (f, i, h) in enumerate(todo)]
        plain = [evaluate_uniform(data.samples.where(F.col("fold") == f).select(*keys, (F.col("cell") % nx).alias("ix"), F.floor(F.col("cell") / nx).cast("int").alias("iy")), nx, ny, fitted[f], conditioned, mask, keys) for f in folds] if uniform else []
        results = spark.createDataFrame(rows, "fold int, idx int, h double, ll double, pilot double, sigma double")
        best_c = arg_max(sum_over_folds(results, "idx", "h", "ll"), "ll", "idx").first()["idx"]
        base = chosen_h[-1]
        h = coeffs[best_c] * base
        if sigma is not None:
            last = sigma
        elif coeffs[best_c] == 1.0:
            last = sum(fitted.values()) / len(fitted)
        else:
            last = reestimate_sigma(placed, nx, ny, h, sigmas, True, mask, keys)
    finally:
        data.release()
    return {"folds": results, "pilot": base, "h": h, "sigma": last, "uniform": plain}


def refine(placed: DataFrame, nx: int, ny: int, n_iter: int = 5, **options) -> DataFrame:
    """(iteration, h, sigma): cross-validation repeated from the last bandwidth. One that is chosen again is chosen ever after,
    so nothing is computed anew from there on."""
    path, pilot, settled = [], None, False
    for i in range(n_iter):
        if settled:
            path.append((i + 1, *path[-1][1:]))
            continue
        found = cross_validate(placed, nx, ny, pilot=pilot, **options)
        settled, pilot = found["h"] == pilot, found["h"]
        path.append((i + 1, float(found["h"]), float(found["sigma"])))
    return placed.sparkSession.createDataFrame(path, "iteration int, h double, sigma double")
