"""Descriptive statistics and the validation metrics that compare several sets of patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import occupancy_class
from . import pairs, quantiles, ranges
from .cleaning import one_row_per_snapshot, with_size

KEYS = pairs.KEYS
INF = float("inf")


def snapshot_occupancy(df: DataFrame, time: str, ident: str) -> DataFrame:
    """Distinct people of every snapshot."""
    return df.groupBy(time).agg(F.countDistinct(ident).alias("occupancy"))


def fraction_standing(df: DataFrame, time: str) -> DataFrame:
    return df.groupBy(time).agg(F.avg(F.when(F.col("stand_or_walk") == 0, 1.0).otherwise(0.0)).alias("frac_standing"))


def occupancy_summary(df: DataFrame, time: str, limit: int) -> DataFrame:
    """Mode (the smallest of equals), mean, median, sample sd and number of snapshots up to an occupancy limit."""
    one = one_row_per_snapshot(df, time, ["occupancy"]).where(F.col("occupancy") <= limit)
    return one.agg(
        F.mode("occupancy", True).alias("mode"), F.avg("occupancy").alias("mean"), F.percentile("occupancy", F.lit(0.5)).alias("median"),
        F.stddev_samp("occupancy").alias("sd"), F.count("*").alias("n_snapshots"))


def occupancy_histogram(df: DataFrame, time: str, limit: int, bins: int = 100) -> DataFrame:
    """Snapshots by equal-width bins of occupancy; the last bin holds its right edge."""
    one = one_row_per_snapshot(df, time, ["occupancy"]).where(F.col("occupancy") <= limit)
    ends = one.agg(F.min("occupancy").cast("double").alias("lo"), F.max("occupancy").cast("double").alias("hi"))
    at = F.floor((F.col("occupancy") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return one.crossJoin(F.broadcast(ends)).select(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def hexbins(df: DataFrame, x: str, y: str, gridsize: int, xlim: tuple[float, float], ylim: tuple[float, float]) -> DataFrame:
    """Hexagonal bin counts: two rectangular lattices, one shifted by half a cell; the nearer centre wins. Returns the
    centres cx, cy (in data units) and n."""
    ny = int(gridsize / 3**0.5)
    sx, sy = (xlim[1] - xlim[0]) / gridsize, (ylim[1] - ylim[0]) / ny
    u, v = (F.col(x) - xlim[0]) / sx, (F.col(y) - ylim[0]) / sy
    whole = (F.floor(u + 0.5), F.floor(v + 0.5))
    half = (F.floor(u) + 0.5, F.floor(v) + 0.5)
    away = lambda c: (u - c[0]) * (u - c[0]) + 3 * (v - c[1]) * (v - c[1])
    first = away(whole) < away(half)
    centre = [F.when(first, a.cast("double")).otherwise(b) for a, b in zip(whole, half, strict=True)]
    return df.groupBy((centre[0] * sx + xlim[0]).alias("cx"), (centre[1] * sy + ylim[0]).alias("cy")).agg(F.count("*").alias("n"))


def common_levels(df: DataFrame, n_sources: int, min_reps: int, level: str = "n") -> DataFrame:
    """Levels that hold min_reps rows or more in each of the sources."""
    per = df.groupBy(level, "source").agg(F.count("*").alias("c"))
    return per.groupBy(level).agg(F.count("*").alias("s"), F.min("c").alias("least")).where((F.col("s") == n_sources) & (F.col("least") >= min_reps)).select(level)


def nn_by_occupancy(points: DataFrame, k: int = 1, min_reps: int = 5, units_per_m: float = 1000, n_sources: int = 2, distances: DataFrame | None = None) -> DataFrame:
    """Mean k-NN distance per pattern, then mean and standard error over the patterns of equal size in each source, for
    sizes with min_reps patterns or more in every source. One pattern alone has no standard error (null)."""
    near = distances if distances is not None else pairs.knn_distance(points, k)
    # every point of a pattern of more than k points has a k-th neighbour, so the mean's own count is the pattern's size
    per = near.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.avg("d") / units_per_m).alias("nn"))
    kept = per.join(common_levels(per, n_sources, min_reps), "n", "left_semi")
    return kept.groupBy("n", "source").agg(F.avg("nn").alias("mean"), (F.stddev_samp("nn") / F.sqrt(F.count("*").cast("double"))).alias("se"))


def _by_class(near: DataFrame, units_per_m: float, breaks: tuple[int, int]) -> DataFrame:
    """(source, occupancy, d) in metres; near holds every point of its patterns."""
    sized = with_size(near, KEYS)
    return sized.select("source", occupancy_class(F.col("n"), breaks).alias("occupancy"), (F.col("d") / units_per_m).alias("d"))


def nn_distance_density(near: DataFrame, breaks: Sequence[float], units_per_m: float = 1000, occupancy_breaks: tuple[int, int] = (30, 60)) -> DataFrame:
    """Histogram density of k-NN distances by source and class. Bins are right-closed, the first closed on both sides;
    distances outside are dropped before normalising; classes without any are absent, empty bins are 0."""
    edges = F.array(*[F.lit(float(b)) for b in breaks])
    inside = _by_class(near, units_per_m, occupancy_breaks).where(F.col("d").between(float(breaks[0]), float(breaks[-1])))
    at = pairs.first_radius(F.col("d"), [float(b) for b in breaks[1:]])
    counts = inside.groupBy("source", "occupancy", at.alias("bin")).agg(F.count("*").alias("c"))
    totals = counts.groupBy("source", "occupancy").agg(F.sum("c").alias("total"))
    dense = totals.select("source", "occupancy", "total", F.explode(F.sequence(F.lit(0), F.lit(len(breaks) - 2))).alias("bin"))
    low, high = F.element_at(edges, F.col("bin") + 1), F.element_at(edges, F.col("bin") + 2)
    return dense.join(counts, ["source", "occupancy", "bin"], "left").select(
        "source", "occupancy", ((low + high) / 2).alias("r"), (F.coalesce("c", F.lit(0)) / (F.col("total") * (high - low))).alias("density"))


def nn_distance_kde(near: DataFrame, span: tuple[float, float], adjust: dict[str, float] | float = 1.0, n: int = 512, units_per_m: float = 1000, occupancy_breaks: tuple[int, int] = (30, 60)) -> DataFrame:
    """Gaussian density of k-NN distances by source and class at n points of span. The bandwidth is 1.06 * min(sd,
    IQR / 1.34) * m^-0.2 times adjust (sd alone if the IQR is 0); classes with one distinct distance are absent.

    Distances are counted by value first: on a lattice few remain. Quartiles are exact and gather no class in one place, so
    near is read a few times: store it first."""
    inside = _by_class(near, units_per_m, occupancy_breaks).where(F.col("d").between(*map(float, span)))
    values = inside.groupBy("source", "occupancy", "d").agg(F.count("*").alias("c"))
    quartiles = quantiles.exact_quantiles(inside, "d", [0.25, 0.75], ["source", "occupancy"])
    m = F.sum("c").cast("double")
    spread = values.groupBy("source", "occupancy").agg(
        m.alias("m"), F.sum(F.col("c") * F.col("d")).alias("s1"), F.sum(F.col("c") * F.col("d") * F.col("d")).alias("s2"),
        F.count("*").alias("distinct")).where("distinct > 1").join(quartiles, ["source", "occupancy"]).withColumn("iqr", (F.col("q1") - F.col("q0")) / 1.34)
    sd = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("m")) / (F.col("m") - 1))
    factor = F.lit(float(adjust)) if not isinstance(adjust, dict) else F.coalesce(*[F.when(F.col("occupancy") == k, F.lit(float(v))) for k, v in adjust.items()])
    width = spread.select("source", "occupancy", "m", (1.06 * F.when(F.col("iqr") > 0, F.least(sd, F.col("iqr"))).otherwise(sd) * F.pow("m", F.lit(-0.2)) * factor).alias("h"))
    step = (span[1] - span[0]) / (n - 1)
    at = width.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("r", F.lit(float(span[0])) + F.col("i") * step)
    u = (F.col("r") - F.col("d")) / F.col("h")
    return at.join(values, ["source", "occupancy"]).groupBy("source", "occupancy", "i", "r").agg(
        F.sum(F.col("c") * F.exp(-0.5 * u * u) / (F.col("m") * F.col("h") * 2.5066282746310002)).alias("density")).drop("i")


def log_spaced(low: float, high: float, n: int) -> list[float]:
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def radius_profile(points: DataFrame, radii: Sequence[float], units_per_m: float = 1000, weight: str | None = None) -> DataFrame:
    """What ball counts and L-functions share: ranges.range_profile() at radii in metres, with column r in metres too."""
    rs = sorted(r * units_per_m for r in set(map(float, radii)))
    listed = F.get(F.array(*[F.lit(r / units_per_m) for r in rs]), F.col("ir"))
    return ranges.range_profile(points, rs, KEYS, weight).withColumn("r", listed)


def _at_radii(profile: DataFrame, radii: Sequence[float], units_per_m: float) -> DataFrame:
    """The rows of a profile at some of its radii: an array lookup of a list fixed by the caller."""
    return profile.where(F.col("r").isin([float(r) * units_per_m / units_per_m for r in radii]))


def _count_stats() -> tuple[Column, Column]:
    """Mean and standard error of counts from their number, sum and sum of squares, which are whole numbers."""
    n, one, two = (F.sum(c).cast("decimal(38,0)") for c in ("n", "c1", "c2"))
    scale = n.cast("double")
    spread = (n * two - one * one).cast("double") / scale / F.nullif(scale - 1, F.lit(0.0))
    return one.cast("double") / scale, F.sqrt(spread) / F.sqrt(scale)


def ball_count(points: DataFrame | None, radii: Sequence[float], by_occupancy: bool = False, units_per_m: float = 1000, occupancy_breaks: tuple[int, int] = (30, 60), profile: DataFrame | None = None) -> DataFrame:
    """Mean number of other points within r of a point, and its standard error, over all points of all patterns, or by
    class. Sums and squared sums by pattern are all that meets. profile: of radius_profile(), in place of points."""
    found = profile if profile is not None else radius_profile(points, radii, units_per_m)
    group = occupancy_class(F.col("n"), occupancy_breaks) if by_occupancy else F.lit("all")
    mean, se = _count_stats()
    return _at_radii(found, radii, units_per_m).groupBy("source", group.alias("occupancy"), "r").agg(mean.alias("mean"), se.alias("se"))


def ball_counts(profile: DataFrame, radii: Sequence[float], units_per_m: float = 1000, occupancy_breaks: tuple[int, int] = (30, 60)) -> DataFrame:
    """ball_count() over all points and by class from one profile: occupancy is `all` or a class."""
    rows = _at_radii(profile, radii, units_per_m).withColumn("class", occupancy_class(F.col("n"), occupancy_breaks))
    mean, se = _count_stats()
    sets = rows.groupingSets([["source", "r"], ["source", "r", "class"]], "source", "r", "class").agg(mean.alias("mean"), se.alias("se"))
    return sets.select("source", F.coalesce("class", F.lit("all")).alias("occupancy"), "r", "mean", "se")


def average_l(points: DataFrame | None, radii: Sequence[float], area: float, units_per_m: float = 1000, weight: str | None = None, profile: DataFrame | None = None) -> DataFrame:
    """L-function without edge correction, averaged over the patterns of a source, in metres.

    Without weight: K = area / (n (n - 1)) * ordered pairs within r. With weight, a column of 1 / intensity at each point:
    K = (1 / area) * sum of w_i w_j over pairs, times area / sum_i w_i per pattern. Patterns of fewer than two points have
    no L and are left out. profile: of radius_profile(), with the weight where one is given, in place of points.
    """
    found = profile if profile is not None else radius_profile(points, radii, units_per_m, weight)
    k = F.lit(area) / F.col("w") / F.lit(area) * F.col("v") if weight else F.lit(area) / (F.col("n") * (F.col("n") - 1)) * F.col("c1")
    rows = _at_radii(found, radii, units_per_m).where("n > 1")
    return rows.groupBy("source", "r").agg((F.avg(F.sqrt(k / 3.141592653589793)) / units_per_m).alias("L"))


def cv_summary(results: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population sd of fold estimates."""
    return results.agg(*[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def sum_over_folds(scores: DataFrame, candidate: str, value: str, score: str) -> DataFrame:
    """Score of every candidate summed over folds, its value averaged over them."""
    return scores.groupBy(candidate).agg(F.sum(score).alias(score), F.avg(value).alias(value))


def confidence_band(df: DataFrame, mean: str = "mean", se: str = "se") -> DataFrame:
    return df.withColumn("lower", F.col(mean) - 1.96 * F.col(se)).withColumn("upper", F.col(mean) + 1.96 * F.col(se))


def clip_at_percentile(raster: DataFrame, column: str, percent: float = 99.0) -> DataFrame:
    """Cells above a percentile (linear between ranks) are set to it."""
    top = quantiles.exact_quantiles(raster, column, [percent / 100]).select(F.col("q0").alias("__top"))
    return raster.crossJoin(F.broadcast(top)).withColumn(column, F.least(column, "__top")).drop("__top")


def power_law_refs(radii: DataFrame, laws: Sequence[tuple[float, float]]) -> DataFrame:
    """Reference lines coef * r^power for every r."""
    listed = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("coef"), F.lit(float(p)).alias("power")) for c, p in laws]))
    return radii.select("r", listed.alias("law")).select("r", "law.coef", "law.power", (F.col("law.coef") * F.pow("r", F.col("law.power"))).alias("value"))


def zoom(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns lie inside closed bounds."""
    for c, (low, high) in bounds.items():
        df = df.where(F.col(c).between(low, high))
    return df


def by_class(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("occupancy") == name)


def for_log_axis(df: DataFrame, r: str = "r") -> DataFrame:
    return df.where(F.col(r) > 0)


def validation_metrics(points: DataFrame, area: float, weight: str | None = None, units_per_m: float = 1000, lattice: bool = False, nn_max: tuple[float, float] = (5.0, 6.0), min_reps: int = 5, n_sources: int = 2, store: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The bundle: NN by occupancy and NN density for k = 1, 2, ball counts over all and by class, L hom. and inhom.

    lattice: smoothed densities and coarser L radii, for patterns on a grid. All neighbour distances come from one search,
    and ball counts and L-functions from one profile of the pairs. store(df, name) writes these two and reads them again,
    so that every metric shares them.
    """
    radii = [round(0.05 * i, 10) for i in range(51)] if lattice else [round(0.01 * i, 10) for i in range(301)]
    balls = log_spaced(0.5, 50.0, 50)
    store = store or (lambda df, name: df)
    nearest = store(pairs.knn_distances(points, (1, 2)), "nearest")
    profile = store(radius_profile(points, [*radii, *balls], units_per_m, weight), "profile")
    out = {}
    for k, most in zip((1, 2), nn_max, strict=True):
        near = nearest.where(F.col("k") == k).drop("k")
        out[f"nn{k}_by_occupancy"] = nn_by_occupancy(points, k, min_reps, units_per_m, n_sources, near)
        if lattice:
            out[f"nn{k}_density"] = nn_distance_kde(near, (0.0, most), {"low": 1.5, "med": 1.5, "high": 2.25}, units_per_m=units_per_m)
        else:
            out[f"nn{k}_density"] = nn_distance_density(near, [most * i / 99 for i in range(100)], units_per_m)
    both = ball_counts(profile, balls, units_per_m)
    out["ball_count"] = both.where("occupancy = 'all'")
    out["ball_count_occ"] = both.where("occupancy <> 'all'")
    curves = average_l(None, radii, area, units_per_m, profile=profile).withColumn("correction", F.lit("hom."))
    if weight:
        curves = curves.unionByName(average_l(None, radii, area, units_per_m, weight, profile).withColumn("correction", F.lit("inhom.")))
    out["L"] = curves
    return out


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > -INF) & (c < INF)
