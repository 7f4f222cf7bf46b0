"""Exact top-k search by inner product with dual cover trees.

Vectors are dealt to blocks of bounded size around pivots. A task holds one block of candidates and one group of queries,
builds a cover tree over each, and walks both together: a pair of nodes is left out once the greatest inner product that
their covering radii allow is below the worst k-th score in the query node. The same bound, between whole groups and
whole blocks, decides beforehand which pairs of them meet at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

K = 5
#: Vectors in a block of candidates and in a group of queries, on average.
BLOCK, GROUP = 4096, 2048
#: Pivots are chosen from this many vectors (those with the smallest md5 of vec_id), and there are at most so many.
SAMPLE, PIVOTS = 4096, 256
#: A node of LEAF rows or fewer has no children, nor has one that more than FANOUT balls of half its radius have to cover:
#: that is how vectors without near neighbours look, and no bound tells their balls apart.
LEAF, FANOUT = 16, 64
#: Queries of a leaf that are scored at once.
ROWS = 512
#: Ways in which the summaries of blocks are dealt out to meet those of groups.
SPREAD = 64
NONE = np.iinfo(np.int64).min


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, dim) with v = floor(scale * x) of every component, for every row, repeated ones too.

    Rows with a null vec_id, a null vector, or null or non-finite components take no part; other columns are dropped.
    """
    scaled = F.transform("embedding", lambda e: e.cast("double") * scale)
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
        .select("vec_id", whole.alias("v"), F.size("embedding").alias("dim"))
    )


def pivots(vectors: DataFrame, wanted: int) -> dict[int, np.ndarray]:
    """By dimension, up to `wanted` far-apart vectors of a bounded sample, in farthest-first order."""
    rows = vectors.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(SAMPLE).collect()
    out = {}
    for dim in {r["dim"] for r in rows if r["dim"]}:
        x = np.array([r["v"] for r in rows if r["dim"] == dim], float)
        out[dim] = x[_far_apart(x, min(wanted, PIVOTS), 0.0)[0]]
    return out


def _far_apart(x: np.ndarray, most: int, radius: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Places of far-apart points from x[0] on, until all lie within radius of one or there are `most`; each point's
    nearest of them, and its distance."""
    chosen, nearest = [0], np.zeros(len(x), np.int64)
    away = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < most and away.max() > radius:
        at = int(away.argmax())
        other = np.linalg.norm(x - x[at], axis=1)
        closer = other < away
        nearest[closer], away[closer] = len(chosen), other[closer]
        chosen.append(at)
    return chosen, nearest, away


def in_cells(vectors: DataFrame, centres: dict[int, np.ndarray], cells: int) -> DataFrame:
    """Add cell, the nearest of the first `cells` centres of the vector's dimension (0, at the origin, without any), and
    away, the distance from it."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, away = np.zeros(len(frame), np.int32), np.zeros(len(frame))
            for dim in set(frame["dim"]):
                at = np.flatnonzero(frame["dim"] == dim)
                x = np.array([frame["v"].iloc[i] for i in at], float).reshape(len(at), dim)
                c = centres.get(dim, np.zeros((1, dim)))[:cells]
                far = np.stack([np.linalg.norm(x - one, axis=1) for one in c])
                cell[at], away[at] = far.argmin(axis=0), far.min(axis=0)
            yield frame.assign(cell=cell, away=away)

    return vectors.mapInPandas(batches, "vec_id long, v array<double>, dim int, cell int, away double")


def in_blocks(celled: DataFrame, size: int) -> DataFrame:
    """Split every cell by a hash of vec_id into blocks of about `size` vectors: a cell that holds a third of all vectors
    gives many blocks. Adds block, an array (dim, cell, part)."""
    counts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    # at most PIVOTS rows for each dimension
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return celled.join(F.broadcast(counts), ["dim", "cell"]).withColumn("block", F.array("dim", "cell", part)).drop("parts")


def summaries(blocked: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """block, centre, size (norm of the centre), radius, norm (the largest): one row per block."""
    spark = blocked.sparkSession
    listed = spark.createDataFrame(
        [(d, i, c.tolist(), float(np.linalg.norm(c))) for d, x in centres.items() for i, c in enumerate(x)], "dim int, cell int, centre array<double>, size double")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    radii = blocked.groupBy("block", "dim", "cell").agg(F.max("away").alias("radius"), F.max(norm).alias("norm"))
    return radii.join(F.broadcast(listed), ["dim", "cell"], "left").select(
        "block", "dim", F.coalesce("centre", F.expr("array_repeat(0D, dim)")).alias("centre"), F.coalesce("size", F.lit(0.0)).alias("size"), "radius", "norm")


class CoverTree:
    """Nested balls over the rows of x. Children's centres are points of their parent, the first of them the parent's own
    centre, chosen far apart until balls of half the parent's radius around them cover all its points, so the radius
    at least halves from level to level; every node keeps its actual covering radius and its largest norm."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, float, float, list[int]]] = []  # start, end, radius, largest norm, children
        self.centres: list[np.ndarray] = []
        norms = np.linalg.norm(x, axis=1)
        pending = [(0, len(x), 0, None)]
        while pending:
            start, end, centre, parent = pending.pop()
            own = self.order[start:end]
            away = np.linalg.norm(x[own] - x[centre], axis=1)
            me, radius, children = len(self.nodes), float(away.max()), []
            self.nodes.append((start, end, radius, float(norms[own].max()), children))
            self.centres.append(x[centre])
            if parent is not None:
                self.nodes[parent][4].append(me)
            if len(own) <= LEAF or radius == 0:
                continue
            own = np.concatenate([[centre], own[own != centre]])
            chosen, nearest, left = _far_apart(x[own], FANOUT, radius / 2)
            if left.max() > radius / 2:
                continue
            sort = np.argsort(nearest, kind="stable")
            self.order[start:end] = own[sort]
            bounds = start + np.searchsorted(nearest[sort], np.arange(len(chosen) + 1))
            pending += [(int(bounds[i]), int(bounds[i + 1]), int(own[c]), me) for i, c in enumerate(chosen)]


def most_alike(dot: float, apart: float, ra: float, rb: float, ca: float, cb: float, na: float, nb: float) -> float:
    """The greatest inner product that a point within ra of one centre and one within rb of another can have: by the
    radii (dot: of the centres; ca, cb: their norms), and by the largest norms na, nb and the least distance that
    centres `apart` leave, since x.y = (|x|^2 + |y|^2 - |x - y|^2) / 2. With some slack for the rounding of doubles."""
    by_radius = dot + ra * cb + rb * ca + ra * rb
    gap = max(0.0, apart - ra - rb)
    most = min(by_radius, (na * na + nb * nb - gap * gap) / 2, na * nb)
    most += 1e-9 * (ca * cb + ra * cb + rb * ca + ra * rb + na * na + nb * nb) + 1e-6
    return math.inf if math.isnan(most) else most


def _inner(x: np.ndarray, y: np.ndarray, without: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x and y, which hold whole numbers as doubles; NONE for those left out."""
    size = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if size < 2**62:
        score = (x @ y.T).astype(np.int64) if size < 2**52 else x.astype(np.int64) @ y.astype(np.int64).T
        score[without] = NONE
        return score
    whole = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) @ np.array([[int(v) for v in row] for row in y], object).reshape(y.shape).T
    whole[without] = 0
    if whole.size and max(whole.max(), -whole.min()) >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    score = whole.astype(np.int64)
    score[without] = NONE
    return score


def dual_search(
    queries: np.ndarray, query_ids: np.ndarray, worst: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, met: list[int] | None = None,
) -> Iterator[tuple[int, int, int]]:
    """(place of the query, id, score) of up to k best candidates per query that reach its worst score so far. met, if
    given, gets the number of products that the leaves computed."""
    q, c = CoverTree(queries), CoverTree(candidates)
    x, y, own, other = queries[q.order], candidates[c.order], query_ids[q.order], ids[c.order]
    best = np.full((len(x), k), NONE, np.int64)
    kept = np.zeros((len(x), k), np.int64)
    floor = worst[q.order].astype(np.int64)
    sizes = [[float(np.linalg.norm(v)) for v in tree.centres] for tree in (q, c)]

    def bound(a: int, b: int) -> float:
        (_, _, ra, na, _), (_, _, rb, nb, _) = q.nodes[a], c.nodes[b]
        one, two = q.centres[a], c.centres[b]
        return most_alike(float(one @ two), float(np.linalg.norm(one - two)), ra, rb, sizes[0][a], sizes[1][b], na, nb)

    def scan(start: int, end: int, first: int, last: int) -> None:
        score = _inner(x[start:end], y[first:last], own[start:end, None] == other[None, first:last])
        if met is not None:
            met.append(score.size)
        least = np.maximum(np.maximum(best[start:end, -1], floor[start:end]), NONE + 1)
        if last - first > k:
            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
        for i in np.flatnonzero(score.max(axis=1) >= least):
            at, hit = start + i, np.flatnonzero(score[i] >= least[i])
            scores, found = np.append(best[at], score[i, hit]), np.append(kept[at], other[first:last][hit])
            top = np.lexsort((found, ~scores))[:k]  # ~ turns the order round and never overflows
            best[at], kept[at] = scores[top], found[top]

    pending = [(bound(0, 0), 0, 0)]
    while pending:
        most, a, b = pending.pop()
        start, end, ra, _, below = q.nodes[a]
        if most < np.maximum(best[start:end, -1], floor[start:end]).min():
            continue
        first, last, rb, _, under = c.nodes[b]
        if not below and not under:
            for row in range(start, end, ROWS):
                scan(row, min(row + ROWS, end), first, last)
        elif below and (ra >= rb or not under):
            pending += sorted((bound(n, b), n, b) for n in below)
        else:
            pending += sorted((bound(a, n), a, n) for n in under)
    for place, scores, found in zip(q.order.tolist(), best.tolist(), kept.tolist(), strict=True):
        for s, i in zip(scores, found, strict=True):
            if s != NONE:
                yield place, i, s


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.to_list(), float).reshape(len(rows), -1)


def _search(k: int):
    def both(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = queries["vec_id"].to_numpy()
        worst = queries["worst"].to_numpy()
        found = dual_search(_matrix(queries["v"]), ids, worst, _matrix(candidates["v"]), candidates["vec_id"].to_numpy(), k)
        return pd.DataFrame([(ids[p], i, s) for p, i, s in found], columns=["query_id", "vec_id", "score"]).astype("int64")

    return both


def _meet(pairs: DataFrame, candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Search the pairs (block, group): each is one task's work on one block and one group."""
    left = candidates.select("block", "vec_id", "v").join(pairs.select("block", "group"), "block")
    right = queries.select("group", "vec_id", "v", "worst").join(pairs.select("block", "group"), "group")
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(_search(k), "query_id long, vec_id long, score long")


def _most(b: str, g: str) -> Column:
    """most_alike() of whole blocks and groups."""
    col = lambda side, name: F.col(f"{side}.{name}")
    added = lambda f: F.aggregate(F.zip_with(col(b, "centre"), col(g, "centre"), f), F.lit(0.0), lambda a, x: a + x)
    rb, rg, sb, sg, nb, ng = (col(side, name) for name in ("radius", "size", "norm") for side in (b, g))
    across = rb * sg + rg * sb + rb * rg
    gap = F.greatest(F.lit(0.0), F.sqrt(added(lambda p, q: (p - q) * (p - q))) - rb - rg)
    squares = nb * nb + ng * ng
    most = F.least(added(lambda p, q: p * q) + across, (squares - gap * gap) / 2, nb * ng) + 1e-9 * (sb * sg + across + squares) + 1
    return F.when(F.isnan(most), F.lit(float("inf"))).otherwise(most)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For each query its k best vectors by inner product: query_id, rank (from 1), vec_id, score; ties to the smaller
    vec_id; all, if there are fewer; a query's own vec_id is never among them.

    vectors and queries hold (vec_id, v, dim) as quantised() gives them; only vectors of a query's own dimension have a
    score. Every row is a candidate of its own, also one that repeats a vec_id or a whole row; queries that share a vec_id
    share one result, and those that share the vector too are one query. Scores are exact; one that does not fit 64 bits
    ends the job. Empty tables give an empty result.
    """
    vectors, queries = cut(vectors, "vectors"), cut(queries.dropDuplicates(["vec_id", "v"]), "queries")
    n, m = vectors.count(), queries.count()
    centres = pivots(vectors, max(1, -(-n // BLOCK)))
    blocked = cut(in_blocks(in_cells(vectors, centres, PIVOTS), BLOCK), "blocks")
    grouped = cut(in_blocks(in_cells(queries, centres, max(1, min(PIVOTS, m // GROUP))), GROUP).withColumnRenamed("block", "group"), "groups")
    # one row for each block and group of the same dimension; neither side gathers in one task
    b = summaries(blocked, centres).withColumn("way", F.pmod(F.xxhash64("block"), F.lit(SPREAD)).cast("int")).alias("b")
    g = summaries(grouped.withColumnRenamed("group", "block"), centres).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).alias("g")
    pairs = b.join(g, (F.col("b.dim") == F.col("g.dim")) & (F.col("b.way") == F.col("g.way")))
    pairs = cut(pairs.select(F.col("b.block").alias("block"), F.col("g.block").alias("group"), _most("b", "g").alias("most")), "pairs")
    best = pairs.groupBy("group").agg(F.max(F.struct("most", "block")).alias("first")).select("group", "first.block")
    first = cut(best, "first")
    seeds = cut(_meet(first, blocked, grouped.withColumn("worst", F.lit(int(NONE))), k), "seeds")
    kth = seeds.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).select(F.col("query_id").alias("vec_id"), F.when(F.col("c") >= k, F.col("s")).alias("s"))
    bounded = cut(grouped.join(kth, "vec_id", "left").withColumn("worst", F.coalesce("s", F.lit(int(NONE)))).drop("s"), "bounded")
    least = bounded.groupBy("group").agg(F.min("worst").alias("least"))
    rest = pairs.join(first, ["block", "group"], "left_anti").join(least, "group").where("most >= least")
    found = seeds.unionByName(_meet(rest, blocked, bounded, k))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
