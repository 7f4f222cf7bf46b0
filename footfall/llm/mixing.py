"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table predicts each document's domain posteriors; distributed projected-gradient least
squares then fits a nonnegative rate for every document so that the expected tokens of each domain match the targets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, small_batches
from .hashing import word_hashes

BITS = 16
DIM = 1 << BITS
#: At most this many labelled rows are fitted on: those with the smallest md5 of their doc_id.
FIT_ROWS = 8_000
#: Posteriors are those of the mean log-likelihood of a word times this, so that long texts stay soft.
SHARPNESS = 12.0
ITERATIONS = 40
#: Weight of staying near a rate of 1 against matching the targets.
RIDGE = 1e-4
#: The fit has met the targets once no domain misses its own by more than this share of it.
TOLERANCE = 1e-4
#: A domain with less than this share of the corpus's expected tokens can't be mixed in: it is left out of the fit. No document's
#: rate exceeds MOST.
FLOOR, MOST = 1e-3, 64.0
#: Target shares of the tokens by domain.
TARGETS = {"en": 0.50, "fr": 0.18, "de": 0.16, "es": 0.16}


def _classes(texts: Sequence[object]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, class of the word) of every word of the texts, in order."""
    place, hashed = word_hashes(texts)
    return place, (hashed >> np.uint64(64 - BITS)).astype(np.int64)


def fit_classifier(labelled: DataFrame, domains: Sequence[str], max_rows: int = FIT_ROWS) -> np.ndarray:
    """Log-probabilities of hashed words by domain (rows) from labelled rows (doc_id, text, domain), at most max_rows of
    them by md5 of doc_id. Each task counts its own words; the sums that come to the driver are bounded by DIM times the
    number of domains. Rows with other domains or null text take no part; without rows all domains are alike."""
    small_batches(labelled.sparkSession)
    sample = labelled.where(F.col("domain").isin(*domains) & F.col("text").isNotNull()).orderBy(F.md5(F.col("doc_id").cast("string")), F.md5("text")).limit(max_rows)
    place = {d: i for i, d in enumerate(domains)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(place) * DIM, np.int64)
        for frame in frames:
            at, word = _classes(frame["text"])
            sums += np.bincount(word + frame["domain"].map(place).to_numpy()[at] * DIM, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"at": at, "n": sums[at]})

    totals = sample.select("text", "domain").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(place) * DIM)
    counts[totals["at"].to_numpy()] = totals["n"].to_numpy()
    counts = counts.reshape(len(place), DIM) + 0.1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _memberships(sent) -> Callable[[Column], Column]:
    """n_tokens and the posterior by domain of a text, as one list of doubles."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logs = sent.value
        for part in texts:
            at, word = _classes(part)
            n = np.bincount(at, minlength=len(part))
            mean = np.stack([np.bincount(at, by_word[word], len(part)) for by_word in logs], axis=1) / np.maximum(n, 1)[:, None]
            p = np.exp(SHARPNESS * (mean - mean.max(axis=1, keepdims=True)))
            rows = np.column_stack([n, p / p.sum(axis=1, keepdims=True)])
            yield pd.Series(list(rows), index=part.index, dtype=object)

    # not to be run again for each place that names its result
    return F.pandas_udf(batches, "array<double>").asNondeterministic()


class Names(NamedTuple):
    """Columns that hold n_tokens and the posterior of each domain beside a table's own columns."""

    n_tokens: str
    p: list[str]


def posteriors(docs: DataFrame, model: np.ndarray) -> tuple[DataFrame, Names]:
    """docs with n_tokens (words of the whole text) and one posterior for each domain (all alike for a text without
    words), under names that docs does not use, and these names. Only the text goes to Python."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    both = free_name(docs, "membership")
    names = Names(free_name(docs, "n_tokens"), [free_name(docs, f"p_{i}") for i in range(len(model))])
    found = docs.withColumn(both, _memberships(sent)(F.col("text")))
    parts = {names.n_tokens: F.col(both)[0].cast("long")} | {c: F.col(both)[i + 1] for i, c in enumerate(names.p)}
    return found.withColumns(parts).drop(both), names


class Steps(NamedTuple):
    """What leads from a document's posteriors to its rate: (momentum, direction) of each step, and the bounds of rates."""

    history: list[tuple[float, np.ndarray]]
    least: float
    most: float


def _rates(p: np.ndarray, tokens: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """Every document's rate, and the extrapolated point, after the steps taken so far. Distances between rates are
    weighted by tokens, so a step moves long and short documents of one membership alike; those without tokens stay at
    1. A step is r <- y - step * gradient from the extrapolated point y, brought back into the bounds; it depends on the
    document's own row and the shared direction of each step only, so the directions are all that has to be sent."""
    rate = point = np.ones(len(tokens))
    for momentum, direction in steps.history:
        moved = np.clip(point - p @ direction[:-1] - direction[-1] * (point - 1), steps.least, steps.most)
        moved = np.where(tokens > 0, moved, 1.0)
        point = moved + momentum * (moved - rate)
        rate = moved
    return rate, point


def _totals(steps: Steps) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each task's sums over its documents of expected tokens by domain: at the extrapolated point, and as rated."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for frame in frames:
            if len(frame):
                p, tokens = frame.iloc[:, 1:].to_numpy(), frame.iloc[:, 0].to_numpy()
                rate, point = _rates(p, tokens, steps)
                total = total + np.concatenate([(point * tokens) @ p, (rate * tokens) @ p])
        if not isinstance(total, float):
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    return batches


def fit_rates(members: DataFrame, targets: Sequence[float], iterations: int = ITERATIONS, least: float = 0.0, most: float = MOST) -> tuple[Steps, list[bool], float]:
    """Projected-gradient steps (with momentum) for the least-squares problem over rates least <= r <= most

        sum_k w_k (sum_d p_dk t_d r_d - target_k)^2 + RIDGE * sum_d t_d (r_d - 1)^2

    members: t_d, a document's share of all tokens, then p_d1, p_d2, ...; targets are shares of the final total, which is
    set so that no domain has to shrink: max_k(own share / target share). With least = 1 no document may shrink either,
    and copies of one domain's documents carry some of the others, so the total is raised until rates
    1 + sum_j c_j p_dj with c >= 0 meet all targets, where memberships overlap so little that there are such. w_k evens
    out domains of unlike size. Domains below FLOOR weigh nothing, and the targets of the others are scaled to 1. A step
    costs one pass over the small table of posteriors and one sum per domain; only these sums reach the driver. Returns
    the steps, whether each domain took part, and the largest relative miss of a target by the rates of the last step.
    """
    k = len(targets)
    share, *p = (F.col(f"`{c}`") for c in members.columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    stats = members.agg(
        *[F.sum(p[i] * share).alias(f"m{i}") for i in range(k)],
        *[F.sum(p[i] * p[j] * share).alias(f"q{i}_{j}") for i, j in pairs],
    ).first()
    own = np.array([stats[f"m{i}"] or 0.0 for i in range(k)])
    both = np.zeros((k, k))
    for i, j in pairs:
        both[i, j] = both[j, i] = stats[f"q{i}_{j}"] or 0.0
    wanted = np.asarray(targets, float)
    there = (own >= FLOOR) & (wanted > 0)
    if not there.any():
        return Steps([], least, most), there.tolist(), 0.0
    wanted = np.where(there, wanted, 0.0) / wanted[there].sum()
    total = float((own[there] / wanted[there]).max())
    if least >= 1:
        # rates 1 + p @ c reach own + c @ both, and own is ones @ both
        reach = np.linalg.lstsq(both[np.ix_(there, there)], wanted[there], rcond=None)[0]
        if reach.min() > 1 / most:
            total = max(total, float(1 / reach.min()))
    weight = np.where(there, 1 / np.maximum(np.diag(both), FLOOR**2), 0.0)
    # the scaled system has one unit of curvature for each domain, and as many at most where domains overlap
    step, history, t, miss = 1.0 / k, [], 1.0, np.inf
    for _ in range(iterations + 1):
        parts = members.mapInPandas(_totals(Steps(history, least, most)), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        reached = np.zeros(2 * k)
        for row in parts:
            reached[row["k"]] = row["v"]
        miss = float(np.abs(reached[k:][there] / (total * wanted[there]) - 1).max())
        if miss < TOLERANCE or len(history) == iterations:
            break
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        history.append((float((t - 1) / following), np.append(step * weight * (reached[:k] - total * wanted), step * RIDGE)))
        t = following
    return Steps(history, least, most), there.tolist(), miss


class Mixture(NamedTuple):
    """A fitted mixture: the written table of the documents' kept columns, tokens and posteriors, the names of these, the
    tokens of the corpus, the steps that lead to every document's rate, the domains with too few tokens to take part,
    and by how much of itself the worst target of the others is missed (TOLERANCE or less unless rates are at their bounds)."""

    members: DataFrame
    names: Names
    tokens: int
    steps: Steps
    unreachable: list[str]
    miss: float


def fit(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, iterations: int = ITERATIONS, least: float = 0.0, keep: Sequence[str] = ("doc_id",),
) -> Mixture:
    """Classifier from labelled (doc_id, text, domain), rates of least or more from all of docs; with least = 1 every
    document stays. Every text is read once; keep lists the columns of docs that the written table carries."""
    targets = targets or TARGETS
    model = fit_classifier(labelled, list(targets))
    whole, names = posteriors(docs.select(*dict.fromkeys([*keep, "text"])), model)
    members = cut(whole.select(*keep, names.n_tokens, *names.p), "posteriors")
    tokens = members.agg(F.sum(names.n_tokens)).first()[0] or 0
    shares = members.select((F.col(names.n_tokens) / F.lit(float(max(tokens, 1)))).alias("share"), *names.p)
    steps, there, miss = fit_rates(shares, list(targets.values()), iterations, least)
    return Mixture(members, names, tokens, steps, [d for d, x in zip(targets, there, strict=True) if not x], miss)


def _with_copies(mixture: Mixture, rate: str, copies: str) -> DataFrame:
    tokens, steps = float(max(mixture.tokens, 1)), mixture.steps

    def batches(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for n_tokens, *p in parts:
            yield pd.Series(_rates(np.stack(p, axis=1), n_tokens.to_numpy() / tokens, steps)[0])

    rated_by = F.pandas_udf(batches, "double").asNondeterministic()
    found = mixture.members.withColumn(rate, rated_by(mixture.names.n_tokens, *mixture.names.p))
    turn = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1_000_000)) / 1e6
    whole = F.floor(rate)
    return found.withColumn(copies, (whole + (turn < F.col(rate) - whole).cast("long")).cast("int"))


def rated(mixture: Mixture) -> DataFrame:
    """One row per document of the mixture: doc_id, n_tokens, p (posterior by domain), rate (fitted, between the mixture's
    bounds) and copies, the rate rounded to a whole number by the hash of doc_id, so that copies have the rate as their mean.

    A text that is null or has no word weighs nothing and keeps the rate 1. Repeated rows are rated alike; an empty
    table gives an empty result. No shuffle: a rate depends on the row and the mixture.
    """
    found = _with_copies(mixture, free_name(mixture.members, "rate"), free_name(mixture.members, "copies"))
    *_, rate, copies = found.columns
    return found.select(
        "doc_id", F.col(mixture.names.n_tokens).alias("n_tokens"), F.array(*mixture.names.p).alias("p"), F.col(rate).alias("rate"), F.col(copies).alias("copies"))


def repeated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """docs with every row as often as its copies say, with exactly the columns of docs, whatever their names."""
    mixture = fit(docs, labelled, targets, least=least, keep=docs.columns)
    copies = free_name(mixture.members, "copies")
    found = _with_copies(mixture, free_name(mixture.members, "rate"), copies).where(F.col(copies) > 0)
    return found.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)
