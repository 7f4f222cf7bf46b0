"""Exact quantiles of any number of values, found by narrowing the interval that holds each wanted rank."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group, or an interval, of so many values or fewer is sorted at once.
LIMIT = 16_384
#: A sketch's ranks are off by 1 / ACCURACY of its values; so many shares are asked of it at most.
ACCURACY, SHARES = 4096, 256
#: A list from the driver of so many rows or fewer goes to every task; a longer one is joined as Spark decides.
BROADCAST_ROWS = 100_000


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def _shares(wanted: list[float]) -> list[float]:
    """Shares to ask of a sketch: those on both sides of each wanted one or, for many, evenly spaced ones."""
    if len(wanted) * 2 > SHARES:
        return [i / SHARES for i in range(SHARES + 1)]
    return sorted({min(max(p + side * 2 / ACCURACY, 0.0), 1.0) for p in wanted for side in (-1, 1)})


def _at_ranks(rows: DataFrame, wanted: Sequence[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The value at each (group g, rank from 0) of rows (g, v), all of whose values are numbers.

    A rank lies in an open interval, `below` values before it. A sketch of the interval's values gives two of them around
    the rank; values below, equal to, between and above the two are counted exactly, and the rank is one of the two or goes
    on in a part without them. So an interval always shrinks, mostly about a thousandfold, and a bad sketch costs rounds only.
    """
    spark = rows.sparkSession
    found: dict[tuple[int, int], float] = {}
    held = {key: (None, None, 0) for key in wanted}  # (lo, hi, below)
    inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    while held:
        spans = {span: i for i, span in enumerate(sorted({(g, lo, hi) for (g, _), (lo, hi, _) in held.items()}, key=str))}
        table = _listed(spark, [(i, *span) for span, i in spans.items()], "s int, g int, lo double, hi double")
        within = rows.join(table, "g").where(inside)
        sizes = {r["s"]: r["n"] for r in within.groupBy("s").agg(F.count("*").alias("n")).collect()}
        place = {key: spans[key[0], lo, hi] for key, (lo, hi, _) in held.items()}
        few = {key for key in held if sizes[place[key]] <= LIMIT}
        if few:
            ranks = _listed(spark, [(place[key], *key, key[1] - held[key][2]) for key in few], "s int, g int, rank long, at long")
            values = within.join(ranks.select("s"), "s", "left_semi").groupBy("s").agg(F.sort_array(F.collect_list("v")).alias("vs"))
            found |= {(r["g"], r["rank"]): r["v"] for r in values.join(ranks, "s").select("g", "rank", F.get("vs", F.col("at").cast("int")).alias("v")).collect()}
            held = {key: span for key, span in held.items() if key not in few}
        if not held:
            break
        share = {key: (key[1] - held[key][2] + 0.5) / sizes[place[key]] for key in held}
        asked = _shares(list(share.values()))
        still = _listed(spark, [(s,) for s in {place[key] for key in held}], "s int")
        sketch = within.join(still, "s", "left_semi").groupBy("s").agg(F.percentile_approx("v", asked, ACCURACY).alias("at"))
        told = {r["s"]: r["at"] for r in sketch.collect()}
        cuts = []
        for (g, rank), (lo, hi, _) in held.items():
            at, p = told[place[g, rank]], share[g, rank]
            low = max((i for i, a in enumerate(asked) if a <= p - 1 / ACCURACY), default=0)
            high = min((i for i, a in enumerate(asked) if a >= p + 1 / ACCURACY), default=len(asked) - 1)
            cuts.append((g, rank, lo, hi, at[low], at[high]))
        # ranks side by side mostly share their cuts, so each cut is counted once
        cut = {c: i for i, c in enumerate(dict.fromkeys((g, *rest) for g, _, *rest in cuts))}
        marks = _listed(spark, [(i, *c) for c, i in cut.items()], "c int, g int, lo double, hi double, a double, b double")
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        counts = rows.join(marks, "g").where(inside).groupBy("c").agg(
            *[F.count_if(test).alias(name) for name, test in (("lt", v < a), ("at_a", v == a), ("mid", (v > a) & (v < b)), ("at_b", (v == b) & (a < b)))])
        counted = {r["c"]: r for r in counts.collect()}
        for g, rank, lo, hi, first, second in cuts:
            row, left = counted[cut[g, lo, hi, first, second]], held.pop((g, rank))[2]
            for name, value, span in (("lt", None, (lo, first)), ("at_a", first, None), ("mid", None, (first, second)), ("at_b", second, None), (None, None, (second, hi))):
                if name is None or rank < left + row[name]:
                    if span is None:
                        found[g, rank] = value
                    else:
                        held[g, rank] = (*span, left)
                    break
                left += row[name]
    return found


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, q0, q1, ...): the quantiles of a column at the given shares (0 to 1), linear between ranks, per group.

    Groups of LIMIT values or fewer are sorted whole. For larger ones df is read a few times (store it first if it is
    costly), and what meets in one place are sketches and counts, whatever the number of distinct values. The driver
    holds the wanted ranks of the large groups, fewer than one for LIMIT rows and share. Nulls do not count, NaN is the greatest
    value; null keys are a group. Without keys, an empty table gives one row of nulls.
    """
    keys, names = list(keys), [f"q{i}" for i in range(len(shares))]
    rows = df.select(*keys, F.col(column).cast("double").alias("__v")).where("__v is not null")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(~F.isnan("__v")).alias("__m")).where(F.col("__n") > LIMIT)
    plain = [F.percentile("__v", F.lit(float(s))).alias(name) for s, name in zip(shares, names)]
    large = sizes.collect()
    if not large:
        return rows.groupBy(*keys).agg(*plain)
    spark = df.sparkSession
    kinds = ", ".join(f"`__{i}` {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    if keys:
        groups = _listed(spark, [(*[r[k] for k in keys], g) for g, r in enumerate(large)], f"{kinds}, g int")
        same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
        numbered = rows.join(groups, same).select("g", F.col("__v").alias("v"))
    else:
        numbered = rows.select(F.lit(0).alias("g"), F.col("__v").alias("v"))
    spots = {(g, s): float(s) * (r["__n"] - 1) for g, r in enumerate(large) for s in shares}
    wanted = {(g, rank) for (g, _), at in spots.items() for rank in (math.floor(at), math.ceil(at)) if rank < large[g]["__m"]}
    at_ranks = _at_ranks(numbered.where(~F.isnan("v")), sorted(wanted))

    def between(g: int, at: float) -> float:
        low, high = math.floor(at), math.ceil(at)
        a, b = (at_ranks.get((g, rank), math.nan) for rank in (low, high))
        return a if a == b or low == high else (high - at) * a + (at - low) * b

    values = [(*[r[k] for k in keys], *[between(g, spots[g, s]) for s in shares]) for g, r in enumerate(large)]
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], *[f"{name} double" for name in names]])
    result = spark.createDataFrame(values, schema)
    return rows.join(groups, same, "left_anti").groupBy(*keys).agg(*plain).unionByName(result) if keys else result
