"""Near-duplicates by a multi-index Hamming join over MinHash signatures.

A document's signature is SYMBOLS minima of its shingle hashes. Two signatures within MAX_ERRORS differing symbols
agree, in at least one of the CHUNKS chunks, up to one error (pigeonhole: CHUNKS chunks with two errors each would make
more than MAX_ERRORS). So every chunk is indexed under each way of leaving one of its symbols out, and any pair within
the distance shares a key. Links are then confirmed on the full sets.

Copies of one set collapse first. Then every member of a bucket is compared with one hub of it, and only buckets whose
members stay in different groups after that are expanded into pairs of such members of like size, which are told apart
by signatures and sketches before any text is read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest, xxh64_intdigest

from .common import cut, discard, small_batches
from .hashing import text_runs, word_hashes

#: With 8 chunks of 3 symbols and one error allowed in each, all pairs within 15 of 24 differing symbols are found; at a
#: similarity of 0.75 a pair is farther apart with probability under 2e-5.
CHUNKS, CHUNK = 8, 3
SYMBOLS = CHUNKS * CHUNK
MAX_ERRORS = 2 * CHUNKS - 1
SHINGLE = 5
#: Bits of the odd sketch: each shingle flips one bit, so the bits in which two sketches differ never exceed the shingles
#: that only one of the sets has.
SKETCH = 1024
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Ids that may be sent to every executor to pick the texts to confirm: 16 MB; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
HUB_ROUNDS = 2
#: Members, on average, that are compared with a hub's text in one go.
CROWD = 16

_MULTIPLY = np.array([xxh64_intdigest(b"multiply", i) | 1 for i in range(SYMBOLS)], np.uint64)
_ADD = np.array([xxh64_intdigest(b"add", i) for i in range(SYMBOLS)], np.uint64)
_PLACE = np.array([xxh64_intdigest(b"place", i) | 1 for i in range(SHINGLE)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: Sequence[object]) -> Iterator[np.ndarray]:
    """For each whole text, the sorted distinct 64-bit hashes of its five-word shingles with A-Z lower-cased; with fewer
    words, one hash of all of them; without words, none."""
    for part in text_runs(texts):
        place, hashed = word_hashes(part)
        bounds = np.searchsorted(place, np.arange(len(part) + 1))
        total = np.full(max(0, len(hashed) - SHINGLE + 1), SHINGLE, np.uint64)
        for i in range(SHINGLE):
            total = _mix(total ^ hashed[i : i + len(total)] * _PLACE[i])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(total[a : b - SHINGLE + 1])
                continue
            one = np.full(min(1, b - a), b - a, np.uint64)
            for i in range(b - a):
                one = _mix(one ^ hashed[a + i : a + i + 1] * _PLACE[i])
            yield one


def signature(found: np.ndarray) -> np.ndarray:
    """SYMBOLS 32-bit minima, one per hash function. Keys are made of all their bits, distances of their low bytes."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 8192):
        part = found[start : start + 8192]
        np.minimum(least, _mix(part[:, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def odd_sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH bits as longs: the parity of the shingles in each of SKETCH classes."""
    parity = np.bincount((found >> np.uint64(54)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view("<i8")


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set; null without shingles), symbols (24 ints), s0-s2 (their low bytes,
    eight to a long) and odd (the sketch) for every row."""

    kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
    names = ["n_shingles", "print", "symbols", "odd", "s0", "s1", "s2"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # doc_id stays an Arrow column: as a number of pandas, one null would round the others
            rows = []
            for found in shingles(batch.column("text").to_pylist()):
                symbols = signature(found)
                low = (symbols & 0xFF).astype(np.uint8).tobytes()
                packed = np.frombuffer(low, "<i8").tolist()
                rows.append((len(found), xxh3_128_hexdigest(found.tobytes()) if len(found) else None, symbols.view(np.int32), odd_sketch(found), *packed))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", *names])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n_shingles long, print string, symbols array<int>, odd array<long>, s0 long, s1 long, s2 long")


def distance(a: str, b: str) -> Column:
    """Number of symbols whose low bytes differ: at most the number of symbols that differ."""
    total = F.lit(0)
    for s in ("s0", "s1", "s2"):
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def indexed(reps: DataFrame) -> DataFrame:
    """rep, n, s0-s2 under each key: each chunk with one of its symbols left out."""
    keys = [
        F.xxhash64(F.lit(c * CHUNK + out), *[F.col("symbols")[c * CHUNK + i] for i in range(CHUNK) if i != out])
        for c in range(CHUNKS) for out in range(CHUNK)
    ]
    return reps.select("rep", "n", "s0", "s1", "s2", F.explode(F.array(*keys)).alias("key"))


def _near(a: str, b: str) -> Column:
    """The size bound that the similarity implies, and the signature distance."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (distance(a, b) <= MAX_ERRORS)


def _alike(a: str, b: str) -> Column:
    """_near, and the strict bound from the sketches (o0, o1, ...): links differ in (1 - s) / (1 + s) of the summed sizes
    at most."""
    differ = sum((F.bit_count(F.col(f"{a}.o{i}").bitwiseXOR(F.col(f"{b}.o{i}"))) for i in range(1, SKETCH // 64)), F.bit_count(F.col(f"{a}.o0").bitwiseXOR(F.col(f"{b}.o0"))))
    return _near(a, b) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full shingle sets have a Jaccard similarity of PERCENT / 100 or more.

    Only texts that occur in pairs are picked. A pair of ids that stands for several texts (repeated doc_ids) is
    confirmed if any of them are similar.
    """
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = cut(texts.join(ids, "doc_id", "left_semi"), "texts")
    # a hub's text is sent once for each crowd of its members, not once for each of them
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("crowds"))
    crowd = F.pmod(F.xxhash64("b"), F.col("crowds")).cast("int").alias("crowd")
    members = (
        pairs.join(size, "a").select("a", "b", crowd).join(picked.select(F.col("doc_id").alias("b"), "text"), "b")
        .groupBy("a", "crowd").agg(F.collect_list(F.struct("b", "text")).alias("members"))
    )
    both = members.join(picked.select(F.col("doc_id").alias("a"), F.col("text").alias("hub")), "a").select("a", "hub", "members")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for a, hub, members in zip(frame["a"], frame["hub"], frame["members"], strict=True):
                one, *others = shingles([hub, *(m["text"] for m in members)])
                for member, other in zip(members, others, strict=True):
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    if common and 100 * common >= PERCENT * (len(one) + len(other) - common):
                        found.append((a, member["b"]))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return both.mapInPandas(batches, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rep, comp (the smallest rep reachable) for each of the nodes, from edges (a, b).

    Large-star and small-star rounds: each round every node links its greater neighbours, then its smaller ones, to the
    smallest node it knows of, until nothing changes. Minima are taken per task first; the joins that hand them out are
    sort-merge joins, which split the rows of a node with very many links as those of any skewed key.
    """
    def known(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = known(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        following = cut(small, "links")
        after = known(following)
        discard(links)
        links = following
        if after == before:
            break
        before = after
    stars = links.groupBy("u").agg(F.min("v").alias("comp"))
    return nodes.join(stars, nodes.rep == stars.u, "left").select("rep", F.coalesce("comp", "rep").alias("comp"))


def linked(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, comp for reps (rep, n, symbols, odd, s0, s1, s2), one row per distinct shingle set."""
    index = indexed(reps)
    shared = index.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    entries = cut(index.join(shared, "key"), "entries")
    edges, comps = None, reps.select("rep", F.col("rep").alias("comp"))
    for turn in range(HUB_ROUNDS):
        # one hub for each bucket and turn, another one each turn; buckets that are one component already are done
        member = entries.join(comps, "rep") if turn else entries.withColumn("comp", F.col("rep"))
        order = F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")
        hubs = member.groupBy("key").agg(
            F.min(F.struct(order.alias("o"), "rep", "n", "s0", "s1", "s2", "comp")).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        ).where("lo <> hi").select("key", "h.*")
        stars = (
            member.alias("x").join(hubs.alias("h"), "key").where((F.col("x.comp") != F.col("h.comp")) & _near("x", "h"))
            .select(F.least("x.rep", "h.rep").alias("a"), F.greatest("x.rep", "h.rep").alias("b")).distinct()
        )
        found = confirmed(cut(stars, "stars"), docs)
        edges = cut(found if edges is None else edges.unionByName(found), "edges")
        comps = cut(components(reps.select("rep"), edges), "comps")
    member = entries.select("key", "rep").join(comps, "rep")
    mixed = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    whole = reps.select(
        "rep", "n", F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("size_class"),
        "s0", "s1", "s2", *[F.col("odd")[i].alias(f"o{i}") for i in range(SKETCH // 64)])
    left = cut(member.join(mixed, "key").join(whole, "rep"), "mixed")
    # similar sets lie in the same or in neighbouring classes of size, so large buckets split by size
    reach = [F.floor(F.log2(F.col("n") * x)).cast("int") for x in (PERCENT / 100 - 1e-9, 100 / PERCENT + 1e-9)]
    right = left.withColumn("size_class", F.explode(F.sequence(*reach)))
    rest = (
        left.alias("x").join(right.alias("y"), ["key", "size_class"])
        .where((F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & _alike("x", "y"))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    )
    found = confirmed(cut(rest, "rest"), docs)
    return components(reps.select("rep"), cut(edges.unionByName(found), "edges"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept
    (doc_id = component_id).

    Texts that are null or hold no word have no shingles and stand alone. Texts of fewer than five words are one shingle.
    Rows with a null doc_id stand alone too, with a null component_id, and are kept. Rows that repeat a doc_id count as
    one node of the graph: they are kept or dropped together, and their texts' links join. Other columns are dropped.
    """
    sets = cut(signed(docs), "signed")
    alike = sets.where("doc_id is not null and print is not null")
    one = alike.groupBy("print").agg(F.min(F.struct(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "s0", "s1", "s2", "symbols", "odd")).alias("r"))
    reps = cut(one.select("print", "r.*"), "reps")
    comps = cut(linked(docs, reps), "found").distinct()
    # rows that repeat a doc_id with several sets: the copies link their sets' representatives
    repeated = alike.select("doc_id", "print").distinct().groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    extra = alike.join(repeated, "doc_id", "left_semi").join(reps.select("print", "rep"), "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    extra = cut(extra.where("a <> b").distinct(), "extra")
    if extra.limit(1).count():
        nodes = comps.select("rep").unionByName(extra.select(F.col("a").alias("rep"))).distinct()
        comps = cut(components(nodes, comps.select(F.col("rep").alias("a"), F.col("comp").alias("b")).unionByName(extra)), "found")
    by_print = reps.select("print", "rep").join(comps, "rep").select("print", "comp")
    return (
        sets.select("doc_id", "n_shingles", "print").join(by_print, "print", "left")
        .select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows that classes() does not keep; of rows that repeat a kept doc_id all stay."""
    dropped = cut(classes(docs).where("not kept").select("doc_id").distinct(), "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti")
