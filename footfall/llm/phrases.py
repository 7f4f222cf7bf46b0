"""Phrase mining over a weighted de Bruijn graph of words.

Texts, with A-Z lower-cased, fall into pieces at `[.,;:!?]` and line ends, and pieces into words at spaces and tabs. Each
word begins one gram: it and the three words after it, or, at the end of a piece, as many as there are. Grams of four
words are the edges, from the node of their first three words to that of their last three; shorter ones are the pieces'
ends. A node's count is the flow of its out-edges plus the ends of its own length, the count of two words that of the
nodes beginning with them plus ends, and so on: three exchanges of sums, each added up before it is sent, so no gram,
however frequent, is more than one number a task. Grams travel as compressed blocks of one language and bucket.

An edge and the one after it make up a unary path where both carry the whole flow of the node between them. Such paths
are compacted by pointers that double, over the edges that are frequent enough to be phrases; a path is never longer than
a piece, and has no cycle, as a text that walks it comes in and leaves somewhere.

Null and empty texts have no words; a null language is `und`; null and repeated doc_ids play no part; an empty table
gives no phrases. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_batches
from .hashing import pieces, run_hashes

LONGEST = 4
MIN_COUNT = 30
UNKNOWN = "und"
#: Bytes of text whose grams a task counts before it sends them, and bytes of text to a bucket.
FLUSH, BUCKET_BYTES = 6 << 20, 4 << 20
#: Grams that are spelled out at once.
SPELLED = 1 << 16
#: Parts of a language in which its best phrases are found first.
SALTS = 1024

_BYTES = np.arange(256)
_BREAK = np.isin(_BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_SPACE = (_BYTES == 32) | (_BYTES == 9)
BLOCK = "lang string, bucket int, level int, grams binary, counts binary"
_SCHEMA = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("level", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_CODEC = pa.Codec("zstd", 1)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _unpack(data: bytes) -> pa.Buffer:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"))


class Grams(NamedTuple):
    """Distinct grams by their hashes, ascending: their bytes, each with a line end, where the line ends are, and how often
    each gram occurs."""

    lines: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1] + 1])[: len(self.ends)]


def _spelled(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices values[first:last] as lines, and where their line ends are; some at a time."""
    size = last - first + 1
    ends = np.cumsum(size) - 1
    out = np.empty(ends[-1] + 1 if len(ends) else 0, np.uint8)
    for a in range(0, len(first), SPELLED):
        b = min(a + SPELLED, len(first))
        low, high = ends[a] - size[a] + 1, ends[b - 1] + 1
        at = np.arange(low, high) + np.repeat(first[a:b] - ends[a:b] + size[a:b] - 1, size[a:b])
        out[low:high] = values[np.minimum(at, len(values) - 1)]
    out[ends] = 10
    return out, ends


def _alike(values: np.ndarray, first: np.ndarray, last: np.ndarray, one: np.ndarray, other: np.ndarray) -> bool:
    """Whether each slice of `one` is the slice of `other` beside it."""
    size = last[one] - first[one]
    if (size != last[other] - first[other]).any():
        return False
    for a in range(0, len(one), SPELLED):
        n = size[a : a + SPELLED]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (values[at + np.repeat(first[one[a : a + SPELLED]], n)] != values[at + np.repeat(first[other[a : a + SPELLED]], n)]).any():
            return False
    return True


def _distinct(values: np.ndarray, first: np.ndarray, last: np.ndarray, counts: np.ndarray) -> Grams:
    """The distinct slices values[first:last] with their summed counts. Slices of one hash are compared; should two differ,
    they are told apart by their bytes."""
    hashes = run_hashes(values, first, last)
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = np.diff(hashes[order]) != 0
    again = np.flatnonzero(~new)
    if not _alike(values, first, last, order[again], order[again - 1]):
        data = values.tobytes()
        order = np.array(sorted(range(len(first)), key=lambda i: (hashes[i], data[first[i] : last[i]])), np.int64)
        texts = [data[first[i] : last[i]] for i in order]
        new = np.array([i == 0 or texts[i] != texts[i - 1] for i in range(len(texts))], bool)
    starts = np.flatnonzero(new)
    one = order[starts]
    lines, ends = _spelled(values, first[one], last[one])
    return Grams(lines, ends, np.add.reduceat(counts[order], starts) if len(starts) else counts[:0], hashes[one])


def _merged(parts: list[Grams]) -> Grams:
    lines = np.concatenate([p.lines for p in parts])
    base = np.cumsum([0, *(len(p.lines) for p in parts[:-1])])
    starts = np.concatenate([p.starts + x for p, x in zip(parts, base)])
    ends = np.concatenate([p.ends + x for p, x in zip(parts, base)])
    return _distinct(lines, starts, ends, np.concatenate([p.counts for p in parts]))


def _chosen(grams: Grams, at: np.ndarray) -> Grams:
    return Grams(*_spelled(grams.lines, grams.starts[at], grams.ends[at]), grams.counts[at], grams.hashes[at])


def grams_of(texts: list[str | None]) -> Grams | None:
    """Every distinct gram of the texts, words joined by one space, and how often it occurs."""
    found = []
    for _, data in pieces([t if isinstance(t, str) else "" for t in texts]):
        low = np.frombuffer(data, np.uint8)
        low = low + 32 * ((low >= 65) & (low <= 90)).view(np.uint8)
        broken, space = _BREAK[low], _SPACE[low]
        keep = ~(broken | space)
        edge = np.flatnonzero(np.diff(keep.view(np.int8), prepend=0, append=0))
        first, last = edge[0::2], edge[1::2]
        if not len(first):
            continue
        piece = np.cumsum(broken)[first]
        # the words again, each with one space behind
        keep[last] = True
        text = np.where(broken | space, np.uint8(32), low)[keep]
        begin = np.concatenate([[0], np.cumsum(last - first + 1)])[:-1]
        end = begin + (last - first)
        change = np.append(np.flatnonzero(np.diff(piece)), len(piece) - 1)  # the last word of each piece
        stop = np.minimum(np.arange(len(first)) + LONGEST - 1, np.repeat(change, np.diff(change, prepend=-1)))
        found.append(_distinct(text, begin, end[stop], np.ones(len(begin), np.int64)))
    return _merged(found) if found else None


def _blocks(lang: str, level: int, grams: Grams, buckets: int) -> Iterator[pa.RecordBatch]:
    """The grams by buckets, ranges of their hashes, one block each."""
    if not len(grams.counts):
        return
    bucket = ((grams.hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    starts = np.append(grams.starts, len(grams.lines))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        row = (lang, int(bucket[a]), level, _pack(grams.lines[starts[a] : starts[b]].tobytes()), _pack(grams.counts[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _SCHEMA.types)], schema=_SCHEMA)


def _read(blobs: bytes, counts: bytes) -> Grams:
    lines = np.frombuffer(_unpack(blobs), np.uint8)
    return Grams(lines, np.flatnonzero(lines == 10), np.frombuffer(_unpack(counts), np.int64), np.empty(0, np.uint64))


def _counted_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of the grams that begin at the words of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                found = grams_of(texts)
                if found:
                    yield from _blocks(lang, 0, found, buckets)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text").where("text is not null").mapInArrow(count, BLOCK)


def _flowed(blocks: DataFrame, level: int, buckets: int, least: int) -> DataFrame:
    """Adds up the grams of each bucket. Those of `level` words are then whole: the ones counted `least` times go on as
    they are, marked by level, and all hand their counts to their first level - 1 words; shorter ones go on. Of single words
    the sum is kept too, as the empty gram."""

    def close(lang: str, held: list[Grams]) -> Iterator[pa.RecordBatch]:
        grams = _merged(held)
        held.clear()
        spaces = np.flatnonzero(grams.lines == 32)
        upto = np.searchsorted(spaces, grams.ends)
        whole = np.diff(upto, prepend=0) == level - 1
        yield from _blocks(lang, level, _chosen(grams, np.flatnonzero(whole & (grams.counts >= least))), 1)
        if level == 1:
            total = np.array([grams.counts.sum()])
            yield from _blocks(lang, 1, Grams(np.full(1, 10, np.uint8), np.zeros(1, np.int64), total, np.zeros(1, np.uint64)), 1)
            return
        last = np.where(whole, spaces[upto - 1] if len(spaces) else 0, grams.ends)  # without the last word
        yield from _blocks(lang, 0, _distinct(grams.lines, grams.starts, last, grams.counts), buckets)

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            done = pc.greater(batch.column("level"), 0)
            finals = batch.filter(done)
            if len(finals):
                yield finals.cast(_SCHEMA)
            rest = batch.filter(pc.invert(done))
            for lang, bucket, grams, counts in zip(*(rest.column(c).to_pylist() for c in ("lang", "bucket", "grams", "counts"))):
                if held and key != (lang, bucket):
                    yield from close(key[0], held)
                    held = []
                    pa.default_memory_pool().release_unused()
                key = (lang, bucket)
                held.append(_read(grams, counts))
        if held:
            yield from close(key[0], held)

    return blocks.repartition("lang", "bucket", "level").sortWithinPartitions("lang", "bucket").mapInArrow(flow, BLOCK)


def counts(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, k, f): phrases of one to LONGEST words that occur `least` times or more, with their counts, and the
    empty phrase of k = 0 with the count of all words, several times in parts."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-max(size, 1) // BUCKET_BYTES)
    blocks = _counted_texts(docs, buckets)
    for level in range(LONGEST, 0, -1):
        blocks = _flowed(blocks, level, buckets, least)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, level, blob, numbers in zip(*(batch.column(c).to_pylist() for c in ("lang", "level", "grams", "counts"))):
                grams = _read(blob, numbers)
                phrases = grams.lines.tobytes().decode().split("\n")[:-1]
                sizes = np.where(np.diff(grams.ends, prepend=-1) > 1, level, 0)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(grams.counts)], ["lang", "phrase", "k", "f"])

    return cut(blocks.mapInArrow(spell, "lang string, phrase string, k int, f long"), "phrases")


def _first(c: str, n: int):
    return F.substring_index(c, " ", n)


def links(counted: DataFrame) -> DataFrame:
    """(lang, edge, node, following): an edge, the unary node at its end and the edge after it."""
    edges = counted.where(f"k = {LONGEST}").select("lang", F.col("phrase").alias("edge"), F.col("f").alias("weight"))
    nodes = counted.where(f"k = {LONGEST - 1}").select("lang", F.col("phrase").alias("node"), F.col("f").alias("flow"))
    side = lambda n, name: edges.select("lang", _first("edge", n).alias("node"), F.col("edge").alias(name), "weight").join(nodes, ["lang", "node"]).where("weight = flow").select("lang", "node", name)
    return side(-(LONGEST - 1), "edge").join(side(LONGEST - 1, "following"), ["lang", "node"])


def paths(counted: DataFrame, linked: DataFrame) -> DataFrame:
    """(lang, path, weight, n_edges): the frequent edges with unary paths compacted to one row each."""
    edges = counted.where(f"k = {LONGEST}").select("lang", F.col("phrase").alias("edge"), F.col("f").alias("weight"))
    before = linked.select("lang", F.col("following").alias("edge"), F.col("edge").alias("back"))
    state = cut(edges.join(before, ["lang", "edge"], "left").select("lang", "edge", "weight", F.coalesce("back", "edge").alias("back"), F.when(F.col("back").isNull(), 0).otherwise(1).alias("hops")), "paths")
    while True:
        far = state.select("lang", F.col("edge").alias("back"), F.col("back").alias("farther"), F.col("hops").alias("more"))
        step = cut(state.join(far, ["lang", "back"]).select("lang", "edge", "weight", F.col("farther").alias("back"), (F.col("hops") + F.col("more")).alias("hops"), F.col("more")), "paths")
        state = step.drop("more")
        if step.where("more > 0").isEmpty():
            break
    tail = F.transform(F.array_sort(F.collect_list(F.struct("hops", _first("edge", -1).alias("word")))), lambda x: x["word"])
    return state.groupBy("lang", F.col("back").alias("head")).agg(F.first("weight").alias("weight"), F.count("*").alias("n_edges"), tail.alias("words")).select(
        "lang", F.concat_ws(" ", _first("head", LONGEST - 1), F.array_join("words", " ")).alias("path"), "weight", "n_edges")


def candidates(counted: DataFrame, compacted: DataFrame, share: int = 80) -> DataFrame:
    """(lang, phrase, k, a) of two words or more that no longer phrase holds in `share` per cent of their occurrences or more.
    What the edges hold is read off the compacted paths, each of which names a phrase inside it once."""
    long = counted.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    nodes = counted.where(f"k > 2 and k < {LONGEST}").select("lang", F.col("phrase").alias("path"), F.col("f").alias("weight"), "k")
    holders = compacted.select("lang", "path", "weight", F.lit(LONGEST).alias("k")).unionByName(nodes)
    words = F.split("path", " ")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    held = holders.select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "weight").groupBy("lang", "phrase").agg(F.max("weight").alias("by"))
    exact = lambda n, c: F.lit(n).cast("decimal(3,0)") * F.col(c).cast("decimal(19,0)")
    return long.join(held, ["lang", "phrase"], "left").where(F.col("by").isNull() | (exact(100, "by") < exact(share, "a"))).drop("by")


def scored(found: DataFrame, counted: DataFrame) -> DataFrame:
    """found with l, r and score of each phrase's lowest-scoring cut, the earliest of equals."""
    part = lambda name: counted.where(f"k between 1 and {LONGEST - 1}").select("lang", F.col("phrase").alias(name[0]), F.col("f").alias(name[1]))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"))
    both = cuts.join(part(("head", "l")), ["lang", "head"]).join(part(("rest", "r")), ["lang", "rest"])
    score = F.expr("2000000BD * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = both.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("least"))
    return lowest.select("lang", "phrase", "k", "a", "least.l", "least.r", "least.score")


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first `most` phrases by score, count and bytes; ranked in parts first, so no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))
    some = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("nth", within).where(F.col("nth") <= most)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("salt", "nth")


def mine(docs: DataFrame, least: int = MIN_COUNT, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs (lang, text)."""
    counted = counts(docs, least)
    compacted = paths(counted, links(counted))
    totals = counted.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = best(scored(candidates(counted, compacted), counted), most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
