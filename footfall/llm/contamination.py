"""Benchmark decontamination: an FM-index per shard of documents, searched backwards for every window of every item.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A window is ten consecutive words of
an item, or all words of a shorter one. The words of a shard, with those that no item holds as breaks, make up an index;
all windows are searched in it at once, their occurrences located by samples, and the words inside merged to spans.

Null text has no words; null and repeated doc_ids are rows like others. Items of one item_id are one item. An item
without item_id marks words, but has no name to be listed or counted. Columns other than the ones named take no part.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .fmindex import FMIndex
from .hashing import pieces, run_hashes

WINDOW = 10
#: Words of one shard; longer ones are indexed in overlapping parts of so many.
SHARD_WORDS = 1 << 20
#: Words of items that are searched for in one pass over the documents; more items make more passes.
PASS_WORDS = 1 << 20

_BYTES = np.arange(256)
_INSIDE = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
NAMES = ("n_words", "n_hit", "items", "spans")
KINDS = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of the texts, in order: place of its text, hash, first and last (exclusive) code point in the text."""
    out, done = [], 0
    for ends, data in pieces([t if isinstance(t, str) else "" for t in texts]):
        low = np.frombuffer(data, np.uint8)
        low = low + 32 * ((low >= 65) & (low <= 90)).view(np.uint8)
        edge = np.flatnonzero(np.diff(_INSIDE[low].view(np.int8), prepend=0, append=0))
        first, last = edge[0::2], edge[1::2]
        text = np.searchsorted(ends, first, side="right")
        points = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
        base = points[np.concatenate([[0], ends])[text]]
        out.append((done + text, run_hashes(low, first, last), points[first] - base, points[last] - base))
        done += len(ends)
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Phrases:
    """All distinct windows of some items, as rows of symbols, and what items each stands in."""

    def __init__(self, names: list[str | None], texts: list[str | None]):
        place, word, _, _ = split(texts)
        self.vocabulary = np.unique(word)
        symbol = np.searchsorted(self.vocabulary, word) + 2
        size = np.bincount(place, minlength=len(texts))
        begin = np.cumsum(size) - size
        starts = np.concatenate([np.arange(b, b + max(1, n - WINDOW + 1)) for b, n in zip(begin, size) if n] or [np.empty(0, np.int64)]).astype(np.int64)
        lengths = np.minimum(size[place[starts]], WINDOW) if len(starts) else starts
        padded = np.zeros((len(starts), WINDOW), np.int64)
        for back in range(WINDOW):
            on = np.flatnonzero(lengths > back)
            padded[on, WINDOW - 1 - back] = symbol[starts[on] + lengths[on] - 1 - back]
        self.rows, which = np.unique(padded, axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        owners: list[set[str]] = [set() for _ in self.rows]
        for w, p in zip(which.reshape(-1), place[starts]):
            if names[p] is not None:
                owners[w].add(names[p])
        shared: dict[frozenset, int] = {}  # windows of the same items are one class
        self.owner = np.array([shared.setdefault(frozenset(x), len(shared)) for x in owners], np.int64)
        self.classes = list(shared)

    def occurrences(self, word: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all windows in words told by their hashes, with breaks put in before the given places. The
        places returned count breaks too."""
        if not len(self.rows) or not len(word):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        symbol = np.insert(np.where(self.vocabulary[at] == word, at + 2, 1), breaks, 1)
        places, windows = [], []
        for start in range(0, len(symbol), SHARD_WORDS):
            part = symbol[start : start + SHARD_WORDS + WINDOW - 1]
            kept = part > 1
            kept[1:] |= part[:-1] > 1  # one break after each run is enough
            back = np.flatnonzero(kept)
            index = FMIndex(part[kept], len(self.vocabulary) + 2)
            low, high = index.search(self.rows, self.lengths)
            count = np.maximum(high - low, 0)
            window = np.repeat(np.arange(len(low)), count)
            row = np.arange(len(window)) + np.repeat(low - np.cumsum(count) + count, count)
            places.append(start + back[index.locate(row)])
            windows.append(window)
        return np.concatenate(places), np.concatenate(windows)

    def found(self, texts: list[str | None], items: list[list[str]], spans: list[list[dict]]) -> list[tuple]:
        """(words, words hit, items, spans) of every text, added to the items and spans that are known."""
        text, word, first, last = split(texts)
        n_words = np.bincount(text, minlength=len(texts))
        place, window = self.occurrences(word, np.cumsum(n_words))
        of = np.searchsorted(np.cumsum(n_words + 1), place, side="right")
        change = np.zeros(len(word) + 1, np.int64)
        np.add.at(change, place - of, 1)
        np.add.at(change, place - of + self.lengths[window], -1)
        hit = np.cumsum(change[:-1]) > 0
        ends = np.cumsum(n_words)
        for i, known in enumerate(spans):
            mine = slice(ends[i] - n_words[i], ends[i])
            for s in known:
                hit[mine] |= (first[mine] >= s["start"]) & (last[mine] <= s["end"])
        n_hit = np.bincount(text[hit], minlength=len(texts))
        joined = hit[1:] & hit[:-1] & (text[1:] == text[:-1])  # a word and the one before it lie in one span
        begins = np.flatnonzero(hit & ~np.concatenate([[False], joined])) if len(hit) else np.empty(0, np.int64)
        stops = np.flatnonzero(hit & ~np.concatenate([joined, [False]])) if len(hit) else begins
        merged: list[list] = [[] for _ in texts]
        for t, a, b in zip(text[begins].tolist(), first[begins].tolist(), last[stops].tolist()):
            merged[t].append({"start": a, "end": b})
        named = [set(x) for x in items]
        for both in np.unique(of * len(self.classes) + self.owner[window]).tolist():
            named[both // len(self.classes)].update(self.classes[both % len(self.classes)])
        return list(zip(n_words.tolist(), n_hit.tolist(), map(sorted, named), merged))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches whose texts make up about a shard."""
    part, size = [], 0
    for batch in batches:
        part.append(batch)
        size += batch.column("text").nbytes
        if size >= 6 * SHARD_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _pass(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """docs (doc_id, text, items, spans, ...) with what the phrases add."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)  # PASS_WORDS words at most

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            table = pa.Table.from_batches(run)
            found = sent.value.found(*(table.column(c).to_pylist() for c in ("text", "items", "spans")))
            columns = zip(*found) if found else [()] * 4
            yield from pa.table([table.column("doc_id"), table.column("text"), *map(pa.array, columns, KINDS)], ["doc_id", "text", *NAMES]).to_batches()

    return docs.mapInArrow(search, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, {FOUND}")


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """Items in blocks of about PASS_WORDS words, one block at a time at the driver."""
    names, texts, size = [], [], 0
    for row in items.select(F.col("item_id").cast("string").alias("name"), "text").where("text is not null").toLocalIterator():
        names.append(row["name"]), texts.append(row["text"])
        size += len(row["text"]) // 2 + 1  # a word and what ends it have two characters or more
        if size >= PASS_WORDS:
            yield names, texts
            names, texts, size = [], [], 0
    yield names, texts


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, the sorted names of the items found, and the merged spans of
    the words hit, in code points. Items of more than PASS_WORDS words are searched for by blocks, one after another in
    the same job, each adding to what the ones before have found."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", "text", F.expr("cast(array() as array<string>)").alias("items"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"))
    for block in _blocks(items):
        found = _pass(found, Phrases(*block))
    return found.drop("text")


def judged(found: DataFrame) -> DataFrame:
    """The digest columns: how many items, the hash of their names, and whether any word is hit."""
    listed = F.concat_ws(",", "items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its spans; null stays null."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    return F.when(text.isNotNull(), F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))), ""))

