"""Lexical retrieval packing: a sharded BM25 inverted index returns unused neighbours for each seed document, which
greedily fill its window.

Texts are encoded once. Documents are then dealt to index shards of bounded size by content: by the term that weighs most
in them, so that those that share it lie side by side; a term that many share is spread over as many tasks as it fills.
Inside a shard, documents longer than a window give whole windows of their own first; what is left of each document is
indexed. A seed, the unused document with the longest rest, opens a window, all its terms query the shard's inverted
index, and the unused documents that share one follow by score until the window is full, the last one cut to fit.
Document frequencies are those of the whole corpus.

A seed sees the documents of its own shard only.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, small_batches
from .hashing import MIX, pieces, run_hashes, split_words

WINDOW = 2048
#: The id that ends every document.
END = 1
#: Tokens in one index shard, and, on average, in one task, which packs its shards one after the other. The numbers of both
#: grow with the corpus.
SHARD_TOKENS, TASK_TOKENS = 1_200_000, 9_600_000
#: Terms are hashed into 2^TERM_BITS classes; their document frequencies (8 bytes each) go to every executor.
TERM_BITS = 18
K1, B = 1.2, 0.75
#: Neighbours sorted before the others: a window takes a few.
BEST = 32
#: Chunks that one Python worker remembers, some 40 bytes each, and the places of their table.
CACHE, SLOTS = 1_200_000, 1 << 21


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Runs:
    """Lists of ids in one array, by number."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.starts = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def at(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these numbers in a row."""
        return self.ids[ragged(self.starts[numbers], self.sizes[numbers])]


#: White-space-free bytes encoded at once, which stay in a core's cache, and chunks looked up at once.
ENCODE, ROUND = 1 << 17, 1 << 16
#: Lower-case ASCII letters, and the ASCII marks that are one run to the tokenizer, by byte.
_BYTES = np.arange(256)
LETTERS = (_BYTES >= 97) & (_BYTES <= 122)
MARKS = (_BYTES >= 33) & (_BYTES <= 126) & ~LETTERS & ~((_BYTES >= 48) & (_BYTES <= 57)) & ~((_BYTES >= 65) & (_BYTES <= 90))


def letters(low: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a lower-case letter whose lower case and normal form are the same to Python and the
    tokenizer: a-z and those of Latin-1."""
    found = LETTERS[low]
    lead = np.flatnonzero(low[:-1] == 0xC3)
    lead = lead[(low[lead + 1] >= 0x9F) & (low[lead + 1] != 0xB7)]
    found[lead] = found[lead + 1] = True
    return found


def run_ends(inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the run of true values that begins at each place ends; the last value is false."""
    outside = np.flatnonzero(~inside)
    return outside[np.searchsorted(outside, first)]


def joined(low: np.ndarray, first: np.ndarray, last: np.ndarray, between: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of low one after the other, each followed by a byte `between`, and where they end."""
    size = last - first + 1
    out, ends = low[ragged(first, size)], np.cumsum(size) - 1
    out[ends] = between
    return out, ends


def names(low: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell the runs of low apart: a hash that is not 0, and the length mixed with the first eight bytes."""
    size = (last - first).astype(np.uint64)
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    # eight bytes from each place on, of which those of the run count
    eight = np.ndarray(len(low), "<u8", padded, strides=(1,))[first]
    eight &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(size, np.uint64(8)))
    return run_hashes(low, first, last) | np.uint64(1), (eight ^ size << np.uint64(1)) * MIX


class _Chunks:
    """Ids of chunks, the parts of a text between white space, in a table with open addressing.

    Tokens never cross white space, and the tokenizer drops it, so the ids of a text are those of its chunks in order,
    and chunks that differ in ASCII case alone have the same. A chunk is known by a 64-bit hash, its length and its
    first eight bytes. A run of letters is one word to the tokenizer, whatever follows it, so a chunk of letters and marks
    is put together from its word and its run of marks, which are in the table too; new words are encoded together, as one
    text that is cut again at the marks of word ends. A tokenizer that does not work so gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = word_ends(self.tokenizer)
        probe = ["Ab", "cd,", "(ef)", "x"]
        self.by_chunk = self._plain([" \n ".join(probe)])[0].tolist() == self._plain(probe)[0].tolist() and not self.ends.all()
        self.forget()

    def forget(self) -> None:
        self.held, self.filled = 0, 0
        self.key, self.check, self.again = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, bool)
        self.start, self.size = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint32)
        self.ids = np.empty(1 << 16, self.dtype)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def _words(self, low: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters only."""
        ids, sizes = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for at in range(0, len(first), 4096):
            part = joined(low, first[at : at + 4096], last[at : at + 4096], 32)[0].tobytes().decode()
            one = np.array(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(self.ends[one]) + 1
            # else one of them is not a single word to the tokenizer
            found = (one, np.diff(stops, prepend=0)) if len(stops) == len(first[at : at + 4096]) else self._plain(part.split())
            ids.append(found[0])
            sizes.append(found[1])
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn_words(self, low: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        self._add(key, check, *self._words(low, first, last))

    def _learn_texts(self, low: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        self._add(key, check, *self._plain(joined(low, first, last, 10)[0].tobytes().decode().split("\n")[:-1]))

    def _learn_chunks(self, low: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        """Words and marks of which chunks are made are looked up before they are encoded."""
        low, ends = joined(low, first, last, 32)
        first, last = ends - (last - first), ends
        middle = run_ends(letters(low), first)
        plain = (middle > first) & (run_ends(MARKS[low], middle) == last)
        marked = plain & (middle < last)
        word = self._places(low, first[plain], middle[plain], self._learn_words)[marked[plain]]
        mark = self._places(low, middle[marked], last[marked], self._learn_texts)
        self._learn_texts(low, *(x[~plain] for x in (first, last, key, check)))
        both = np.stack([word, mark], 1).ravel()
        sizes = self.size[both].astype(np.int64)
        self._add(key[marked], check[marked], self.ids[ragged(self.start[both].astype(np.int64), sizes)], sizes[0::2] + sizes[1::2])

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each chunk in the table, or -1."""
        place = np.full(len(key), -1, np.int64)
        left, at = np.arange(len(key)), (key >> np.uint64(43)).astype(np.int64)
        while len(left):
            there = self.key[at]
            same = (there == key[left]) & (self.check[at] == check[left])
            place[left[same]] = at[same]
            on = ~same & (there != 0)
            left, at = left[on], (at[on] + 1) & (SLOTS - 1)
        return place

    def _add(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        starts = self.filled + np.cumsum(sizes) - sizes
        self.filled, self.held = self.filled + len(ids), self.held + len(key)
        left, at = np.arange(len(key)), (key >> np.uint64(43)).astype(np.int64)
        while len(left):
            _, chosen = np.unique(at, return_index=True)
            chosen = chosen[self.key[at[chosen]] == 0]
            self.key[at[chosen]], self.check[at[chosen]] = key[left[chosen]], check[left[chosen]]
            self.start[at[chosen]], self.size[at[chosen]] = starts[left[chosen]], sizes[left[chosen]]
            on = np.ones(len(left), bool)
            on[chosen] = False
            left, at = left[on], (at[on] + 1) & (SLOTS - 1)

    def _thin_out(self) -> None:
        """Forget the chunks that did not come again since they were added, or since this was last called. Half of the table at
        least becomes free."""
        kept = np.flatnonzero(self.again)[: CACHE // 2]
        sizes = self.size[kept].astype(np.int64)
        held = self.key[kept], self.check[kept], self.ids[ragged(self.start[kept].astype(np.int64), sizes)], sizes
        self.forget()
        self._add(*held)

    def _places(self, low: np.ndarray, first: np.ndarray, last: np.ndarray, learn: Callable[..., None]) -> np.ndarray:
        """The place of each run of low in the table, where `learn` puts what it does not hold."""
        key, check = names(low, first, last)
        place = self._find(key, check)
        self.again[place[place >= 0]] = True
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = missing[np.unique(key[missing], return_index=True)[1]]
            learn(low, *(x[new] for x in (first, last, key, check)))
            place[missing] = self._find(key[missing], check[missing])
        return place

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks of a piece in a row, the number of each chunk's ids, and where it starts."""
        low, first, last = split_words(data, wide=True)
        ids, sizes = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for at in range(0, len(first), ROUND):
            one = slice(first[at], last[min(at + ROUND, len(first)) - 1] + 1)
            runs = first[at : at + ROUND] - one.start, last[at : at + ROUND] - one.start
            if self.held and self.held + 3 * len(runs[0]) > CACHE:  # a chunk, its word and its marks
                self._thin_out()
            place = self._places(low[one], *runs, self._learn_chunks)
            sizes.append(self.size[place].astype(np.int64))
            ids.append(self.ids[ragged(self.start[place].astype(np.int64), sizes[-1])])
        return np.concatenate(ids), np.concatenate(sizes), first

    def texts(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        out: list[bytes] = []
        if not self.by_chunk:
            for at in range(0, len(texts), 64):
                ids, sizes = self._plain(list(texts[at : at + 64]))
                out += _cut_up(ids, sizes)
            return out
        for ends, data in pieces(texts, ENCODE):
            ids, sizes, first = self._piece(data)
            upto = np.append(0, np.cumsum(sizes))[np.searchsorted(first, ends)]
            out += _cut_up(ids, np.diff(upto, prepend=0))
        return out


def _cut_up(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, width, stops = ids.tobytes(), ids.dtype.itemsize, np.cumsum(sizes)
    return [raw[width * (b - n) : width * b] for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]


def word_ends(tokenizer: Tokenizer) -> np.ndarray:
    """Whether each id ends a word; all do for a tokenizer that does not mark it."""
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")
    return ends if ends.any() else ~ends


@functools.cache
def _known(path: str) -> _Chunks:
    """One table for each Python worker: what it holds is bounded."""
    return _Chunks(path)


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (without the end mark, as bytes) of every row of docs, in any order."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(tokenizer_path)
        for batch in batches:  # doc_id stays an Arrow column: as a number of pandas, one null would round the others
            texts = [t if isinstance(t, str) else "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(known.texts(texts), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids binary")


class Terms(NamedTuple):
    """One entry for each word of some documents: the document's place, and the class of the word, a hash of its ids."""

    doc: np.ndarray
    term: np.ndarray


def terms(ids: Sequence[bytes], ends: np.ndarray, dtype: np.dtype) -> Terms:
    docs, classes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    start = 0
    while start < len(ids):
        stop, size = start, 0
        while stop < len(ids) and (stop == start or size + len(ids[stop]) // dtype.itemsize < ENCODE):
            size += len(ids[stop]) // dtype.itemsize
            stop += 1
        flat = np.frombuffer(b"".join(ids[start:stop]), dtype)
        upto = np.cumsum([len(x) // dtype.itemsize for x in ids[start:stop]])
        stops = ends[flat]
        stops[upto[upto > 0] - 1] = True
        last = np.flatnonzero(stops) + 1
        first = np.append(0, last[:-1])[: len(last)]
        classes.append((run_hashes(flat, first, last) >> np.uint64(64 - TERM_BITS)).astype(np.int64))
        docs.append(np.repeat(np.arange(start, stop), np.diff(np.searchsorted(last, upto, side="right"), prepend=0)))
        start = stop
    return Terms(np.concatenate(docs), np.concatenate(classes))


def distinct(found: Terms, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, class, count) of the distinct terms of each document, in this order."""
    both = found.doc << TERM_BITS | found.term
    if n_docs <= 1 << (32 - TERM_BITS):
        both = both.astype(np.uint32)
    both, count = np.unique(both, return_counts=True)
    both = both.astype(np.int64)
    return both >> TERM_BITS, both & ((1 << TERM_BITS) - 1), count


class Corpus(NamedTuple):
    """What every task knows of all documents: how many there are, the mean number of their words, and in how many each class
    of words occurs."""

    n_docs: int
    mean: float
    frequency: np.ndarray

    def weights(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weight of a class that occurs so often in a document of so many words."""
        idf = np.log(1 + (self.n_docs - self.frequency[term] + 0.5) / (self.frequency[term] + 0.5))
        return idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / (self.mean or 1.0)))


def _sums(docs: DataFrame, size: int, count: Callable[[pd.DataFrame, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows of what `count` adds to an array of `size` longs. Each task adds up its own rows, so what is
    shuffled is one row per task and place of the array."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for frame in frames:
            count(frame, total)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    found = docs.mapInPandas(partial, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[found["at"].to_numpy()] = found["n"].to_numpy()
    return total


def corpus_statistics(ids: DataFrame, ends: np.ndarray, dtype: np.dtype) -> Corpus:
    """Over all rows of (doc_id, ids)."""

    def count(frame: pd.DataFrame, total: np.ndarray) -> None:
        found = terms(frame["ids"], ends, dtype)
        total[: 1 << TERM_BITS] += np.bincount(distinct(found, len(frame))[1], minlength=1 << TERM_BITS)
        total[-2:] += len(frame), len(found.doc)

    total = _sums(ids.select("ids"), (1 << TERM_BITS) + 2, count)
    return Corpus(int(total[-2]), float(total[-1] / max(1, total[-2])), total[: 1 << TERM_BITS].astype(float))


def top_terms(found: Terms, deal: np.ndarray, corpus: Corpus) -> np.ndarray:
    """The class that weighs most in each document, of those that another one has too (ties: the lower class); a document
    without words gets one by its hash."""
    doc, term, count = distinct(found, len(deal))
    top = deal & ((1 << TERM_BITS) - 1)
    if len(doc):
        weight = np.where(corpus.frequency[term] > 1, corpus.weights(term, count, np.bincount(found.doc, minlength=len(deal))[doc]), 0.0)
        present, starts = np.unique(doc, return_index=True)
        most = np.repeat(np.maximum.reduceat(weight, starts), np.diff(np.append(starts, len(doc))))
        best = np.flatnonzero(weight == most)
        top[present] = term[best[np.unique(doc[best], return_index=True)[1]]]
    return top


def dealt(ids: DataFrame, corpus: Corpus, ends: np.ndarray, dtype: np.dtype, task_tokens: int) -> DataFrame:
    """(doc_id, ids) dealt to tasks of task_tokens on average, in the order of their top terms within each. The classes follow
    each other in the tasks by number; one that fills several tasks is spread over them by the hash of the row, and so
    a task's size does not depend on how often a term or text occurs."""
    spark, width = ids.sparkSession, dtype.itemsize
    sent = spark.sparkContext.broadcast(corpus)
    rows = ids.select("doc_id", "ids", F.xxhash64("doc_id", "ids").alias("deal"))

    def count(frame: pd.DataFrame, total: np.ndarray) -> None:
        top = top_terms(terms(frame["ids"], ends, dtype), frame["deal"].to_numpy().copy(), sent.value)
        np.add.at(total, top, [len(x) // width + 1 for x in frame["ids"]])

    sizes = _sums(rows, 1 << TERM_BITS, count)
    n_tasks = max(1, -(-int(sizes.sum()) // task_tokens))
    before = np.cumsum(sizes) - sizes
    each = max(1.0, sizes.sum() / n_tasks)
    first = np.minimum(before // each, n_tasks - 1).astype(np.int64)
    spread = np.minimum((before + np.maximum(sizes, 1) - 1) // each, n_tasks - 1).astype(np.int64) - first + 1
    places = spark.sparkContext.broadcast((first, spread))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, spread = places.value
        for batch in batches:
            deal = batch.column("deal").to_numpy()
            top = top_terms(terms(batch.column("ids").to_pylist(), ends, dtype), deal.copy(), sent.value)
            task = (first[top] + (deal >> 20) % spread[top]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top), pa.array(task)], [*batch.schema.names, "term", "task"])

    placed = rows.mapInArrow(work, "doc_id long, ids binary, deal long, term long, task int")
    return placed.repartitionById(n_tasks, "task").sortWithinPartitions("term", "deal").select("doc_id", "ids")


class Index:
    """BM25 over the documents of one shard: for each document its terms and weights, and postings by term."""

    def __init__(self, found: Terms, n_docs: int, corpus: Corpus) -> None:
        doc, term, count = distinct(found, n_docs)
        weight = corpus.weights(term, count, np.bincount(found.doc, minlength=n_docs)[doc])
        self.starts = np.searchsorted(doc, np.arange(n_docs + 1))
        self.term, self.weight = term, weight
        order = np.argsort(term * n_docs + doc)  # all differ
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_starts = np.searchsorted(term[order], np.arange((1 << TERM_BITS) + 1))
        self.held = n_docs

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[np.ndarray]:
        """All unused documents that share a term with the seed, best score first (ties: lower place): some BEST of them, then
        the others, which are sorted only if they are asked for. A document that is used once stays so: its postings may go."""
        if 2 * np.count_nonzero(unused) < self.held:
            self._keep(unused)
        asked = self.term[self.starts[seed] : self.starts[seed + 1]]
        first = self.post_starts[asked]
        at = ragged(first, self.post_starts[asked + 1] - first)
        scores = np.bincount(self.post_doc[at], self.post_weight[at], len(unused))
        found = np.flatnonzero((scores > 0) & unused)
        scores = -scores[found]
        if len(found) > 2 * BEST:
            best = scores <= np.partition(scores, BEST)[BEST]
            yield found[best][np.argsort(scores[best], kind="stable")]
            found, scores = found[~best], scores[~best]
        yield found[np.argsort(scores, kind="stable")]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """The same in one array."""
        return np.concatenate(list(self.ranked(seed, unused)))

    def _keep(self, unused: np.ndarray) -> None:
        kept = unused[self.post_doc]
        self.post_starts = np.append(0, np.cumsum(kept))[self.post_starts]
        self.post_doc, self.post_weight, self.held = self.post_doc[kept], self.post_weight[kept], np.count_nonzero(unused)


def plan(lengths: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once."""
    pieces, sequence = [], 0
    done = np.zeros(len(lengths), np.int64)
    for doc in np.flatnonzero(lengths >= WINDOW):
        for _ in range(int(lengths[doc]) // WINDOW):
            pieces.append((int(doc), int(done[doc]), WINDOW, sequence, 0))
            done[doc] += WINDOW
            sequence += 1
    unused = done < lengths
    order = np.lexsort((np.arange(len(lengths)), -(lengths - done)))
    at = 0
    while True:
        while at < len(order) and not unused[order[at]]:
            at += 1
        if at == len(order):
            return pieces
        filled, follow = 0, at
        # the seed, its neighbours, and when none is left the next documents in turn
        queue: Iterator[int] = iter([order[at]])
        asked = False
        while filled < WINDOW:
            doc = int(next(queue, -1))
            if doc < 0:
                if not asked:
                    asked = True
                    queue = chain.from_iterable(index.ranked(int(order[at]), unused))
                    continue
                while follow < len(order) and not unused[order[follow]]:
                    follow += 1
                if follow == len(order):
                    break
                doc = int(order[follow])
            taken = int(min(lengths[doc] - done[doc], WINDOW - filled))
            if not taken:
                continue
            pieces.append((doc, int(done[doc]), taken, sequence, filled))
            done[doc] += taken
            filled += taken
            unused[doc] = done[doc] < lengths[doc]
        sequence += 1


def pack_shard(ids: list[bytes], ends: np.ndarray, dtype: np.dtype, corpus: Corpus) -> pd.DataFrame:
    """row (place in ids), start, length, sequence, offset, ids_crc32 and doc_tokens of each piece."""
    width = dtype.itemsize
    lengths = np.array([len(x) // width + 1 for x in ids], np.int64)
    pieces = plan(lengths, Index(terms(ids, ends, dtype), len(ids), corpus))
    out = pd.DataFrame(pieces, columns=["row", "start", "length", "sequence", "offset"]).astype("int64")
    end = np.array([END], "<u4").tobytes()
    sums = []
    for doc, start, length, _, _ in pieces:
        own = np.frombuffer(ids[doc], dtype)[start : start + length].astype("<u4").tobytes()
        sums.append(zlib.crc32(own if len(own) == 4 * length else own + end))
    out["ids_crc32"] = np.array(sums, np.int64)
    out["doc_tokens"] = lengths[out["row"]]
    return out


def pack(docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one token, the end mark. Rows that repeat a doc_id, or have none, are documents of their
    own, told apart by nothing but their order; other columns are dropped; an empty table gives no pieces. A task takes
    its rows in the order of their top terms and packs a shard whenever it has shard_tokens, so what it holds is
    bounded, and a task that runs again gives the same pieces. Only a shard's last sequence is short. sequence_id holds
    the task's number in its upper bits.
    """
    known = _Chunks(tokenizer_path)
    ends, dtype = known.ends, known.dtype
    del known
    ids = cut(encoded(docs, tokenizer_path), "ids")
    corpus = corpus_statistics(ids, ends, dtype)
    sent = docs.sparkSession.sparkContext.broadcast(corpus)

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = TaskContext.get().partitionId() << 32
        for doc_ids, held in _shards(batches, shard_tokens * dtype.itemsize):
            rows = pack_shard(held, ends, dtype, sent.value)
            rows["sequence_id"] = sequences + rows["sequence"]
            sequences += int(rows["sequence"].max()) + 1
            owner = pa.array(doc_ids, pa.int64()).take(pa.array(rows["row"].to_numpy()))
            yield pa.RecordBatch.from_arrays([owner, *(pa.array(rows[c].to_numpy(np.int64)) for c in names)], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names)
    return dealt(ids, corpus, ends, dtype, task_tokens).mapInArrow(work, schema)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids and ids of one shard after the other, of `most` bytes or little more."""
    doc_ids: list = []
    held: list[bytes] = []
    size = 0
    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            doc_ids.append(doc_id)
            held.append(ids)
            size += len(ids) + 2
            if size >= most:
                yield doc_ids, held
                doc_ids, held, size = [], [], 0
    if doc_ids:
        yield doc_ids, held
