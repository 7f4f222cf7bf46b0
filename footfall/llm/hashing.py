"""Words of many texts at once: where they lie in the joined bytes, and a hash of each."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text, or tokens, that are worked on at once.
PIECE = 1 << 20
_FACTOR = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def _first_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(PIECE + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _FACTOR, np.uint64)), np.cumprod(np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64))


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[first:last], in order and apart; equal runs have equal hashes wherever they are.
    Only about PIECE values, or one run, are worked on at once."""
    if len(values) > PIECE and len(first) > 1:
        parts, at = [], 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(last, first[at] + PIECE, side="right")))
            parts.append(run_hashes(values[first[at] : last[to - 1]], first[at:to] - first[at], last[at:to] - first[at]))
            at = to
        return np.concatenate(parts)
    powers, inverse = _first_powers() if len(values) <= PIECE else _powers(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)], out=sums[1:])
    hashed = (sums[last] - sums[first]) * inverse[first]
    hashed ^= hashed >> np.uint64(31)
    return hashed * MIX


#: White space to the tokenizer beyond ASCII, as the number that its UTF-8 bytes, and a zero byte after two, make up.
WIDE_SPACES = np.array([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))])
_LEADS = np.isin(np.arange(256), WIDE_SPACES >> 16)


def text_runs(texts: Sequence[object], most: int = 4 * PIECE) -> Iterator[list[str]]:
    """The texts in order, null ones empty, in runs of about `most` characters."""
    part, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def pieces(texts: Sequence[str], most: int = PIECE) -> Iterator[tuple[np.ndarray, bytes]]:
    """The joined UTF-8 of runs of texts, each of about `most` bytes, and where each text ends in it."""
    start = 0
    while start < len(texts):
        stop, size, part = start, 0, []
        while stop < len(texts) and (not part or size + len(texts[stop]) < most):
            part.append(texts[stop].encode("utf-8", "replace"))
            size += len(part[-1]) + 1
            stop += 1
        yield np.cumsum([len(x) + 1 for x in part]), b"\n".join([*part, b""])
        start = stop


def split_words(data: bytes, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, and first and last place of each word between white space: that of ASCII, or, if wide,
    that of a tokenizer too, which is then made ASCII."""
    low = np.frombuffer(data, np.uint8)
    low = low + 32 * ((low >= 65) & (low <= 90)).view(np.uint8)
    if wide and not data.isascii():
        lead = np.flatnonzero(_LEADS[low])
        number = sum(np.append(low, (0, 0))[lead + i].astype(np.int64) << (16 - 8 * i) for i in range(3))
        for width, same in ((2, np.where(number >> 16 == 0xC2, number & 0xFFFF00, 0)), (3, number)):
            for at in lead[np.isin(same, WIDE_SPACES)]:
                low[at : at + width] = 32
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.flatnonzero(np.concatenate([inside[:1], inside[1:] != inside[:-1], inside[-1:]]))
    return low, edge[0::2], edge[1::2]


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of every word `[^\\x20\\x09-\\x0D]+` of the texts, with A-Z lower-cased, in order. A null
    text has none."""
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    start = 0
    for ends, data in pieces([t if isinstance(t, str) else "" for t in texts]):
        low, first, last = split_words(data)
        hashes.append(run_hashes(low, first, last))
        places.append(start + np.searchsorted(ends, first, side="right"))
        start += len(ends)
    return np.concatenate(places), np.concatenate(hashes)
