"""Hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LEAD = np.uint64(0x165667B19E3779F9)
PLACES = 64


def portions(batch: pa.RecordBatch, column: int = 1, rows: int = 1000, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and, but for a single longer text, so many bytes of text."""
    texts = batch.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, min(low + rows, int(np.searchsorted(ends, int(ends[low]) + size, "right")) - 1))
        yield batch.slice(low, high - low)
        low = high


def fresh() -> None:
    """Gives back what earlier tasks have left unused in Arrow's pool: a Python worker serves task after task, of other operators, too."""
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mix(mix(x + LEAD) + y)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
TABLE = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * M2)


def word_hashes(texts: pa.StringArray, *, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the texts, in order, and each text's number of words. ``fold``: A-Z count as a-z."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets -= offsets[0]
    word = ~SPACE[raw]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[begins] = word[begins]
    starts = np.flatnonzero(opens)
    count = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.diff(count)
    raw = FOLDED[raw] if fold else raw
    spans = np.diff(starts, append=size)
    place = np.arange(starts[0], size, dtype=np.int64) - np.repeat(starts, spans)
    tail = raw[starts[0]:].astype(np.int64)
    terms = TABLE[np.minimum(place, PLACES - 1) * 256 + tail]
    late = np.flatnonzero(place >= PLACES)
    terms[late] = mix((place[late] * 256 + tail[late]).astype(np.uint64) * M2 + LEAD)
    terms[~word[starts[0]:]] = 0
    return mix(np.add.reduceat(terms, starts - starts[0])), np.diff(count)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words, by doubling: a run of 2n words is two runs of n."""
    whole, at, power, step = None, 0, words, 1
    while True:
        if length & step:
            part = power[at:]
            if whole is None:
                whole = part
            else:
                n = min(len(whole), len(part))
                whole = pair(whole[:n], part[:n])
            at += step
        if step * 2 > length:
            return whole[:max(0, len(words) - length + 1)]
        power = pair(power[:max(0, len(power) - step)], power[step:])
        step *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:max(0, len(values) - step)], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:max(0, len(values) - rest)], values[rest:]) if rest else values


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
