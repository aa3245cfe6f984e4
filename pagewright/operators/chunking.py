"""Packing of paragraphs into chunks of bounded length: next fit, in order, with items that are too long alone in a chunk."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 1000
#: A document's items are dealt by so many of the values of ``order``.
BLOCK = 1 << 16


class State(NamedTuple):
    """The chunk that is open, or comes next; the length that it holds, -1 if none is open; its lines so far."""

    chunk: int = 0
    held: int = -1
    line: int = 0


def pack_chunks(items: DataFrame, doc: Sequence[str], order: str, length: str, *, most: int = MOST, block: int = BLOCK, orders: DataFrame | None = None) -> DataFrame:
    """The rows of ``items`` with ``chunk_idx`` (from 0, by document) and ``line_no`` (from 0, by chunk). ``order``: whole numbers from 0. A null length counts as 0.

    Whether an item fits depends on what the open chunk already holds, so no window function can tell. From sums of lengths follows, for each item, where the
    next chunk begins if one begins there; the chunks of a run of items are what that leads to from its first. A document is dealt over tasks in blocks. A
    block but the first is gone through for every length that may be held when it begins, which costs little more than once, since their chunks soon begin at the
    same places; then the blocks of a document are chained, and each gets its own beginning. ``orders``: a table that has ``doc`` and ``order`` of all items, and maybe of more, at less cost.
    """
    added = [T.StructField("chunk_idx", T.IntegerType()), T.StructField("line_no", T.IntegerType())]
    key, state, own = [*doc, "_block"], ["_chunk", "_held", "_line"], [c for c in items.columns if c not in doc]
    of = F.floor(F.col(order) / block).cast("long").alias("_block")
    dealt = items.select("*", of)
    rows = dealt.select(*key, *(F.lit(None).cast("int").alias(c) for c in state), *own)
    if not (items if orders is None else orders).where(of != 0).isEmpty():
        begun = _begun(dealt, doc, order, length, most)
        rows = rows.unionByName(begun.select(*key, *state, *(F.lit(None).cast(items.schema[c].dataType).alias(c) for c in own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, segments, sizes in _segments(batches, len(key), length):
            chunks, lines = np.empty(len(sizes), np.int32), np.empty(len(sizes), np.int32)
            sums, following = _following(sizes, segments, most)
            for x in segments:
                begins = _begins(sums, following, x.low, x.high, x.state.held, most)
                goes_on = not len(begins) or begins[0] > x.low
                starts = np.concatenate([[x.low], begins]).astype(np.int64) if goes_on else begins
                place = np.repeat(np.arange(len(starts)), np.diff(starts, append=x.high))
                chunks[x.low:x.high] = x.state.chunk + place + (not goes_on and x.state.held >= 0)
                if goes_on:
                    starts[0] -= x.state.line
                lines[x.low:x.high] = np.arange(x.low, x.high) - starts[place]
                x.last = _after(x.state, begins, sums, x.low, x.high, most)
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_block" and name not in state]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(chunks), pa.array(lines)], names=[*doc, *own, "chunk_idx", "line_no"])

    fields = [items.schema[c] for c in (*doc, *own)]
    packed = rows.repartition(*key).sortWithinPartitions(*key, F.col("_chunk").isNull(), order).mapInArrow(run, T.StructType([*fields, *added]))
    return packed.select(*items.columns, "chunk_idx", "line_no")


class Segment:
    """Rows ``low`` to ``high`` of a batch that are of one document and block; how they begin, and end."""

    def __init__(self, low: int, high: int, state: State) -> None:
        self.low, self.high, self.state, self.last = low, high, state, state


def _segments(batches: Iterator[pa.RecordBatch], keys: int, length: str) -> Iterator[tuple[pa.RecordBatch, bool, list[Segment], np.ndarray]]:
    """Of batches sorted by their first columns, the keys: each, whether it goes on with the last segment before, its segments and lengths.

    A segment that goes on begins as the one before ended; another as the row says that stands before its first, if there is one. Such rows are left out.
    """
    before, last, told = None, State(), {}
    for batch in batches:
        if "_chunk" in batch.schema.names and batch.column(keys).null_count < batch.num_rows:
            tells = batch.column(keys).is_valid()
            some = batch.filter(tells)
            told |= {tuple(c[i].as_py() for c in some.columns[:keys]): State(*(c[i].as_py() for c in some.columns[keys:keys + 3])) for i in range(some.num_rows)}
            batch = batch.filter(pc.invert(tells))
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:keys]:
            code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        named = lambda at: tuple(column[at].as_py() for column in batch.columns[:keys])  # noqa: B023, E731
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        goes_on = named(0) == before
        segments = [Segment(a, b, last if a == 0 and goes_on else told.pop(named(a), State()) if told else State()) for a, b in zip(starts, starts[1:])]
        yield batch, goes_on, segments, batch.column(batch.schema.get_field_index(length)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        before, last = named(batch.num_rows - 1), segments[-1].last


def _following(sizes: np.ndarray, segments: list[Segment], most: int) -> tuple[list[int], list[int]]:
    """Sums of lengths before each item and at the end; and where the next chunk begins if one begins at the item: at the first that no longer fits, at the segment's end at last."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    stop = np.repeat([s.high for s in segments], [s.high - s.low for s in segments])
    fits = np.searchsorted(sums, sums[:-1] + most, "right") - 1
    return sums.tolist(), np.minimum(np.maximum(fits, np.arange(len(sizes)) + 1), stop).tolist()


def _begins(sums: list[int], following: list[int], low: int, high: int, held: int, most: int) -> np.ndarray:
    """Where chunks begin in a segment that begins with a chunk that holds so much."""
    at = low if held < 0 else min(bisect_right(sums, sums[low] + most - held, low, high + 1) - 1, high)
    found = []
    while at < high:
        found.append(at)
        at = following[at]
    return np.array(found, np.int64)


def _after(state: State, begins: np.ndarray, sums: list[int], low: int, high: int, most: int) -> State:
    """The state after a segment."""
    if not len(begins):
        return State(state.chunk, state.held + sums[high] - sums[low], state.line + high - low)
    at = int(begins[-1])
    chunk, held = state.chunk + len(begins) - (state.held < 0), sums[high] - sums[at]
    return State(chunk + 1) if held > most else State(chunk, held, high - at)


def _begun(dealt: DataFrame, doc: Sequence[str], order: str, length: str, most: int) -> DataFrame:
    """``doc``, _block, _chunk, _held, _line: how each block of the documents that have more than one begins."""
    key = [*doc, "_block"]
    rows = dealt.select(*key, order, length)
    long = rows.where("_block <> 0").select(*(F.col(c).alias(f"_{c}") for c in doc)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in doc]
    fields = [dealt.schema[c] for c in key] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("_chunk", "_held", "_line")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: Ends | None = None
        for batch, goes_on, segments, sizes in _segments(batches, len(key), length):
            sums, following = _following(sizes, segments, most)
            for i, x in enumerate(segments):
                if i or not goes_on:
                    if ends is not None:
                        yield ends.row()
                    ends = Ends([batch.column(j)[x.low:x.low + 1] for j in range(len(key))], key, most)
                ends.add(sums, following, x.low, x.high)
        if ends is not None:
            yield ends.row()

    passed = rows.join(long, same, "left_semi").repartition(*key).sortWithinPartitions(*key, order).mapInArrow(run, T.StructType(fields))

    def chained(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, state, out = blocks.sort_values("_block"), State(), []
        for chunk, held, line in zip(blocks["_chunk"], blocks["_held"], blocks["_line"], strict=True):
            out.append(state)
            at = state.held + 1
            state = State(state.chunk + int(chunk[at]), int(held[at]), int(line[at]) if line[at] >= 0 else state.line - int(line[at]) - 1)
        return blocks[key].assign(_chunk=[s.chunk for s in out], _held=[s.held for s in out], _line=[s.line for s in out])

    kept = T.StructType([dealt.schema[c] for c in key] + [T.StructField(c, T.IntegerType()) for c in ("_chunk", "_held", "_line")])
    return passed.groupBy(*doc).applyInPandas(chained, kept)


class Ends:
    """How a block ends for each length, from -1 (none is open) to ``most``, that it may begin with: chunks passed, length held, lines (below 0: those of its beginning and so many more, less 1)."""

    def __init__(self, key: list[pa.Array], names: list[str], most: int) -> None:
        self.key, self.names, self.most = key, names, most
        self.states = [State(0, h, -1) for h in range(-1, most + 1)]

    def add(self, sums: list[int], following: list[int], low: int, high: int) -> None:
        """Goes on with a segment; states that are the same in length go on together, and chunks that begin at one place end alike."""
        by_first: dict[int, tuple[int, int, int]] = {}  # where the first chunk begins: chunks, length held, lines
        known: dict[int, tuple[int, int, int]] = {high: (0, -1, 0)}

        def from_first(at: int) -> tuple[int, int, int]:
            path = []
            while at not in known:
                path.append(at)
                at = following[at]
            for x in reversed(path):
                count, held, line = known[following[x]]
                if following[x] == high:
                    held = sums[high] - sums[x]
                    known[x] = (1, -1, 0) if held > self.most else (0, held, high - x)
                else:
                    known[x] = (count + 1, held, line)
            return known[path[0]] if path else known[at]

        out = []
        for state in self.states:
            first = low if state.held < 0 else min(bisect_right(sums, sums[low] + self.most - state.held, low, high + 1) - 1, high)
            if first == high:
                out.append(State(state.chunk, state.held + sums[high] - sums[low], state.line - (high - low) if state.line < 0 else state.line + high - low))
                continue
            if first not in by_first:
                by_first[first] = from_first(first)
            count, held, line = by_first[first]
            out.append(State(state.chunk + count + (state.held >= 0), held, line))
        self.states = out

    def row(self) -> pa.RecordBatch:
        lists = [pa.array([[s[i] for s in self.states]], pa.list_(pa.int64())) for i in range(3)]
        return pa.RecordBatch.from_arrays([*self.key, *lists], names=[*self.names, "_chunk", "_held", "_line"])


def chunk_sizes(chunks: DataFrame, doc: Sequence[str], length: str) -> DataFrame:
    return chunks.groupBy(*doc, "chunk_idx").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(length).cast("long").alias("n_chars"))
