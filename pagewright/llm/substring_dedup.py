"""Substring dedup (op5) by level-wise doubling.

A window of ``window`` words is removed from a document if its words also start in a document with a smaller id. A window
can repeat only if its parts do, so short runs of words are looked for first, and only what repeats at one length is
extended to twice that length, level by level, until the window's length is reached or no candidate survives. Hashes of longer runs are made of those of shorter ones.

Levels below the last. Every candidate window is stood for by the least hash of the runs of the level's length in it (equal windows have equal
ones), so of about thirteen runs one is sent on: a seed. A window whose seed no other document has is no candidate any more.
Last level. The windows that are left are hashed at full length. Of each such hash the document with the smallest id is
its source; the others lose the window's words. Longer windows need no level: their words are covered by those of this length;
``longest_repeats`` goes on doubling until none survives.

At all levels what is equal within a batch is settled there, and only one row of each hash and batch goes on to the
exchange, where sorted runs are read in a stream. So a passage that a third of all documents share is as many rows as
there are batches, and no group is held. Documents with equal words are settled before, by one digest. Windows are told by 128 bits
of hashes in the last level; before it, 64 bits can only let a candidate live too long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small
from .words import LEAD, mix, pair, portions, run_hashes, signed, sliding_min, word_hashes

NOTHING = hashlib.sha256(b"").hexdigest()
PAIRS = "kind int, hash long, more long, doc_id long"
#: The least length of a level, in words.
SHORTEST = 20


def levels(window: int) -> list[int]:
    """Lengths that double, but for rounding, up to the window's."""
    out = [window]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


class Runs:
    """The whole windows of some texts, in order: of which text each is, and hashes of the runs of words in them."""

    def __init__(self, texts: pa.StringArray, window: int) -> None:
        self.window, (self.words, sizes) = window, word_hashes(texts)
        last = np.repeat(np.cumsum(sizes), sizes)[:max(0, len(self.words) - window + 1)]
        self.inside = np.flatnonzero(np.arange(len(last)) + window <= last)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[self.inside]
        self.made: dict[int, np.ndarray] = {}

    def runs(self, length: int) -> np.ndarray:
        """A hash of each run of so many words: of its halves' hashes, if these are a level's."""
        if length not in self.made:
            half = length // 2
            if length % 2 or half < SHORTEST:
                self.made[length] = run_hashes(self.words, length)
            else:
                short = self.runs(half)
                self.made[length] = pair(short[:max(0, len(short) - half)], short[half:])
        return self.made[length]

    def seeds(self, length: int) -> np.ndarray:
        """Of each window, the least hash of its runs of so many words."""
        return signed(sliding_min(self.runs(length), self.window - length + 1)[self.inside])

    def more(self, some: np.ndarray) -> np.ndarray:
        """Another hash of those windows."""
        return signed(run_hashes(mix(self.words + LEAD), self.window)[self.inside[some]])


def _rows(kind: int, hashes: np.ndarray, more: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(hashes), kind, np.int32)), "hash": pa.array(hashes), "more": pa.array(more), "doc_id": pa.array(ids)})


def _settle(hashes: np.ndarray, more: np.ndarray, ids: np.ndarray, both: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Of one batch: the rows that go on (kind 1, the smallest id of each hash), and those that are known to repeat (kind 0).

    ``both``: the smallest id of a repeated hash counts as repeating, too.
    """
    order = np.lexsort((ids, more, hashes))
    hashes, more, ids = hashes[order], more[order], ids[order]
    begins = _begins(hashes, more)
    keep = begins.copy()
    keep[1:] |= ids[1:] != ids[:-1]
    hashes, more, ids, begins = hashes[keep], more[keep], ids[keep], begins[keep]
    later = ids != _lead(ids, begins)
    known = later.copy()
    if both:
        known[:-1] |= later[1:] & begins[:-1]
    return _rows(1, hashes[begins], more[begins], ids[begins]), _rows(0, hashes[known], more[known], ids[known])


def _begins(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    out[1:] = (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])
    return out


def _lead(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The first id of each row's run."""
    return ids[np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))] if len(ids) else ids


def _runs(both: bool):
    """Reads rows sorted by (hash, more, doc_id); gives (kind 0) those that repeat with a smaller id, and if ``both`` the smallest, too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = None  # of the run that the last batch ended with
        told = True
        for batch in batches:
            mine = batch.column(0).to_numpy() == 1
            if not mine.all():
                yield batch.filter(pa.array(~mine))
            hashes, more, ids = (batch.column(i).to_numpy()[mine] for i in (1, 2, 3))
            if not len(hashes):
                continue
            begins = _begins(hashes, more)
            lead = _lead(ids, begins)
            held = (hashes[0], more[0]) == key
            if held:
                size = int(np.flatnonzero(np.append(begins[1:], True))[0]) + 1
                lead[:size] = first
                if both and not told and (ids[:size] != first).any():
                    yield _rows(0, hashes[:1], more[:1], np.array([first]))
                    told = True
            later = ids != lead
            known = later.copy()
            if both:
                where = np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))[later]
                known[where[lead[where] == ids[where]]] = True
            yield _rows(0, hashes[known], more[known], ids[known])
            if not (held and begins.sum() == 1):
                told = bool(later[np.flatnonzero(begins)[-1]:].any())
            key, first = (hashes[-1], more[-1]), lead[-1]

    return run


def substring_dedup(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words. Rows that repeat an id are documents with that id: none of them is a source for another, and
    each is judged by itself. A null id has no place in the order: such a row is no source, and nothing of it is removed. An empty table gives
    an empty result; a very long text is held whole, once. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                found = [x.encode().split() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in found])], names=["doc_id", "n_words", "sha"])

    info = scratch.save(texts.mapInArrow(told, "doc_id long, n_words long, sha string"), "info")
    # Written, so that the join may split a digest that very many documents have.
    first = scratch.save(info.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    marked = info.join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    marked = scratch.save(marked.select("doc_id", "n_words", "sha", "copy"), "marked")
    done = scratch.save(marked.groupBy("doc_id").agg(F.min(F.col("copy") | (F.col("n_words") < window)).alias("done")).where("done and doc_id is not null").select("doc_id"), "done")
    left = texts.where("doc_id is not null").join(small(done), "doc_id", "left_anti")

    alive: DataFrame | None = None
    for length in levels(window):
        last = length == window
        held = left.withColumn("lists", F.lit(None).cast("array<long>")) if alive is None else _beside(texts, alive)
        repeated = _exchange(held.mapInArrow(_level(window, length, alive is None, last), PAIRS)).mapInArrow(_runs(not last), PAIRS)
        alive = scratch.save(repeated.groupBy("doc_id").agg(F.collect_set("hash").alias("lists")), f"alive-{length}")
        if alive.isEmpty():
            break
    gone = alive.withColumnRenamed("lists", "gone")
    ids = scratch.save(gone.select("doc_id"), "ids")
    cut = texts.join(small(ids), "doc_id", "left_semi").join(gone, "doc_id").select("doc_id", "text", "gone")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                whole = Runs(part.column(1), window)
                full, owner = whole.seeds(window), whole.owner
                starts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                lists = part.column(2)
                flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
                rows = []
                for i, (doc_id, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    words = text.encode().split()
                    covered = np.zeros(len(words) + 1, np.int64)
                    hit = np.flatnonzero(np.isin(full[starts[i]:starts[i + 1]], flat[offsets[i]:offsets[i + 1]]))
                    covered[hit] += 1
                    covered[hit + window] -= 1
                    stay = np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()
                    rows.append((doc_id, hashlib.sha256(b" ".join(words)).hexdigest(), len(words) - len(stay), hashlib.sha256(b" ".join([words[k] for k in stay])).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["doc_id", "sha", "removed", "kept"]) if rows else pa.RecordBatch.from_pydict({"doc_id": pa.array([], pa.int64()), "sha": pa.array([], pa.string()), "removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    results = cut.mapInArrow(kept, "doc_id long, sha string, removed long, kept string").dropDuplicates(["doc_id", "sha"])
    out = marked.join(results, ["doc_id", "sha"], "left")
    return out.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
                      F.when(F.col("copy"), F.lit(NOTHING)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def _beside(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, text, lists of the documents that have a list (doc_id, lists); the lists are broadcast if they hold no more than four million hashes, 32 MB."""
    held = lists.agg(F.sum(F.size("lists"))).first()[0] or 0
    return texts.join(F.broadcast(lists) if held <= 4_000_000 else lists, "doc_id").select("doc_id", "text", "lists")


def _level(window: int, length: int, first: bool, last: bool):
    """Seeds of the candidate windows: at first of all, then of those whose seed of half the length is in the document's list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                whole = Runs(part.column(1), window)
                found, owner, there = whole.seeds(length), whole.owner, np.arange(len(whole.owner))
                if not first:
                    lists = part.column(2)
                    known = _tagged(lists.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())))
                    there = np.flatnonzero(np.isin(_tagged(whole.seeds(-(-length // 2)), owner), known))
                if not last:
                    step = np.ones(len(there), bool)  # neighbours mostly have one seed
                    step[1:] = (found[there[1:]] != found[there[:-1]]) | (owner[there[1:]] != owner[there[:-1]])
                    there = there[step]
                more = whole.more(there) if last else np.zeros(len(there), np.int64)
                yield from _settle(found[there], more, part.column(0).to_numpy()[owner[there]], both=not last)

    return run


def _exchange(rows: DataFrame) -> DataFrame:
    return rows.repartition("hash", "more").sortWithinPartitions("hash", "more", "doc_id")


def _tagged(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return hashes ^ ((owner + 1) * np.int64(0x165667B19E3779F9))


def longest_repeats(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, longest: of the lengths window, 2 * window, 4 * window, ... the longest at which a window of the document is in another, too.

    Documents without a repeated window have no row. A window of twice the length goes on only if both its halves repeat; the
    rounds end when none does. Rows without an id are left out; rows that repeat an id are one document.
    """
    scratch = Scratch(docs.sparkSession, "longest")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found, length, rounds = None, window, []
    while True:
        held = texts.withColumn("lists", F.lit(None).cast("array<long>")) if found is None else _beside(texts, found)
        repeated = _exchange(held.mapInArrow(_doubling(length, found is None), PAIRS)).mapInArrow(_runs(True), PAIRS)
        found = scratch.save(repeated.groupBy("doc_id").agg(F.collect_set("hash").alias("lists")), f"round-{length}")
        if found.isEmpty():
            break
        rounds.append(found.select("doc_id", F.lit(length).alias("length")))
        length *= 2
    if not rounds:
        return found.select("doc_id", F.lit(0).alias("longest"))
    whole = rounds[0]
    for one in rounds[1:]:
        whole = whole.unionByName(one)
    return whole.groupBy("doc_id").agg(F.max("length").alias("longest"))


def _doubling(length: int, first: bool):
    """Hashes of the windows of ``length`` words: all of them at first, then those of which both halves are in the document's list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                words, sizes = word_hashes(part.column(1))
                owner, last = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
                full = run_hashes(words, length)
                there = np.flatnonzero(np.arange(len(full)) + length <= last[:len(full)])
                if not first:
                    lists = part.column(2)
                    known = _tagged(lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), np.diff(lists.offsets.to_numpy())))
                    half = run_hashes(words, length // 2)
                    repeats = np.isin(_tagged(signed(half), owner[:len(half)]), known)
                    there = there[repeats[there] & repeats[there + length // 2]]
                more = signed(run_hashes(mix(words + LEAD), length)[there])
                yield from _settle(signed(full[there]), more, part.column(0).to_numpy()[owner[there]], both=True)

    return run
