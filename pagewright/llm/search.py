"""Ranked lexical search (op13) on a two-level quantised index.

The index is parted by documents: each row is a segment of some documents with their postings, term by term. Its first level has a
posting's impact, what it adds to a score for each unit of a term's weight, rounded up to a multiple of ``STEP`` and kept in
a byte; its second has the counts that the impact is exactly worked out from. A search adds bytes times weights: as many steps bound a document's score from above, and a
step less for each posting from below. Every document whose upper bound reaches the k-th lower bound of its
task so far is scored again in exact integers, so no document of the k best is lost; a task sends on its k best of each query.

No posting leaves its segment: segments are made and searched where their documents are, so frequent terms and
hot sources move no rows. What is shuffled are each segment's document frequencies, combined first, and the tasks' best.
Queries are taken in blocks of a bounded size, each of which is sent with the tasks and reads the index once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import quoted
from .scratch import Scratch
from .words import portions, signed, word_hashes

#: Fixed values of the score: a document's length counts so much of 100, and impacts are of a million.
LENGTH, OF, MILLION = 75, 100, 1_000_000
#: An impact's byte is so much of it, rounded up: the largest, a million, is 255.
STEP = -(-MILLION // 255)
#: An index of the terms of given queries holds only these, if they are no more than so many.
VOCABULARY = 1_000_000
#: Weights and queries that are sent with the tasks at once, about.
WEIGHTS, QUERIES = 200_000, 1000
SEGMENT = "doc_ids array<long>, sizes binary, terms binary, counts binary, places binary, impacts binary, tfs binary"
#: Bytes of a term as they are, but for A-Z; all others part terms.
BYTES = np.full(256, 32, np.uint8)
for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    BYTES[low:high] = np.arange(low, high)
BYTES[0x41:0x5B] += 32


class Index(NamedTuple):
    """``segments``: SEGMENT, a written table. ``terms``: those that it holds, by hash and sorted; None: all."""

    segments: DataFrame
    n_docs: int
    n_terms: int
    terms: np.ndarray | None


def _blanked(texts: pa.StringArray) -> pa.StringArray:
    """The texts with spaces for what parts terms, A-Z lower-cased."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(BYTES[raw]))


def _sizes(texts: pa.StringArray) -> tuple[int, int]:
    """How many of the texts have a term, and how many terms all have."""
    blank = _blanked(texts)
    offsets = np.frombuffer(blank.buffers()[1], np.int32)
    inside = np.frombuffer(blank.buffers()[2], np.uint8) != 32
    if not inside.any():
        return 0, 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[begins] = inside[begins]
    return int((np.add.reduceat(opens, begins, dtype=np.int64) > 0).sum()), int(opens.sum())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))


def build_index(docs: DataFrame, *, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of all rows of ``docs``; ``terms`` (sorted hashes): of these terms only, the statistics are still of all.

    Terms are maximal runs of digits, ASCII letters and characters beyond ASCII, of which only A-Z are lower-cased, told by 64-bit hashes. Null and empty texts and those without terms
    are in no segment. Rows that repeat an id are documents of their own, a null id stays null. An empty table gives an
    empty index; a very long text is held whole, in a segment of its own. Other columns are ignored, whatever their names. The texts are read twice: impacts need the mean length.
    """
    rows, scratch = _rows(docs, id_col, text_col), Scratch(docs.sparkSession, "search-index")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_sizes(part.column(0)) for batch in batches for part in portions(batch, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x[i] for x in found)], pa.int64()) for i in (0, 1)], names=["docs", "terms"])

    n_docs, n_terms = (x or 0 for x in rows.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first())

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                yield _segment(part.column(0), part.column(1), terms, n_docs, n_terms)

    return Index(scratch.save(rows.mapInArrow(segments, SEGMENT), "segments"), n_docs, n_terms, terms)


def _lengths(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length adds below its impacts: of Python's integers, which do not overflow."""
    return np.array([OF - LENGTH + LENGTH * n * n_docs // n_terms for n in sizes.tolist()], np.int64)


def _impacts(tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return 1000 * MILLION * tf // (1000 * tf + 8 * lengths)


def _segment(ids: pa.Array, texts: pa.StringArray, terms: np.ndarray | None, n_docs: int, n_terms: int) -> pa.RecordBatch:
    hashes, sizes = word_hashes(_blanked(texts))
    hashes, some = signed(hashes), np.flatnonzero(sizes)
    ids, sizes = ids.take(pa.array(some)), sizes[some]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if terms is None:
        names, code = np.unique(hashes, return_inverse=True)
    else:
        names, code = terms, np.searchsorted(terms, hashes)
        there = np.append(terms, 0)[code] == hashes if len(terms) else np.zeros(len(hashes), bool)
        there &= code < len(terms)
        code, owner = code[there], owner[there]
    keys, tf = np.unique(code * max(1, len(sizes)) + owner, return_counts=True)
    code, place = np.divmod(keys, max(1, len(sizes)))
    present, counts = np.unique(code, return_counts=True)
    impacts = _impacts(tf, _lengths(sizes, n_docs, n_terms)[place])
    columns = [sizes.astype("<i8"), names[present].astype("<i8"), counts.astype("<i4"), place.astype("<u2"), (-(-impacts // STEP)).astype("u1"), tf.astype("<i4")]
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([lists, *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=[x.split()[0] for x in SEGMENT.split(", ")])


def _asked(queries: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """query, item_id, term, times of the distinct terms of each query, as a written table. Each row is a query of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 2):
                hashes, sizes = word_hashes(_blanked(part.column(2)))
                keys, times = np.unique(np.stack([np.repeat(np.arange(len(sizes)), sizes), signed(hashes)], axis=1), axis=0, return_counts=True)
                at = pa.array(keys[:, 0])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(keys[:, 1]), pa.array(times.astype(np.int64))], names=["query", "item_id", "term", "times"])

    numbered = scratch.save(_rows(queries, id_col, text_col).withColumn("query", F.monotonically_increasing_id()), "queries")
    return scratch.save(numbered.select("query", "id", "text").mapInArrow(run, "query long, item_id long, term long, times long"), "asked")


def search(index: Index, queries: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each row of ``queries``, of those whose score is above 0; equal scores by ascending doc_id, null last.

    With N documents with terms, L terms in all, df documents with a term, and tf times it in a document of n terms: its weight is floor(1000 ln((2 N + 2) / (2 df + 1))), and a
    query's score is the sum, over its terms with repeats, of weight * (10^9 tf div (1000 tf + 8 m)), m = 25 + 75 n N div L.

    A query without terms, or none of whose terms occurs, has no rows. Rows of ``queries`` that repeat an id are queries of their own, and a null id stays null. An empty table gives an
    empty result; very long queries are held whole. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(queries.sparkSession, "search")
    return _search(index, _asked(queries, scratch, id_col, text_col), k, scratch)


def search_documents(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """``search`` of ``queries`` in an index of ``docs`` that is made for them: it holds only their terms, if these are not too many to be sent with the tasks."""
    scratch = Scratch(docs.sparkSession, "search")
    asked = _asked(queries, scratch, query_id, query_text)
    wanted = scratch.save(asked.select("term").distinct(), "terms")
    terms = np.sort(np.array([r[0] for r in wanted.collect()], np.int64)) if wanted.count() <= VOCABULARY else None
    return _search(build_index(docs, terms=terms, id_col=id_col, text_col=text_col), asked, k, scratch)


def _frequencies(segments: DataFrame) -> DataFrame:
    """term, df over all segments; a task adds up its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = (np.frombuffer(b"".join(batch.column(i).to_pylist()), kind) for i, kind in ((0, "<i8"), (1, "<i4")))
            names, code = np.unique(terms, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(code, counts, len(names)).astype(np.int64))], names=["term", "df"])

    return segments.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _search(index: Index, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    if index.terms is not None and not asked.isEmpty():
        held = index.segments.sparkSession.createDataFrame(pa.table({"term": index.terms}))
        if not asked.join(held, "term", "left_anti").isEmpty():
            raise ValueError("the index does not hold all terms of the queries")
    weighed = scratch.save(asked.join(_frequencies(index.segments), "term"), "weighed")
    blocks = max(math.ceil(weighed.count() / WEIGHTS), math.ceil(asked.select("query").distinct().count() / QUERIES), 1)
    best = None
    for block in range(blocks):
        rows = weighed.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "term", "times", "df").toArrow()
        found = index.segments.mapInArrow(_searching(Block(rows, index.n_docs), index, k), "query long, doc_id long, score long")
        found = scratch.save(_best(found.withColumn("part", F.spark_partition_id() % 64), ["query", "part"], k), f"best-{block}")
        best = found if best is None else best.unionByName(found)
    ranked = _best(best, ["query"], k)
    items = asked.select("query", "item_id").distinct()
    return ranked.join(items, "query").select("item_id", "rank", "doc_id", "score")


def _best(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


class Block:
    """Some queries: which terms each has, with weights times how often it asks them. Queries and terms are numbered; ``keys`` are pairs of their numbers."""

    def __init__(self, rows: pa.Table, n_docs: int) -> None:
        query, term, times, df = (rows.column(i).to_numpy() for i in range(4))
        self.queries, number = np.unique(query, return_inverse=True)
        self.terms, code = np.unique(term, return_inverse=True)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64) * times
        order = np.lexsort((code, number))
        self.keys, self.weights = (number * len(self.terms) + code)[order], weight[order]
        order = np.lexsort((number, code))
        starts = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
        #: For each term the queries that ask it, and with what weights.
        self.askers = [(number[order[a:b]], weight[order[a:b]]) for a, b in zip(starts, starts[1:])]

    def bounds(self, terms: list[tuple[int, np.ndarray, np.ndarray]], docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each query's score of each document, from the bytes of each term's postings (its number, places, impacts)."""
        steps, weights = (np.zeros((len(self.queries), docs), np.int64) for _ in range(2))
        for code, places, impacts in terms:
            queries, weight = self.askers[code]
            at = queries[:, None], places[None, :]
            steps[at] += weight[:, None] * impacts[None, :].astype(np.int64)
            weights[at] += weight[:, None]
        return STEP * (steps - weights) + weights, STEP * steps

    def exact(self, query: np.ndarray, doc: np.ndarray, postings: tuple[np.ndarray, ...], lengths: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a document, from the postings (number of a term, place, tf)."""
        code, place, tf = postings
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(lengths) + 1))
        many = starts[doc + 1] - starts[doc]
        owner = np.repeat(np.arange(len(doc)), many)
        mine = order[np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[doc], many)]
        key = query[owner] * len(self.terms) + code[mine]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        asked = self.keys[at] == key
        owner, mine, at = owner[asked], mine[asked], at[asked]
        scores = np.zeros(len(doc), np.int64)
        np.add.at(scores, owner, self.weights[at] * _impacts(tf[mine], lengths[place[mine]]))
        return scores


class Best:
    """The k best of each query so far: lower bounds, and the exact scores with their documents."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.lows = k, np.zeros((queries, k), np.int64)
        self.rows = np.zeros((0, 4), np.int64)  # query, score, whether the id is null, id

    def reach(self, lows: np.ndarray) -> np.ndarray:
        """Each query's k-th lower bound, with these added; 0 while there are fewer."""
        both = np.concatenate([self.lows, lows], axis=1)
        self.lows = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:]
        return self.lows.min(axis=1)

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate([self.rows, rows[rows[:, 1] > 0]])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[np.arange(len(rows)) - starts < self.k]


def _searching(block: Block, index: Index, k: int):
    n_docs, n_terms = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.queries), k)
        for batch in batches:
            for at in range(batch.num_rows if len(block.queries) else 0):
                ids = batch.column(0)[at].values
                kinds = "<i8", "<i8", "<i4", "<u2", "u1", "<i4"
                sizes, terms, counts, places, impacts, tfs = (np.frombuffer(batch.column(i)[at].as_buffer(), kind) for i, kind in enumerate(kinds, 1))
                if not len(terms):
                    continue
                code = np.searchsorted(block.terms, terms)
                asked = np.append(block.terms, 0)[code] == terms
                asked &= code < len(block.terms)
                ends = np.cumsum(counts)
                some = [(int(code[i]), places[ends[i] - counts[i]:ends[i]], impacts[ends[i] - counts[i]:ends[i]]) for i in np.flatnonzero(asked)]
                lows, highs = block.bounds(some, len(sizes))
                query, doc = np.nonzero(highs >= np.maximum(best.reach(lows), 1)[:, None])
                if not len(query):
                    continue
                mine = np.repeat(asked, counts)
                postings = np.repeat(code, counts)[mine], places[mine].astype(np.int64), tfs[mine].astype(np.int64)
                scores = block.exact(query, doc, postings, _lengths(sizes, n_docs, n_terms))
                best.add(np.stack([query, scores, np.array(ids.is_null())[doc], ids.fill_null(0).to_numpy()[doc]], axis=1))
        query, score, null, doc = best.rows.T
        yield pa.RecordBatch.from_arrays([pa.array(block.queries[query] if len(query) else query), pa.array(doc, mask=null > 0), pa.array(score)], names=["query", "doc_id", "score"])

    return run
