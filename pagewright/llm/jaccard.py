"""N-gram Jaccard join (op7) by T-occurrence search with DivideSkip. Exact: no link is lost, whatever the sizes.

Candidates. Sets x and y with similarity s or more differ in at most H = (1 - s) / (1 + s) * (|x| + |y|) shingles. Both have a size window in
common. Shingles are dealt by hash over the window's slices, about one for each ``DIFFERENCES`` that H allows, so in one slice at least they differ in
no more than H / slices; that slice is dealt over parts, a few more than that, so at least T = parts - H / slices of its parts agree. This is a T-occurrence problem
whose lists are the documents with a part in common: the T - 1 weakest parts of a slice (those of the fewest shingles, which many documents share) are
set aside, and one of the others agrees at least. Each of these is a signature, in the exchange with a parity bitmap of its
slice (64 bits; two bitmaps never differ in more bits than the slices do in shingles). Documents with a common signature whose bitmaps allow
for enough similarity are chained, each to any other; of those that are equal in signature, bitmap and size, one of each batch of texts stands for all in the
exchange. The connected components of the chains are the blocks to search.

Search. Documents with equal sets are one class, represented once. A block is dealt over chunks of at most ``chunk`` classes. In a chunk,
each class in turn is a query against the inverted lists: its longest lists are set aside,
the short ones are merged by a heap, and what occurs in enough of them is probed in the long lists by binary
search until the needed overlap T is reached or out of reach. Classes that are already connected are
not searched again, so a clump of near copies costs about one query, not all pairs. Every chunk also holds the block's first class.
For a block of several chunks, each class that is still outside its largest component is then queried against the chunks where it has
a candidate. Components of the links found are exact; no pairs are emitted but a spanning forest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .components import components
from .linking import Groups
from .scratch import Scratch, small
from .words import LEAD, M1, M2, fresh, mix, portions, run_hashes, signed, word_hashes

def shingle_sets(texts: pa.StringArray, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``k`` words; with fewer words, of all of them as one."""
    words, sizes = word_hashes(texts, fold=True)
    ends = np.cumsum(sizes)
    rolled = run_hashes(words, k)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        if size >= k:
            out.append(np.unique(rolled[end - size:end - k + 1]))
        elif size:
            whole = np.full(1, size, np.uint64)
            for word in words[end - size:end]:
                whole = mix(whole + word + LEAD)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Shingles that two similar sets may differ in within a slice, about.
DIFFERENCES = 15
#: kind 0: the other half of a document's digest in key, its class in node, its id and the size of its set in x and y; 1: a signature, a class, the bitmap of its slice, the size of its set and the number of slices; 2: linked classes.
ROWS = "kind int, key long, node long, x long, y long"
#: Bits of a size in y.
SIZE = 40


def _rows(kind: int, key: np.ndarray, node: np.ndarray, x=None, y=None) -> pa.RecordBatch:
    whole = lambda v: pa.nulls(len(key), pa.int64()) if v is None else v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), *map(whole, (np.asarray(key, np.int64), np.asarray(node, np.int64), x, y))], names=["kind", "key", "node", "x", "y"])


class Windows:
    """Windows of sizes that overlap, so that any two sizes that similar sets can have are in one together; and how each deals shingles."""

    def __init__(self, s: Fraction) -> None:
        self.s, self.low, self.high, self.slices, self.parts = s, [1], [], [], []

    def differ(self, total):
        """The most shingles in which two similar sets of so many shingles together differ."""
        return total * (self.s.denominator - self.s.numerator) // (self.s.denominator + self.s.numerator)

    def upto(self, size: int) -> None:
        while self.low[-1] <= size:
            high = max(self.low[-1], math.floor(self.low[-1] * (5 - 4 * self.s)), math.floor(self.low[-1] / self.s))
            most = self.differ(2 * high)
            slices = -(-(most + 1) // DIFFERENCES)
            least = most // slices + 1
            self.high.append(high)
            self.slices.append(slices)
            self.parts.append(least + least // 5)
            self.low.append(math.ceil(self.s * (high + 1)))  # a smaller set's partners are all in the window before


def signatures(sets: list[np.ndarray], windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each signature of each set: the set's place, the signature, its slice's bitmap, and the set's size with the number of slices."""
    sizes = np.array([len(x) for x in sets], np.int64)
    windows.upto(int(sizes.max(initial=0)))
    low, high, slices, parts = (np.array(x, np.int64) for x in (windows.low, windows.high, windows.slices, windows.parts))
    first = np.searchsorted(high, sizes, "left")
    times = np.where(sizes > 0, np.searchsorted(low, sizes, "right") - first, 0)
    owner = np.repeat(np.arange(len(sets)), times)  # from here on, one row for each set and window
    window = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times - first, times)
    count, dealt, per = sizes[owner], slices[window], parts[window]
    slots = dealt * per
    slot_at, slice_at = np.cumsum(slots) - slots, np.cumsum(dealt) - dealt
    # a token of each row
    row = np.repeat(np.arange(len(owner)), count)
    begins = np.cumsum(sizes) - sizes
    at = np.arange(len(row)) + np.repeat(begins[owner] - np.cumsum(count) + count, count)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    token = items[at]
    place = ((token >> np.uint64(20)) % slots[row].astype(np.uint64)).astype(np.int64)
    slot, piece = slot_at[row] + place, slice_at[row] + place // per[row]
    sums = np.zeros(int(slots.sum()), np.uint64)
    np.add.at(sums, slot, mix(items ^ M1)[at])
    held = np.bincount(slot, minlength=len(sums))
    odd = np.bincount(piece * 64 + (token & np.uint64(63)).astype(np.int64), minlength=64 * int(dealt.sum())) & 1
    bitmaps = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    # a slot of each row: the strongest of each slice are its signatures
    row = np.repeat(np.arange(len(owner)), slots)
    place = np.arange(len(row)) - slot_at[row]
    piece = slice_at[row] + place // per[row]
    keys = mix(sums + mix((window[row] << 40).astype(np.uint64) + place.astype(np.uint64) + M2))
    order = np.lexsort((keys, -held, piece))
    row = row[order]
    rank = (np.arange(len(row)) - slot_at[row]) % per[row]
    needed = windows.differ(count + np.minimum(high[window], count * windows.s.denominator // windows.s.numerator)) // dealt + 1
    kept = rank < needed[row]
    order, row = order[kept], row[kept]
    return owner[row], signed(keys[order]), bitmaps[piece[order]], count[row] | dealt[row] << SIZE


#: Pairs of rows that are compared at once.
PAIRS = 1 << 20


class Agree:
    """Whether rows a and b, which have a signature in common, may be of similar sets: by their sizes, and their slices' bitmaps."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, windows: Windows) -> None:
        self.bitmaps, self.sizes, self.slices, self.windows = bitmaps, sizes & ((1 << SIZE) - 1), sizes >> SIZE, windows

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s, x, y = self.windows.s, self.sizes[a], self.sizes[b]
        apart = np.bitwise_count((self.bitmaps[a] ^ self.bitmaps[b]).view(np.uint64))
        return (apart <= self.windows.differ(x + y) // self.slices[a]) & (np.minimum(x, y) * s.denominator >= np.maximum(x, y) * s.numerator)


def _beside(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with each of its run, which starts there and has that size."""
    mine = np.repeat(rows, sizes)
    return mine, np.arange(len(mine)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def chains(keys: np.ndarray, nodes: np.ndarray, agree: Agree) -> np.ndarray:
    """Of rows sorted by key: links (rows of 2) that connect any two rows with the same key that agree.

    The first row of each run leads and takes the rows that agree with it; the others are a run of their own in the next step. Leaders were then
    compared with all that they did not take, but what they took was not, so each taken row is compared with the rows of the other leaders of its key.
    """
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(keys))
    run = np.repeat(np.arange(len(starts)), sizes)
    lead, left = np.arange(len(keys)), np.flatnonzero(sizes[run] > 1)
    while len(left):
        begins = np.diff(run[left], prepend=-1) != 0
        first = left[np.maximum.accumulate(np.where(begins, np.arange(len(left)), 0))]
        taken = agree(left, first)
        lead[left[taken]] = first[taken]
        left = left[~begins & ~taken]
    rows = np.arange(len(keys))
    taken = np.flatnonzero(lead != rows)
    links = [np.stack([taken, lead[taken]], axis=1)]
    several = np.bincount(run[lead == rows], minlength=len(starts)) > 1
    taken = taken[several[run[taken]]]
    ends = np.cumsum(sizes[run[taken]])
    at = 0
    while at < len(taken):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = taken[at:upto]
        mine, other = _beside(some, starts[run[some]], sizes[run[some]])
        apart = lead[mine] != lead[other]
        mine, other = mine[apart], other[apart]
        met = agree(mine, other)
        links.append(np.unique(np.stack([lead[mine[met]], lead[other[met]]], axis=1), axis=0))  # these leaders' rows are connected with them
        at = upto
    links = nodes[np.concatenate(links)]
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def digest_of(items: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(items.tobytes())


#: Long lists that are probed before the candidates that are out of reach are dropped.
PROBES = 64


def links_of(sets: list[np.ndarray], queries: list[int], similarity: Fraction, groups: Groups) -> None:
    """Joins in ``groups`` whatever links with a query; DivideSkip, but for what is connected with the query already.

    The queries come first in ``sets``, so a query searches only what comes after it.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.split(token, np.cumsum(sizes)[:-1])  # each set's lists, by number
    entries = np.sort(token * len(sets) + owner)  # all lists, one behind the other
    owner = entries % len(sets)
    ends = np.cumsum(np.bincount(token))
    lengths = np.diff(ends, prepend=0)
    heads = np.array([groups.find(x) for x in range(len(sets))])
    up, down = similarity.numerator, similarity.denominator
    for q in queries:
        n = len(sets[q])
        near = (heads != heads[q]) & (sizes * down >= up * n) & (n * down >= up * sizes)
        near[:q] = False
        if not near.any():
            continue
        least = min_overlap(n, int(sizes[near].min()), up, down)
        lists = of[q][lengths[of[q]] > 1]
        if len(lists) < least:
            continue
        lists = lists[np.argsort(lengths[lists], kind="stable")]
        cut = len(lists) - least + 1  # T - 1 of the longest are set aside
        short = [x for x in (x[near[x]].tolist() for x in (owner[ends[i] - lengths[i]:ends[i]] for i in lists[:cut].tolist())) if x]
        if not short:
            continue
        others, found = (np.array(x) for x in zip(*merged(short), strict=True))
        needed = -(-up * (n + sizes[others]) // (up + down))
        long = lists[cut:][::-1]
        for low in range(0, len(long), PROBES):  # a probe of all that can still reach T, by binary search
            alive = found + len(long) - low >= needed
            if not alive.all():
                others, found, needed = others[alive], found[alive], needed[alive]
            if not len(others):
                break
            wanted = long[low:low + PROBES] * len(sets) + others[:, None]
            found = found + (entries[np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)] == wanted).sum(1)
        for other in others[found >= needed].tolist():
            if groups.join(q, other):
                head, a, b = groups.find(q), heads[q], heads[other]
                heads[(heads == a) | (heads == b)] = head


def min_overlap(x: int, y: int, up: int, down: int) -> int:
    """The least intersection with intersection / union >= up / down."""
    return -(-up * (x + y) // (up + down))


def merged(lists: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Each member of the sorted lists, in order, and in how many it occurs."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        value, count = heap[0][0], 0
        while heap and heap[0][0] == value:
            _, i, at = heap[0]
            count += 1
            if at + 1 < len(lists[i]):
                heapq.heapreplace(heap, (lists[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        yield value, count


def jaccard_components(docs: DataFrame, *, k: int = 3, similarity: Fraction = Fraction(9, 10), chunk: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A-Z is lower-cased, words are runs without ASCII white space, and a text of fewer than ``k`` words
    is one shingle. A null, empty or blank text has an empty set and links with nothing. Rows that repeat an id are rows of their
    own; a component's id is the smallest doc_id of its rows, and a null id has none smaller than others. An empty table gives
    an empty result; a very long text is held whole, once. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    apart: frozenset[int] = frozenset()
    while True:  # 64 bits name a class; names that two classes have, as their 128 bits tell, are given anew
        base = scratch.save(_chained(texts, k, similarity, apart), f"base-{len(apart)}")
        members = base.where("kind = 0").select(F.col("x").alias("doc_id"), F.col("y").alias("size"), "node")
        classes = scratch.save(base.where("kind = 0 and y > 0").groupBy("node").agg(F.min("x").alias("chosen"), F.min("key").alias("a"), F.max("key").alias("b")), f"classes-{len(apart)}")
        clashes = {r["node"] for r in classes.where("a <> b").select("node").collect()}  # about one for each 6e9 classes' square over 2e19
        if clashes <= apart:
            break
        apart |= clashes
    blocks = components(base.where("kind = 2").select(F.col("key").alias("a"), F.col("node").alias("b")), scratch, "blocks")
    sizes = blocks.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    placed = scratch.save(blocks.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "placed")
    # One document stands for each class in a block. Where it goes is joined before its set is made: sets are moved once.
    chosen = scratch.save(classes.select("node", "chosen").join(placed, "node"), "chosen")
    sets = scratch.save(_sets(texts, chosen, k, apart), "sets")
    everywhere = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    first = sets.withColumn("chunk", F.explode(everywhere)).select("node", "root", "chunk", "items", F.lit(True).alias("query"))
    links = scratch.save(_search(first, similarity), "links-1")
    if not placed.where("chunks > 1").isEmpty():
        near = components(links, scratch, "near")
        state = placed.where("chunks > 1").join(near.withColumnRenamed("root", "near"), "node", "left").withColumn("near", F.coalesce("near", "node"))
        largest = scratch.save(state.groupBy("root", "near").count().groupBy("root").agg(F.max_by("near", F.struct("count", "near")).alias("largest")), "largest")
        state = scratch.save(state.join(largest, "root").withColumn("outside", F.col("near") != F.col("largest")), "state")
        # Who asks which chunk; so many to a task as a chunk holds.
        asking = scratch.save(_asks(sets.select("node", "items").join(state, "node"), similarity), "asks")
        asks = scratch.save(asking.groupBy("root", "chunk").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("asks")), "ask-sizes")
        asking = asking.join(asks, ["root", "chunk"]).withColumn("ask", F.pmod(F.xxhash64("node", F.lit(1)), F.col("asks")).cast("int"))
        asked = state.join(asks, ["root", "chunk"]).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        shape = ["node", "root", "chunk", "ask", "near"]
        pairs = asking.select(*shape, F.lit(True).alias("query")).unionByName(asked.select(*shape, F.lit(False).alias("query")))
        links = links.unionByName(scratch.save(_search(sets.select("node", "items").join(pairs, "node"), similarity, "ask"), "links-2"))
    roots = components(links, scratch, "components")
    # Both sides are written, so that the join may split a component that very many rows are in.
    whole_rows = scratch.save(members.join(roots, "node", "left").withColumn("root", F.when(F.col("size") > 0, F.coalesce("root", "node"))), "rows")
    least = scratch.save(whole_rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    return whole_rows.join(least, "root", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def named(sets: list[np.ndarray], apart: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """A name for each set, and the other half of its digest; the halves change places where two sets have one name."""
    halves = np.frombuffer(b"".join(digest_of(x) for x in sets), np.int64).reshape(-1, 2)
    if apart:
        halves = np.where(np.isin(halves[:, :1], list(apart)), halves[:, ::-1], halves)
    return halves[:, 0], halves[:, 1]


def stands_for(keys: np.ndarray, bitmaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row one that is equal to it, and the same for all that are: these agree, and with the same rows."""
    order = np.argsort(mix(keys.view(np.uint64) ^ mix(mix(bitmaps.view(np.uint64)) + sizes.view(np.uint64))), kind="stable")
    begins = np.ones(len(order), bool)
    for x in (keys[order], bitmaps[order], sizes[order]):
        begins[1:] &= x[1:] == x[:-1]
    begins[1:] = ~begins[1:]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))] if len(order) else order
    return out


def _chained(texts: DataFrame, k: int, similarity: Fraction, apart: frozenset[int]) -> DataFrame:
    """ROWS of kind 0, for each text, and 2, for classes that may be similar."""
    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        windows = Windows(similarity)
        for batch in batches:
            for part in portions(batch, size=1 << 21):
                sets = shingle_sets(part.column(1), k)
                nodes, others = named(sets, apart)
                yield _rows(0, others, nodes, part.column(0), pa.array([len(x) for x in sets], pa.int64()))
                once = sorted({node: i for i, node in enumerate(nodes.tolist()) if len(sets[i])}.values())
                owner, keys, bitmaps, sizes = signatures([sets[i] for i in once], windows)
                names = nodes[once][owner]
                alike = stands_for(keys, bitmaps, sizes)
                heads, others = alike == np.arange(len(alike)), np.flatnonzero(alike != np.arange(len(alike)))
                links = np.unique(np.stack([names[others], names[alike[others]]], axis=1), axis=0)
                yield _rows(2, links[:, 0], links[:, 1])
                yield _rows(1, keys[heads], names[heads], bitmaps[heads], sizes[heads])

    # Only signatures need to meet; what is known of documents rides along, and copies of a text, which have one key, are dealt over all tasks.
    deal = F.when(F.col("kind") == 1, F.col("key")).otherwise(F.xxhash64("key", "x"))
    shuffled = texts.mapInArrow(signed_rows, ROWS).repartition(deal).sortWithinPartitions("key", "node")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        windows = Windows(similarity)
        for kind, keys, nodes, bitmaps, sizes in _by_key(batches):
            if kind != 1:
                yield _rows(kind, keys, nodes, bitmaps, sizes)
                continue
            once = (np.diff(keys, prepend=keys[:1] - 1) != 0) | (np.diff(nodes, prepend=nodes[:1] - 1) != 0)  # batches repeat what is equal
            links = chains(keys[once], nodes[once], Agree(bitmaps[once], sizes[once], windows))
            yield _rows(2, links[:, 0], links[:, 1])

    return shuffled.mapInArrow(chained, ROWS)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of rows sorted by key: those of kinds 0 and 2 as they come, with x and y as they are (they may hold nulls); others in arrays of whole keys, with further columns if there are any."""
    held: list[list[np.ndarray]] = []  # the rows of the last key so far
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        for kind in (0, 2):
            rest = batch.filter(pa.array(kinds == kind))
            if rest.num_rows:
                yield kind, rest.column(1).to_numpy(), rest.column(2).to_numpy(), rest.column(3), rest.column(4)
        batch = batch.filter(pa.array(kinds == 1))
        if not batch.num_rows:
            continue
        rows = [x.to_numpy(zero_copy_only=False) for x in batch.columns[1:]]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last or held and held[0][0][0] != rows[0][-1]:
            held.append([x[:last] for x in rows])
            yield 1, *(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append([x[last:] for x in rows])
    if held:
        yield 1, *(np.concatenate(x) for x in zip(*held, strict=True))


def _asks(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """node, root, near, chunk: the chunks where a class outside its block's largest component has a candidate that it is not yet connected with.

    ``sets``: node, items, root, near, chunk, outside. Signatures are those that the blocks were made by.
    """
    names = ["node", "root", "near", "chunk", "outside"]

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(similarity)
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                owner, keys, bitmaps, sizes = signatures([np.frombuffer(x, np.uint64) for x in part.column(5).to_pylist()], windows)
                place = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(keys), part.column(0).take(place), pa.array(bitmaps), pa.array(sizes), *(part.column(i).take(place) for i in range(1, 5))],
                                                 names=["kind", "key", "node", "x", "y", *names[1:]])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(similarity)
        for _, keys, nodes, bitmaps, sizes, roots, near, chunks, outside in _by_key(batches):
            agree = Agree(bitmaps, sizes, windows)
            starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
            counts = np.diff(starts, append=len(keys))
            run = np.repeat(np.arange(len(starts)), counts)
            asking = np.flatnonzero(outside & (counts[run] > 1))
            ends = np.cumsum(counts[run[asking]])
            at = 0
            while at < len(asking):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                some = asking[at:upto]
                mine, other = _beside(some, starts[run[some]], counts[run[some]])
                good = near[mine] != near[other]
                mine, other = mine[good], other[good]
                good = agree(mine, other)
                found = np.unique(np.stack([nodes[mine[good]], roots[mine[good]], near[mine[good]], chunks[other[good]].astype(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[:, :3].T] + [pa.array(found[:, 3].astype(np.int32))], names=names[:4])
                at = upto

    rows = sets.select(*names, "items").mapInArrow(signed_rows, ROWS + ", root long, near long, chunk int, outside boolean")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(met, "node long, root long, near long, chunk int").distinct()


def _sets(texts: DataFrame, chosen: DataFrame, k: int, apart: frozenset[int]) -> DataFrame:
    """``chosen`` (node, chosen, root, chunks, chunk) with each class's set as bytes; a row that repeats the chosen document repeats its class."""
    more = ["node", "root", "chunks", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            for part in portions(batch, 0):
                found = shingle_sets(part.column(0), k)
                right = named(found, apart)[0] == part.column(1).to_numpy()
                kept = part.filter(pa.array(right))
                yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(1, 5)), pa.array([x.tobytes() for x, r in zip(found, right, strict=True) if r], pa.binary())], names=[*more, "items"])

    rows = texts.join(small(chosen), F.col("doc_id").eqNullSafe(F.col("chosen"))).select("text", *more)
    return rows.mapInArrow(run, "node long, root long, chunks int, chunk int, items binary")


def _search(rows: DataFrame, similarity: Fraction, *more: str) -> DataFrame:
    """Links a, b between the classes of each (root, chunk, ...), from those with ``query`` to all; with ``near``, equal ones are connected already."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["query", "node"], ascending=[False, True]).drop_duplicates("node", ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in batch["items"]]
        groups, node = Groups(len(sets)), batch["node"].tolist()
        if "near" in batch:
            for at in batch.groupby("near").indices.values():
                for x in at[1:].tolist():
                    groups.join(int(at[0]), x)
        before = [groups.find(x) for x in range(len(sets))]
        links_of(sets, np.flatnonzero(batch["query"].to_numpy()).tolist(), similarity, groups)
        out = [(node[x], node[groups.find(x)]) for x in range(len(sets)) if groups.find(x) != before[x]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("root", "chunk", *more).applyInPandas(run, "a long, b long")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` but for those in a component with a smaller id, with their own columns, whatever their names.

    Rows without an id stay, as do rows with a null, empty or blank text; of rows that repeat an id all stay or all go. An empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard-rows")
    found = scratch.save(jaccard_components(docs, id_col=id_col, **options), "found")
    gone = scratch.save(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    return rows.join(small(gone), F.col("row")[id_col].cast("long") == F.col("doc_id"), "left_anti").select("row.*")
