"""Embedding near-dedup (op6) by Euclidean p-stable hashing, then exact cosines.

Equal vectors with equal labels are one class. A class is normalised and put, in each of ``tables`` tables, into the bucket
of ``projections`` quantised random projections, floor((a.x + b) / width), with its label. A bucket of two
or more classes is one task's matrix product in double precision, tile by tile; one of more than ``block`` classes is cut into blocks, and each pair of blocks is a task. A pair that
meets in several tables is counted only in the first of them. No pair leaves a task: only each
class's number of links, and a spanning forest for the components. Classes are told by 128 bits of hashes.

Cosine 0.98 is distance 0.2 of unit vectors. With width 1 a projection then agrees with probability 0.84 and ten of them with
0.17; over 24 tables a pair at the very threshold is found with probability 0.99, closer ones nearly always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .linking import hook
from .scratch import Scratch


def signatures(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit hash of each vector's bucket in each table."""
    random = np.random.default_rng([seed, unit.shape[1]])
    lines = random.standard_normal((unit.shape[1], tables * projections))
    shifts = random.uniform(0, width, tables * projections)
    cells = np.floor((unit @ lines + shifts) / width).astype(np.int64).reshape(len(unit), tables, projections)
    factors = random.integers(1, 1 << 62, projections, dtype=np.int64) * 2 + 1
    mixed = (cells * factors).sum(2)
    return mixed ^ (mixed >> 29)


def embedding_links(vectors: DataFrame, *, threshold: float = 0.98, tables: int = 24, projections: int = 10, width: float = 1.0, seed: int = 7, block: int = 1024,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only rows with equal labels are compared. A null label, and a vector that is null, empty, zero or holds a null or
    non-finite component, links with nothing; vectors of different lengths do not link. Rows that repeat a vector are
    linked with each other and count each as a row; rows that repeat an id are rows of their own. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession, "embedding-dedup")
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.coalesce((F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(values, lambda x: x != 0) & F.col(label_col).isNotNull(), F.lit(False))
    usable = vectors.select(F.col(id_col).alias("vec_id"), F.when(fine, F.col(label_col)).alias("label"), F.when(fine, values).alias("vector"))
    same = F.when(F.col("vector").isNotNull(), F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), F.col("label"), F.col("vector"))), 16, "0") for i in (1, 2))))
    rows = usable.withColumn("node", same)
    members = rows.select("vec_id", "node")
    classes = scratch.save(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight")), "classes")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lists = batch.column(0), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            offsets = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                found = signatures(_unit(flat[offsets[at][:, None] + np.arange(dim)]), tables, projections, width, seed)
                yield pa.RecordBatch.from_pydict({"node": nodes.take(pa.array(at)), "cells": pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), tables).cast(pa.list_(pa.int64()))})

    cells = scratch.save(classes.select("node", "vector").mapInArrow(dealt, "node string, cells array<long>"), "cells")
    entries = cells.join(classes.select("node", "label", F.size("vector").alias("dim")), "node").select("node", "label", "dim", F.posexplode("cells").alias("table", "cell"))
    bucket = ["label", "dim", "table", "cell"]
    full = entries.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = entries.join(full, bucket).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = placed.withColumn("other", other).select("node", *bucket, F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part")
    full_rows = pairs.join(classes.select("node", "vector", "weight"), "node").join(cells, "node")

    shape = ["node", *bucket, "one", "two", "part", "weight", "vector", "cells"]
    dealt_out = full_rows.select(*shape).repartition(*bucket, "one", "two").sortWithinPartitions(*bucket, "one", "two", "node")
    found = scratch.save(dealt_out.mapInArrow(_linked(threshold, shape.index("one")), "node string, links long, root string"), "found")
    roots = components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "components")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select("node", "weight").join(counts, "node", "left").join(roots, "node", "left").select("node", "weight", "links", F.coalesce("root", "node").alias("root"))
    whole = members.join(nodes, "node", "left")
    least = whole.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    component = F.when(F.col("least").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return whole.join(least, "root", "left").select(
        "vec_id", F.coalesce(F.col("links") + F.col("weight") - 1, F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: Rows of a matrix product that are made at once.
TILE = 256


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


#: Classes of a bucket whose pairs are compared along with those of others; a larger one is a matrix product of its own.
FEW = 24


def _linked(threshold: float, at: int):
    """Rows sorted by bucket and pair of blocks, as node, what names these (``at``: the first block's column), part, weight, vector, cells: to node, links, root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            begins = _begins(rows, at)
            if len(begins) > 1:  # the last bucket may go on
                yield from _links(rows.slice(0, begins[-1]), begins[:-1], at, threshold)
                rows = rows.slice(begins[-1])
            held = [rows]
        if held:
            yield from _links(held[0], np.zeros(1, np.int64), at, threshold)

    return run


def _begins(rows: pa.RecordBatch, at: int) -> np.ndarray:
    """Where each bucket's pair of blocks begins."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for i in range(1, at + 2):
        x = rows.column(i).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _links(rows: pa.RecordBatch, begins: np.ndarray, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Each class's links, which count the rows of the other's class, and a class that it is connected with."""
    dims = rows.column(2).to_numpy()
    edges = [0, *begins[1:][np.diff(dims[begins]) != 0].tolist(), rows.num_rows]
    for low, high in zip(edges, edges[1:]):
        part, starts = rows.slice(low, high - low), begins[(begins >= low) & (begins < high)] - low
        dim, n = int(dims[low]), high - low
        unit = _unit(part.column(at + 4).flatten().to_numpy().reshape(n, dim))
        cells = part.column(at + 5).flatten().to_numpy().reshape(n, -1)
        table, one, two, block, weight = (part.column(i).to_numpy() for i in (3, at, at + 1, at + 2, at + 3))
        links, up = np.zeros(n, np.int64), np.arange(n)

        def told(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal links, up
            for t in range(cells.shape[1]):  # a pair that meets in an earlier table is counted there
                fresh = (cells[i, t] != cells[j, t]) | (table[i] <= t)
                i, j = i[fresh], j[fresh]
            for x, y in ((i, j), (j, i)):
                links += np.bincount(x, weight[y], minlength=n).astype(np.int64)
            up = hook(up, i, j)

        sizes = np.diff(starts, append=n)
        few = np.repeat(sizes <= FEW, sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows from here to the bucket's end
        for step in range(1, min(FEW, int(sizes.max()))):
            i = np.flatnonzero(few & (left > step))
            i = i[(one[i] == two[i]) | (block[i] != block[i + step])]
            i = i[np.einsum("ij,ij->i", unit[i], unit[i + step]) >= threshold]
            told(i, i + step)
        for begin, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            here = np.arange(begin, begin + size)
            mine, other = here[block[here] == one[begin]], here[block[here] == two[begin]]
            for tile in range(0, len(mine), TILE):
                i, j = np.nonzero(unit[mine[tile:tile + TILE]] @ unit[other].T >= threshold)
                i, j = mine[tile + i], other[j]
                if one[begin] == two[begin]:
                    i, j = i[i < j], j[i < j]
                told(i, j)
        some = np.flatnonzero(links > 0)
        node = part.column(0)
        yield pa.RecordBatch.from_arrays([node.take(pa.array(some)), pa.array(links[some]), node.take(pa.array(up[some]))], names=["node", "links", "root"])
