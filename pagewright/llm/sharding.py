"""Sharding by histogram sort (op9): the law is ``bytes``, shards of nearly equal size.

Rows are ordered by (hash of the text, row number), so equal texts lie side by side. For every
shard boundary 1,024 candidate keys ("probes") are set, the exact bytes below each are counted
over all partitions, and the probes are set anew between the two that enclose the target, until
each boundary meets its tolerance. What a round brings to the driver is at most one row for
each gap between probes. Equal texts stay in one shard, unless they hold more than the share ``whole`` of one:
only such a group may be cut, by row number. Then rows are exchanged once, into many buckets for
each shard, and numbered there; offsets of buckets make the slots gapless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def shard_by_bytes(docs: DataFrame, shards: int = 16, *, tolerance: float = 0.002, whole: float = 0.1, bits: int = 10,
                   id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: it belongs to another law).

    A row's size is its text's UTF-8 bytes plus 1; a null text has none, and the CRC of no bytes.
    ``tolerance`` and ``whole`` are shares of the mean shard: a shard may miss its size by the tolerance, by half of a group of equal texts that is kept whole, and by
    a single row. Rows that repeat an id or text are rows of their own, and such a tie in the order of texts goes by row. A very long text is one row, however large: no
    text is read but for its size, its CRC and its hash. An empty table gives an empty result; with fewer rows than shards some shards stay empty.
    Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = scratch.save(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                    F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")), "keys")
    cuts, rows = splitters(keys, shards, tolerance, whole, bits)
    buckets = max(1, -(-rows // (shards * bucket_rows)))
    placed = keys.withColumn("shard", _below([(F.col("key") > k) | ((F.col("key") == k) & (F.col("row") >= r)) for k, r in cuts])).withColumn(
        "bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "row"))
    return placed.withColumn("slot", slot).join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("slot") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def splitters(keys: DataFrame, shards: int, tolerance: float, whole: float, bits: int) -> tuple[list[tuple[int, int]], int]:
    """The first (key, row) of each shard but the first, in order, and the number of rows."""
    sums = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = sums["bytes"] or 0, sums["rows"]
    if not rows:
        return [], 0
    targets = {i: total * i / shards for i in range(1, shards)}
    cuts, heavy = _search(keys, "key", targets, tolerance * total / shards, whole * total / shards, bits)
    placed = {i: (key, LEAST) for i, key in cuts.items()}
    for key in sorted({key for key, _ in heavy.values()}):
        inside = {i: targets[i] - below for i, (k, below) in heavy.items() if k == key}
        rows_cut, _ = _search(keys.where(F.col("key") == key), "row", inside, 0, 0, bits)
        placed |= {i: (key, row) for i, row in rows_cut.items()}
    return sorted(placed.values()), rows


def _search(keys: DataFrame, column: str, targets: dict[int, float], slack: float, most_whole: float, bits: int) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """For each target a value of ``column`` below which so many bytes lie; or, if one value holds more than ``most_whole`` there, that value and the bytes below it.

    Each round sets probes at 2 ** ``bits`` even steps within the cell that holds a target, for all targets at once.
    """
    cuts: dict[int, int] = {}
    heavy: dict[int, tuple[int, int]] = {}
    cells = {i: (0, 0) for i in targets}  # a target's cell, and the exact bytes below it
    width = 64
    while cells:
        shift = max(0, width - bits)
        inside = keys if width == 64 else keys.where(F.shiftright(column, width).isin(sorted({c for c, _ in cells.values()})))
        found = sorted((r["cell"], r["bytes"], r["least"], r["most"], r["rows"]) for r in inside.groupBy(F.shiftright(column, shift).alias("cell")).agg(
            F.sum("size").alias("bytes"), F.min(column).alias("least"), F.max(column).alias("most"), F.count(F.lit(1)).alias("rows")).collect())
        for i, (cell, below) in list(cells.items()):
            for part, size, least, most, rows in found:
                if width < 64 and part >> (width - shift) != cell:
                    continue
                if below + size < targets[i]:
                    below += size
                    continue
                error, cut = min((targets[i] - below, least), (below + size - targets[i], most + 1))
                if (error <= slack or rows == 1 or least == most and size <= most_whole) and cut <= MOST:
                    cuts[i] = cut
                elif least == most and column == "key":
                    heavy[i] = (least, below)
                else:
                    cells[i] = (part, below)
                    break
                del cells[i]
                break
        width = shift
    return cuts, heavy


def _below(tests: list[Column]) -> Column:
    """How many of the tests hold, where each implies the ones before it: a balanced tree, log(n) comparisons a row."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(tests[middle], tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(tests)).cast("int")
