"""Categories of formatting in each paragraph, and text with tags.

All work for a paragraph groups by its key, so one exchange on it serves the aggregation, the ranks and the islands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_categories(runs: DataFrame, para: Sequence[str], key: str, order: str, *, firsts: Sequence[str] = ()) -> DataFrame:
    """One row per paragraph and category: the columns of ``para``, ``key``, cnt, first_ord, each of ``firsts`` as the first run has it, cat_id, is_baseline.

    Categories are numbered F0, F1, ... by falling count, in order of first appearance on ties. Runs with a null key (formulas) make none.
    """
    grouped = runs.where(F.col(key).isNotNull()).groupBy(*para, key).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(order).alias("first_ord"), *(F.min_by(c, order).alias(c) for c in firsts))
    rank = F.row_number().over(Window.partitionBy(*para).orderBy(F.desc("cnt"), "first_ord")) - 1
    return grouped.withColumn("rank", rank).select("*", F.concat(F.lit("F"), F.col("rank").cast("string")).alias("cat_id"), (F.col("rank") == 0).alias("is_baseline")).drop("rank")


def merge_runs(runs: DataFrame, para: Sequence[str], key: Column | str, order: Sequence[str], text: Column | str | None = None) -> DataFrame:
    """Islands of neighbouring runs with the same key: the columns of ``para``, island (from 1), key, n_runs, and the runs' texts joined in order."""
    window = Window.partitionBy(*para).orderBy(*order)
    key = F.col(key) if isinstance(key, str) else key
    marked = runs.withColumn("_key", key).withColumn("_new", F.when(F.lag("_key").over(window).eqNullSafe(F.col("_key")) & (F.row_number().over(window) > 1), 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    texts = [] if text is None else [_joined(F.col(text) if isinstance(text, str) else text, order)]
    return numbered.groupBy(*para, "island").agg(F.first("_key").alias("key"), F.count(F.lit(1)).alias("n_runs"), *(t.alias("text") for t in texts))


def _joined(text: Column, order: Sequence[str]) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), "")


def tag_text(runs: DataFrame, para: Sequence[str], order: str, *, formulas: str | None = None, compat: bool = False) -> DataFrame:
    """One row per paragraph: its runs' texts in order, islands outside the baseline category as ``‹Fn:hint›text‹/›``.

    ``runs`` has cat_id (null: a formula of its own), hint, is_baseline, text and, if named, an array of ``formulas``. A run's text joins its island; its formulas end
    the island and follow it untagged. With ``compat``, formulas of a run without text come before the island that is still open.
    """
    items = [F.struct(F.lit(0).alias("_part"), F.col("text").alias("_text"), F.col("cat_id").alias("_cat"))]
    pieces = F.filter(F.array(*items), lambda x: x["_text"] != "")
    if formulas:
        found = F.transform(F.col(formulas), lambda f, i: F.struct((i + 1).alias("_part"), f.alias("_text"), F.lit(None).cast("string").alias("_cat")))
        pieces = F.concat(pieces, found)
    rows = runs.select(*para, order, "cat_id", "hint", "is_baseline", F.inline(pieces))
    window = Window.partitionBy(*para).orderBy(order, "_part")
    if formulas and compat:  # such formulas go to where the open island began
        jumps = F.col("_cat").isNull() & F.col("cat_id").isNotNull() & ~F.max((F.col("_part") == 0)).over(Window.partitionBy(*para, order))
        solid = rows.withColumn("_jump", jumps)
        plain = solid.where("not _jump")
        begun = F.lag("_cat").over(window)
        starts = plain.withColumn("_start", F.when(F.col("_cat").isNull() | ~F.coalesce(begun == F.col("_cat"), F.lit(False)), F.struct(order, "_part")))
        both = starts.unionByName(solid.where("_jump").withColumn("_start", F.lit(None).cast(starts.schema["_start"].dataType)))
        seen = F.last(F.when(~F.col("_jump"), F.struct(F.col("_cat").alias("c"))), ignorenulls=True).over(window)
        begin = F.last("_start", ignorenulls=True).over(window)
        both = both.withColumn("_seen", seen).withColumn("_begin", begin)
        into = F.col("_jump") & F.col("_seen.c").isNotNull()
        rows = both.withColumn("_at", F.when(into, F.struct(F.col(f"_begin.{order}").alias("a"), F.col("_begin._part").alias("b"), F.lit(0).alias("c"), F.col(order).alias("d"), F.col("_part").alias("e")))
                               .otherwise(F.struct(F.col(order).alias("a"), F.col("_part").alias("b"), F.lit(1).alias("c"), F.col(order).alias("d"), F.col("_part").alias("e"))))
    else:
        rows = rows.withColumn("_at", F.struct(F.col(order).alias("a"), F.col("_part").alias("b")))
    place = Window.partitionBy(*para).orderBy("_at")
    new = F.when(F.col("_cat").isNotNull() & (F.lag("_cat").over(place) == F.col("_cat")), 0).otherwise(1)
    islands = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    texts = islands.groupBy(*para, "_island").agg(
        F.first("_cat").alias("_cat"), F.first("hint").alias("hint"), F.first("is_baseline").alias("is_baseline"), F.min("_at").alias("_at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda r: r["_text"]), "").alias("_text"))
    from ..functions.formats import tagged

    shown = F.when(F.col("_cat").isNull() | F.col("is_baseline"), F.col("_text")).otherwise(tagged(F.col("_cat"), F.col("hint"), F.col("_text")))
    return texts.groupBy(*para).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", shown.alias("s")))), lambda r: r["s"]), "").alias("text"))
