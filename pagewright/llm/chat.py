"""Chat formatting (op3): collapse of cumulative snapshots, with DataFrame functions only.

A logged conversation is often a prefix of a longer one. Rolling hashes over the turns give every
prefix of every conversation a 128-bit key (the exclusive or of a hash of each turn with its
place). One row for each prefix key keeps the longest conversation that has it, and the
smallest id of those that end there; partial aggregation makes a first turn that all share
a few rows. An anti-join then drops what a longer conversation continues; only the turns of what it leaves are joined, and rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def collapse_and_render(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies (equal conversations, itself included), rendered.

    Turns are in the order of turn, role, text (nulls first); rows that repeat a turn are turns of their own.
    Of equal conversations the smallest id stays. Rows without a conv_id belong
    to no conversation and are left out. A null role is ``unknown``, a null text empty. The
    markers' ``<|`` in a text becomes ``< |``, so no text can end its turn. An empty table gives an empty result.
    One conversation is one rendered string, so its turns do meet in one task; different conversations never do.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("place", F.row_number().over(order))
    hashed = placed.select("conv_id", "place", *(F.xxhash64(F.lit(i), "place", "role", "text").alias(h) for i, h in ((1, "hash_a"), (2, "hash_b"))), "turn", "role", "text")
    rolling = hashed.select("conv_id", "place", F.bit_xor("hash_a").over(so_far).alias("hash_a"), F.bit_xor("hash_b").over(so_far).alias("hash_b"),
                            F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"))
    ends = F.col("place") == F.col("n_turns")
    prefixes = rolling.groupBy("place", "hash_a", "hash_b").agg(
        F.max("n_turns").alias("longest"), F.min(F.when(ends, F.col("conv_id"))).alias("conv_id"), F.count_if(ends).alias("n_copies"))
    finals, longer = prefixes.where("conv_id is not null"), prefixes.where("longest > place").select("place", "hash_a", "hash_b")
    maximal = finals.join(longer, ["place", "hash_a", "hash_b"], "left_anti").select("conv_id", "n_copies")
    kept = rows.join(maximal, "conv_id")  # only these are rendered
    safe = F.replace(F.col("text"), F.lit("<|"), F.lit("< |"))
    line = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["safe"], F.lit(CLOSE + "\n"))
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text", safe.alias("safe"))))
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(said, line), "").alias("rendered"))
