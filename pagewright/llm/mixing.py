"""Mixing sources to target weights (op1): Poisson replication with DataFrame functions only.

A group's rate is the mean number of times its documents must be repeated for the group to fill
its share of the output. Each document draws a count from the Poisson distribution with that
mean, by inverting it at a number made from a hash of the seed, the id and the text; it is
then exploded into so many rows, which are dealt over all partitions and sorted there by
a hash of (id, text, copy): a global shuffle.

Only the rates are broadcast: one row for each weight given and one for all other sources, so
their number is fixed by the call and not by the data. Nothing is grouped by
source but partial sums, so a source with a third of all rows does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted

OTHER = "*"
ADDED = ["rate", "n_copies", "copy"]
#: A larger rate is drawn as a sum of so many draws of at most this mean each: exp(-rate) stays far from underflow.
PART = 16.0
#: Steps of the inverted distribution of a part: the chance of more is below 1e-30.
STEPS = 96


def mix_sources(docs: DataFrame, weights: dict[str, float], *, seed: int = 1, epochs: float = 1.0, other: float = 1.0,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partitions: int | None = None, added: bool = True) -> DataFrame:
    """The columns of ``docs`` and, if ``added``, ``rate``, ``n_copies``, ``copy`` (from 0): a row for each copy.

    ``weights`` are shares of the output's characters (each text counts its characters plus 1), for the named
    sources; all other sources and null share the weight ``other``. Weights of
    groups without rows fall to the rest. The output has about ``epochs`` times the input's
    characters. A null text counts as empty; null ids draw by their text. Rows that repeat an id
    and text draw the same count. An empty table gives an empty result. A weight of 0 leaves a source out.
    With ``added``, columns of ``docs`` that have the name of an added one are replaced; without, all come out as they are.
    """
    if OTHER in weights:
        raise ValueError(f"{OTHER!r} stands for all other sources")
    given = {**weights, OTHER: other}
    if any(w < 0 for w in given.values()):
        raise ValueError("weights must not be negative")
    group = F.when(F.col(source_col).isin(*weights), F.col(source_col)).otherwise(OTHER) if weights else F.lit(OTHER)
    weight = F.create_map(*(F.lit(x) for pair in given.items() for x in (pair[0], float(pair[1]))))
    sizes = docs.groupBy(group.alias("_group")).agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit(""))) + 1).alias("_size"))
    whole = sizes.agg(F.sum("_size").alias("_total"), F.sum(weight[F.col("_group")]).alias("_weights"), F.collect_list(F.struct("_group", "_size")).alias("_all"))
    rate = F.lit(float(epochs)) * F.col("_total") * weight[F.col("_group")] / F.col("_weights") / F.col("_size")
    rates = whole.select("_total", "_weights", F.inline("_all")).select("_group", F.when(F.col("_weights") > 0, rate).otherwise(0.0).alias("rate"))
    parts = rates.withColumn("_parts", F.ceil(F.greatest(F.col("rate") / PART, F.lit(1.0))).cast("int")).withColumn("_mean", F.col("rate") / F.col("_parts"))
    bounds = parts.withColumn("_bounds", F.expr(
        f"aggregate(sequence(1, {STEPS}), named_struct('p', exp(-_mean), 'sum', exp(-_mean), 'all', array(exp(-_mean))), "
        "(s, k) -> named_struct('p', s.p * _mean / k, 'sum', s.sum + s.p * _mean / k, 'all', array_append(s.all, s.sum + s.p * _mean / k)), s -> s.all)"))
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    own = [c for c in docs.columns if not added or c not in ADDED]
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in own)).alias("_row"), key.alias("_key"), group.alias("_group"))
    drawn = rows.join(F.broadcast(bounds), "_group").withColumn("n_copies", F.expr(
        "aggregate(sequence(1, _parts), 0, (n, j) -> n + aggregate(_bounds, 0, (m, b) -> m + if("
        "cast(conv(substring(md5(concat(_key, '/', j)), 1, 12), 16, 10) as double) / 281474976710656 >= b, 1, 0)))"))
    copies = drawn.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1))).select("_row", "_key", *ADDED)
    place = F.xxhash64("_key", "copy")
    dealt = copies.repartition(partitions, place) if partitions else copies.repartition(place)
    return dealt.sortWithinPartitions(place).select("_row.*", *(ADDED if added else []))
