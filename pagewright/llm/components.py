"""Connected components of a table of links, by large-star and small-star rounds.

Each round moves links towards the smallest node of their component, until all components are stars: about log(n) rounds. Smallest neighbours come from a partial aggregation and are
written before they are joined back, so that they are broadcast if they are few and the join may split a hub's rows if they are not: the hub of a star
is not gathered into one task. Every round is written to the shared folder, which keeps the plan short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``links``: long columns a, b; null ends and loops are ignored. Returns node, root for each node with a link; root is the smallest node of the component."""
    links = scratch.save(_downward(links).distinct(), f"{name}-0")
    number = 0
    while not _settled(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        number += 1
        large = scratch.save(_star(both, F.col("b") > F.col("a"), scratch, f"{name}-large"), f"{name}-half")
        links = scratch.save(_star(large, F.lit(True), scratch, f"{name}-small").distinct(), f"{name}-{number}")
        scratch.drop(f"{name}-{number - 1}")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _downward(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _star(links: DataFrame, moved, scratch: Scratch, name: str) -> DataFrame:
    """Of each node's neighbours, those that ``moved`` selects are linked to the least of the node and its neighbours; so is the node itself."""
    least = scratch.save(links.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")), name)
    joined = links.join(small(least), "a")
    return _downward(joined.where(moved).select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))))


def _settled(links: DataFrame) -> bool:
    """Whether all components are stars: no node has two links down, or one down and one up."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()
