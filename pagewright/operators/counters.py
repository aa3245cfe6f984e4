"""Counters of what passes through a plan, gathered as a table: progress that costs no pass of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SHAPE = "step string, counter string, value long"


class Counters:
    """Counts rows as they pass. A step's counters are known when an action that ran through it has ended; ``table`` waits for those."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.steps: list[tuple[str, Observation, list[str]]] = []

    def count(self, rows: DataFrame, step: str, **counters: Column) -> DataFrame:
        """``rows`` as they are, counted on the way: ``rows`` and each of ``counters``, sums of whole numbers."""
        seen = Observation()
        self.steps.append((step, seen, ["rows", *counters]))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in counters.items()))

    def values(self) -> list[tuple[str, str, int]]:
        return [(step, name, seen.get[name]) for step, seen, names in self.steps for name in names]

    def table(self) -> DataFrame:
        """step, counter, value: a few rows for each step, whatever passed."""
        return self.spark.createDataFrame(self.values(), SHAPE)


class StreamCounters(StreamingQueryListener):
    """The same of streaming queries: the sums over their micro-batches of what was observed under a step's name."""

    def __init__(self) -> None:
        self.sums: dict[tuple[str, str], int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for step, row in event.progress.observedMetrics.items():
            for name, value in row.asDict().items():
                self.sums[step, name] = self.sums.get((step, name), 0) + (value or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(step, name, value) for (step, name), value in sorted(self.sums.items())], SHAPE)
