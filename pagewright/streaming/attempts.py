"""Attempts at edited files as keyed state: how often each has been checked and found wrong, over batches and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.checks import ATTEMPTS

CHECKED = "file_name string, version long, n_errors long"
TRIED = "file_name string, version long, attempt int, for_a_human boolean"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Files are dealt over so many keys of the state by a hash of their names: a call for each file takes some ten milliseconds, one for each bucket as long.
BUCKETS = 1024


class _Attempts(StatefulProcessor):
    """For each bucket an entry for each of its files that is wrong: the last version that was checked, at how many it was found wrong, and when a row for it came. It goes when a version passes, or when nothing came for a time."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getValueState("entries", "file_names array<string>, versions array<long>, attempts array<int>, seen array<long>", self.keep_ms or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timers.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        known = {name: entry for name, *entry in zip(*self.entries.get(), strict=True) if entry[2] + self.keep_ms >= now} if self.entries.exists() else {}
        came = pd.concat(rows).sort_values(["version", "n_errors"], ascending=[True, False])
        out = []
        for name, told, n_errors in zip(*(came[c].tolist() for c in ("file_name", "version", "n_errors")), strict=True):
            version, attempt, _ = known.get(name, (-1, 0, now))
            if told > version:  # else told before
                version, attempt = told, attempt + 1 if n_errors > 0 else 0
                out.append((name, version, attempt, attempt >= ATTEMPTS))
            known[name] = (version, attempt, now)  # one that passed stays until the batch's rows are told
        wrong = {name: entry for name, entry in known.items() if entry[1]}
        if wrong:
            self.entries.update((list(wrong), *(list(x) for x in zip(*wrong.values(), strict=True))))
        elif self.entries.exists():
            self.entries.clear()
        yield pd.DataFrame(out, columns=["file_name", "version", "attempt", "for_a_human"]).astype({"version": "int64", "attempt": "int32", "for_a_human": bool})

    def close(self) -> None:
        pass


def follow(spark: SparkSession, checked: str, out: str, checkpoint: str, *, keep_ms: int = 0, buckets: int = BUCKETS) -> StreamingQuery:
    """Takes what came to the folder ``checked`` (CHECKED: a file, the version of it that was checked, the number of its errors) and adds to ``out`` (TRIED) a row for each version.

    A version that is told again changes nothing while its file has an entry. After ``ATTEMPTS`` wrong versions in a row a file is for a human to see to. ``keep_ms``: entries go
    after so long without a row for their file; 0: never. ``buckets``: keys of the state; a checkpoint must be gone on with by the number that it began with.
    """
    rows = spark.readStream.schema(CHECKED).parquet(checked).where("file_name is not null and version is not null")
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("file_name"), F.lit(buckets)).cast("int"))
    tried = dealt.groupBy("bucket").transformWithStateInPandas(_Attempts(keep_ms), TRIED, "Append", "ProcessingTime" if keep_ms else "None")
    settings = STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}  # with entries that expire, batches without rows would follow without end
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return tried.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def standing(tried: DataFrame) -> DataFrame:
    """file_name, attempt, for_a_human of each file as of its last version, of those that are wrong."""
    last = tried.groupBy("file_name").agg(F.max_by(F.struct("attempt", "for_a_human"), "version").alias("x"))
    return last.select("file_name", "x.attempt", "x.for_a_human").where("attempt > 0")
