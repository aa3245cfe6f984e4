"""Categories of formatting over all packages that have come: counts as streaming state, ranks made on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import formats
from ..sources.docx import as_packages, runs
from .attempts import STORE
from .ingest import FILES


def counted(found: DataFrame) -> DataFrame:
    """key, cnt, first_seen of each category of runs: how many it has, and the least (doc_hash, para_ord, run_ord) of them."""
    keyed = found.select(formats.category_key(F.col("fmt")).alias("key"), F.struct("doc_hash", "para_ord", "run_ord").alias("place")).where("key is not null")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min("place").alias("first_seen"))


def count_categories(spark: SparkSession, folder: str, out: str, checkpoint: str, *, files_per_trigger: int = 100, compat: bool = False) -> StreamingQuery:
    """Counts of the categories in packages that came to ``folder``, kept as state in ``checkpoint``; of each batch the counts that changed go to a folder of ``out``, which a batch that is run again replaces.

    State is a row for each category, of which there are few; partial sums go there, not runs.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    counts = counted(runs(as_packages(files.select("path", "length", "content")), compat=compat))

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def ranked(written: DataFrame) -> DataFrame:
    """key, cnt, cat_id, is_baseline as of the last batch of what ``count_categories`` wrote: by falling count, then as first seen. The ranks are of a row for each category."""
    last = written.groupBy("key").agg(F.max_by(F.struct("cnt", "first_seen"), "batch").alias("x")).select("key", "x.cnt", "x.first_seen")
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "first_seen")) - 1
    return last.select("key", "cnt", F.concat(F.lit("F"), rank.cast("string")).alias("cat_id"), (rank == 0).alias("is_baseline"))
