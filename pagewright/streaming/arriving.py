"""Edited chunk files checked as they come, against a side that is stored with its digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import verify_changed
from ..scratch import Scratch
from ..sources.chunks import as_text, lines_of, unread
from .ingest import FILES


def check_arriving(spark: SparkSession, folder: str, origin: DataFrame, stored: DataFrame, out: str, checkpoint: str, *, glob: str = "chunk_*.md", files_per_trigger: int = 1000) -> StreamingQuery:
    """Faults of each file that came to ``folder``, in ``out``, a folder for each batch, so that a batch which is run again replaces its own rows.

    ``origin`` (file_name, line_no, line) is read for files that differ from their digests in ``stored`` (``checks.file_digests``, a written table). What has not come is no fault.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(folder)

    def check(batch: DataFrame, number: int) -> None:
        scratch = Scratch(batch.sparkSession, "arriving")
        texts = scratch.save(as_text(batch), "texts")
        verify_changed(lines_of(texts), origin, stored=stored, whole=False, unread=unread(texts), scratch=scratch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        for name in ("texts", "files"):
            scratch.drop(name)

    return files.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
