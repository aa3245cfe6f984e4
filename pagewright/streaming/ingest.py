"""New packages in a folder, shredded to a table of runs as they come."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.docx import as_packages, runs

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, *, files_per_trigger: int = 100, compat: bool = False) -> StreamingQuery:
    """Each file is shredded once: the file log in ``checkpoint`` and the sink's log make it so over restarts. No state is kept; what was read is observed as ``ingest``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    found = runs(as_packages(files.select("path", "length", "content")), compat=compat)
    found = found.observe("ingest", F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"))
    return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
