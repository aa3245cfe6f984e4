"""Exact deduplication (op8): stateful streaming with disk-backed state that never expires.

Every row arrives as (digest, stable id, content locator). A streaming aggregation keeps one
state entry per digest in RocksDB: the largest id seen, where its content lies, and how many
rows came. No watermark is set, so entries never expire, and the state is checkpointed in a folder that all executors share:
a lost executor's partition is rebuilt from there. With a folder of the caller's own the state outlives the call, and a later batch meets it. The aggregation combines on the
map side, so a group of copies that holds a third of all rows is a few rows in the exchange.

A digest that was hit is then checked against the full bytes: those of the batch's rows, and those that the entry's locator points at
if they came earlier. Per digest, the smallest and the largest normalised text are equal exactly if all are. Where they differ, the
digest collided and its rows are regrouped by the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import fold_ascii, quoted
from .scratch import Scratch, folders, is_there, small

#: State on disk; without space set aside beforehand, which is several MB for each partition of the state.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}

#: Files that earlier content is read from without being told, at most.
MOST_FILES = 10_000


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, *, state_dir: str | None = None, batch: str | None = None, earlier: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 files_per_trigger: int | None = None, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal
    texts the row with the largest id stays. Rows that repeat an id: each gets a row; all
    that carry the largest id of the group are ``kept``. Null ids are smaller than any other. An empty table gives an
    empty result; a very long text is read whole. Other columns of ``docs`` are ignored, whatever their names.

    ``state_dir``: a shared folder that keeps the state; each call with it is a batch that comes after all earlier ones, and keep_id and
    group_size count their rows, too (those that were given out before stay as they were). ``earlier``: a table of the earlier batches' rows, with ids and texts, where their content is
    looked up; else it is read from the Parquet files that they came from, with the same column names. If digests collide, rows of one batch are told apart by their texts, and a batch's rows from the
    entry that they hit.

    ``batch``: a name for the rows of this call. A call with a name that the state has seen counts its rows once: one that failed midway goes on, one that ended gives
    what it gave, even if other batches came after. Without a name each call is a batch of its own. ``files_per_trigger``: arrivals' files of a micro-batch; else at
    least 64, and so many that there are no more than 16 micro-batches.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    place = state_dir.rstrip("/") if state_dir else scratch.path("kept")
    rows = _contents(docs, id_col, text_col)
    seen = folders(spark, f"{place}/arrivals")
    number = int(hashlib.md5(batch.encode()).hexdigest()[:12], 16) if batch is not None else len(seen)
    arrived = f"{place}/arrivals/batch={number}"
    before = _noted(spark, f"{place}/before/batch={number}", lambda: _last(spark, place))
    if not is_there(spark, f"{arrived}/_SUCCESS"):  # nothing is taken into the state before all is written
        rows.select("doc_id", digest(F.col("normal")).alias("digest"), sha256_hex(F.col("normal")).alias("text_sha256"),
                    F.struct("file", "doc_id").alias("locator")).write.mode("overwrite").parquet(arrived)
    arrivals = spark.read.parquet(arrived)
    shape = _aggregated(arrivals).schema
    met = scratch.save(_entries(spark, place, shape, before).join(arrivals.select("digest").distinct(), "digest", "left_semi"), "met") if before >= 0 else None
    old = _located(scratch, met, earlier, id_col, text_col) if met is not None else None
    done = f"{place}/after/batch={number}"
    if not is_there(spark, f"{done}/_SUCCESS"):
        _arrive(spark, place, arrivals.schema, files_per_trigger or max(64, -(-len(arrivals.inputFiles()) // 16)))
    after = _noted(spark, done, lambda: _last(spark, place))
    state = scratch.save(_entries(spark, place, shape, after), "state")  # written, so that the join may split a digest that very many rows have
    grouped = arrivals.join(state, "digest")
    hits = scratch.save(grouped.where("group_size > 1").select(F.col("doc_id").alias("hit_id")).distinct(), "hits")
    texts = (rows.join(small(hits), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
             .select("doc_id", "normal", digest(F.col("normal")).alias("digest"), F.lit(False).alias("old")))
    if old is not None:
        texts = texts.unionByName(old.select("doc_id", "normal", digest(F.col("normal")).alias("digest"), F.lit(True).alias("old")))
    clashes = scratch.save(
        texts.groupBy("digest").agg(F.min("normal").alias("least"), F.max("normal").alias("most"))
        .where("least <> most").select("digest"), "clashes")
    result = ["doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"]
    if clashes.isEmpty():
        return grouped.select(*result)
    whole = rows.select("doc_id", "normal", digest(F.col("normal")).alias("digest"), F.lit(False).alias("old")).unionByName(texts.where("old")).join(clashes, "digest", "left_semi")
    sizes = whole.groupBy("normal").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    split = whole.where("not old").join(sizes, "normal").withColumn("text_sha256", sha256_hex(F.col("normal")))
    return grouped.join(clashes, "digest", "left_anti").select(*result).unionByName(split.select(*result))


def _contents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("normal"), F.input_file_name().alias("file"))


def _located(scratch: Scratch, entries: DataFrame, earlier: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, normal of the rows that the entries' locators point at."""
    if earlier is None:
        files = [r["file"] for r in entries.select("keep_locator.file").distinct().limit(MOST_FILES + 1).collect()]
        if len(files) > MOST_FILES or not all(files):
            raise ValueError("give the earlier batches' rows: they came from too many files, or from none")
        if not files:
            return entries.select("keep_locator.doc_id", F.lit("").alias("normal"))
        earlier = scratch.spark.read.parquet(*map(unquote, files))
    ids = scratch.save(entries.select(F.col("keep_locator.doc_id").alias("hit_id")).distinct(), "located")
    return _contents(earlier, id_col, text_col).join(small(ids), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi").select("doc_id", "normal")


def _last(spark: SparkSession, place: str) -> int:
    """The number of the last micro-batch that the state has taken; -1 if none."""
    return max((int(x.split("=")[1]) for x in folders(spark, f"{place}/updates")), default=-1)


def _noted(spark: SparkSession, path: str, number: Callable[[], int]) -> int:
    """The number that is written down in a folder; if none is, the one that holds now, which is written down."""
    if not is_there(spark, f"{path}/_SUCCESS"):
        spark.range(1).select(F.lit(number()).alias("number")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["number"]


def _entries(spark: SparkSession, place: str, schema: T.StructType, until: int) -> DataFrame:
    """The state as it was after a micro-batch: digest, keep_id, keep_locator, group_size."""
    updates = f"{place}/updates"
    schema = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    seen = spark.read.schema(schema).parquet(updates) if folders(spark, updates) else spark.createDataFrame([], schema)
    return seen.where(F.col("batch") <= until).groupBy("digest").agg(*(F.max_by(c, "batch").alias(c) for c in schema.names if c not in ("digest", "batch")))


def _aggregated(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.max_by("locator", "doc_id").alias("keep_locator"), F.count(F.lit(1)).alias("group_size"))


def _arrive(spark: SparkSession, place: str, schema: T.StructType, files_per_trigger: int) -> None:
    """Lets the arrivals that the state has not seen meet it."""
    entries = _aggregated(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{place}/arrivals"))
    updates = f"{place}/updates"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        query = (entries.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
                 .option("checkpointLocation", f"{place}/stream").start())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
    query.awaitTermination()


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, whatever their names; of rows that repeat an id and its text, one.

    A null text counts as empty, and a null id as one that is smaller than any other. An empty table gives an empty result. Only what goes is joined with the texts: it is the smaller part, and broadcast if it is small.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup-rows")
    groups = scratch.save(exact_groups(docs, id_col=id_col, text_col=text_col, **options), "groups")
    key = [F.col("doc_id").alias("gone"), F.col("text_sha256").alias("gone_sha")]
    gone = scratch.save(groups.where("not kept").select(*key).distinct(), "gone")
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")
    marked = docs.select(row, F.col(quoted(id_col)).alias("id"), sha256_hex(fold_ascii(F.coalesce(F.col(quoted(text_col)), F.lit("")))).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("gone")) & (F.col("sha") == F.col("gone_sha"))
    stay = marked.join(small(gone, 200_000), same, "left_anti")
    again = scratch.save(groups.where("kept").groupBy(*key).count().where("count > 1"), "again")
    if not again.isEmpty():
        once = stay.join(again, same, "left_semi").dropDuplicates(["id", "sha"])
        stay = stay.join(again, same, "left_anti").unionByName(once)
    return stay.select("row.*")
