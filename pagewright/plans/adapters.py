"""Ordinary tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: doc_id, line_ord, para_id (eight hexadecimal digits of line_ord), text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_ord", "text"))
    return docs.select("doc_id", "line_ord", F.lpad(F.hex("line_ord"), 8, "0").alias("para_id"), "text")


def edited_lines(spark: SparkSession, sf_dir: str, *, some: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines of each document as a file (file_name, line_no, line), edited and original: some lines lost, some without an id, some with another's, some with tags. ``some``: one file in ten is edited; of others, some first lines have no id on either side."""
    base = lines(spark, sf_dir)
    name = F.concat(F.lit("chunk_"), F.col("doc_id").cast("string"), F.lit(".md"))
    at = F.col("doc_id") * 7 + F.col("line_ord")
    tags = F.concat(F.lit("[") , F.col("para_id"), F.lit("] <b=1,i=2>"), F.col("text"), F.lit("</b=1,i=2>"))
    plain = F.concat(F.lit("["), F.col("para_id"), F.lit("] "), F.col("text"))
    first = F.when(at % 5 == 0, tags).otherwise(plain)
    first = F.when((F.col("doc_id") % 30 == 1) & (F.col("line_ord") == 0), F.col("text")).otherwise(first) if some else first
    original = base.select(name.alias("file_name"), F.col("line_ord").alias("line_no"), first.alias("line"), "doc_id")
    changed = (F.when(at % 11 == 3, F.col("text")).when(at % 13 == 4, F.concat(F.lit("[0000FFFF] "), F.col("text"))).when(at % 17 == 5, F.concat(F.lit("["), F.col("para_id"), F.lit("] <b>x</i> </u> <s>")))
               .when(at % 10 == 0, plain).when(at % 5 == 0, tags).otherwise(plain))
    kept = (at % 19 != 6) | (F.col("line_ord") == 0)
    if some:
        changed, kept = F.when(F.col("doc_id") % 10 != 0, first).otherwise(changed), kept | (F.col("doc_id") % 10 != 0)
    edited = base.where(kept).where("doc_id % 23 <> 7").select(name.alias("file_name"), F.col("line_ord").alias("line_no"), changed.alias("line"))
    return edited, original.where("doc_id % 29 <> 11").drop("doc_id")
