"""The corpus pipeline: five stages, each written and read again, each on all that the one before it kept.

All but the last give the columns of documents as they are, whatever their names. A null or empty text is scored as the bias alone, is one text among exact
copies, is near to no other, and packs to its end mark; a null id stays. Rows that repeat an id and a text are one after exact dedup.
An empty table gives empty results. Very long texts are held whole, one at a time.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import exact_dedup, jaccard, mixing, packing, quality
from pagewright.llm.queries import WEIGHTS, table, vocabulary
from pagewright.llm.scratch import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles with similarity 0.8 or more."""
    return jaccard.near_dedup(docs, k=5, similarity=Fraction(4, 5))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, WEIGHTS, added=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixed), ("packing", packed)]

#: Learned scores and tokens are not to be had in SQL. tests/llm/test_pipeline.py holds each stage, on what the one before it kept, against a brute-force version, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
