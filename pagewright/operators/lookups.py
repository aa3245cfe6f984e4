"""Lookups: last lines by paragraph, formats by category, parts with overrides; the registry of formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CATEGORY = T.StructType([T.StructField("label", T.StringType()), T.StructField("rpr_xml", T.StringType()), T.StructField("count", T.LongType())])
_CATEGORIES = T.MapType(T.StringType(), _CATEGORY)
REGISTRY = T.StructType([
    T.StructField("doc_hash", T.StringType()),
    T.StructField("paragraphs", T.MapType(T.StringType(), T.StructType([T.StructField("baseline", T.StringType()), T.StructField("categories", _CATEGORIES)]))),
    T.StructField("baseline", T.StringType()), T.StructField("categories", _CATEGORIES)])


def last_by(rows: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The last row's value for each key."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def registry_json(categories: DataFrame, doc: str, para: str) -> DataFrame:
    """One row per document: the doc and ``registry``, JSON of each paragraph's baseline and categories (cat_id, label, rpr_xml, cnt)."""
    entry = F.struct(F.col("cat_id").alias("key"), F.struct("label", "rpr_xml", F.col("cnt").alias("count")).alias("value"))
    paras = categories.groupBy(doc, F.col(para).cast("string").alias("key")).agg(F.min(F.when(F.col("is_baseline"), F.col("cat_id"))).alias("baseline"), F.array_sort(F.collect_list(entry)).alias("entries"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("key", "baseline", "entries"))),
                        lambda e: F.struct(e["key"].alias("key"), F.struct(e["baseline"].alias("baseline"), F.map_from_entries(e["entries"]).alias("categories")).alias("value")))
    return paras.groupBy(doc).agg(F.to_json(F.struct(F.col(doc).cast("string").alias("doc_hash"), F.map_from_entries(whole).alias("paragraphs")), {"ignoreNullFields": "false"}).alias("registry"))


def registry_rows(registry: Column, frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of registries in JSON, of either form: ``keep``, para_id (upper-cased; null: for all paragraphs), baseline, cat_id, label, rpr_xml, cnt."""
    read = frame.select(*keep, F.from_json(registry, REGISTRY).alias("_r"))
    paras = read.where("_r.paragraphs is not null").select(*keep, F.explode("_r.paragraphs").alias("para_id", "_p")).select(*keep, F.upper("para_id").alias("para_id"), F.col("_p.baseline").alias("baseline"), F.explode_outer("_p.categories").alias("cat_id", "_c"))
    whole = read.where("_r.paragraphs is null and _r.categories is not null").select(*keep, F.lit(None).cast("string").alias("para_id"), F.col("_r.baseline").alias("baseline"), F.explode_outer("_r.categories").alias("cat_id", "_c"))
    return paras.unionByName(whole).select(*keep, "para_id", F.coalesce("baseline", F.lit("F0")).alias("baseline"), "cat_id", "_c.label", "_c.rpr_xml", F.col("_c.count").alias("cnt"))


def registry_formats(registry: Column, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Registries in JSON, of either form, by paragraph: ``keep``, para_id (upper-cased; null: for all paragraphs), formats (properties by category), base (those of the baseline).

    Ids that differ in case only: the last by its name. A paragraph's categories stay together, so nothing larger than they are is ever one value.
    """
    read = frame.select(*keep, F.from_json(registry, REGISTRY).alias("_r"))
    paras = read.where("_r.paragraphs is not null").select(*keep, F.explode("_r.paragraphs").alias("_key", "_p"))
    whole = read.where("_r.paragraphs is null and _r.categories is not null").select(*keep, F.lit(None).cast("string").alias("_key"), F.struct(F.col("_r.baseline").alias("baseline"), F.col("_r.categories").alias("categories")).alias("_p"))
    last = paras.unionByName(whole).groupBy(*keep, F.upper("_key").alias("para_id")).agg(F.max_by("_p", F.coalesce("_key", F.lit(""))).alias("_p"))
    formats = F.transform_values(F.coalesce("_p.categories", F.create_map().cast(_CATEGORIES)), lambda _, c: c["rpr_xml"])
    return last.withColumn("formats", formats).select(*keep, "para_id", "formats", F.try_element_at("formats", F.coalesce("_p.baseline", F.lit("F0"))).alias("base"))


def lookup_formats(wanted: DataFrame, by_para: DataFrame, overall: DataFrame, para: Sequence[str], value: str) -> DataFrame:
    """``wanted`` (``para``, cat_id) with ``value``: the paragraph's if it has any categories, even if not this one; only else the one for all.

    ``by_para``: ``para``, cat_id, value; ``overall``: cat_id, value.
    """
    own = by_para.select(*para, "cat_id", F.col(value).alias("_own"))
    known = by_para.select(*para).distinct().withColumn("_known", F.lit(True))
    rest = overall.select("cat_id", F.col(value).alias("_rest"))
    found = wanted.join(own, [*para, "cat_id"], "left").join(known, list(para), "left").join(rest, "cat_id", "left")
    return found.select(*wanted.columns, F.when(F.col("_known"), F.col("_own")).otherwise(F.col("_rest")).alias(value))


def override(parts: DataFrame, overrides: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """``parts`` with the value of ``overrides`` where there is one for the key; and ``overridden``."""
    new = overrides.select(*key, F.col(value).alias("_new"), F.lit(True).alias("_there"))
    joined = parts.join(new, list(key), "left")
    return joined.select(*[F.when(F.col("_there"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == value else F.col(c) for c in parts.columns], F.coalesce("_there", F.lit(False)).alias("overridden"))
