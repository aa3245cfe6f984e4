"""Work that grows in proportion to the input: four times as much takes about four times as long."""

import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators.chunking import pack_chunks


def took(frame):
    began = time.monotonic()
    frame.write.format("noop").mode("overwrite").save()
    return time.monotonic() - began


@pytest.mark.parametrize("expression", [text.split_formulas, text.math_to_latex, text.segments])
def test_formulas_and_tags(spark, expression):
    def line(n):
        return spark.range(1).select(expression(F.concat(F.repeat(F.lit("a $x→1$ b ‹F1:b›c‹/› "), n), F.col("id").cast("string"))).alias("x"))

    took(line(100))
    assert took(line(32_000)) < 8 * max(took(line(8_000)), 0.3)


def test_tags_by_fold_and_by_depth(spark):
    lines = ["", "x", "<b>", "</b>", "<b></i>", "<b><i></b></i></u><s>", "<b></b></b><b>", "<b>" * 1200 + "</i>" * 1300]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(*(f(F.col("line")).alias(n) for n, f in (("a", text.folded_faults), ("b", text.placed_faults), ("c", text.tag_faults))))
    assert all(r["a"] == r["b"] == r["c"] for r in rows.collect())


def test_chunks_of_one_long_document(spark):
    def lines(n):
        return pack_chunks(spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("ord"), (F.col("id") % 90).alias("n")), ["doc"], "ord", "n")

    took(lines(100))
    assert took(lines(400_000)) < 8 * max(took(lines(100_000)), 0.3)


@pytest.mark.parametrize("piece", ["<b>", "</b>", "<b></i>", "<b>x</b>"])
def test_faults_of_a_line_of_many_tags(spark, piece):
    def line(n):
        return spark.range(1).select(text.tag_faults(F.concat(F.repeat(F.lit(piece), n), F.col("id").cast("string"))).alias("x"))

    took(line(100))
    assert took(line(32_000)) < 8 * max(took(line(8_000)), 0.5)
