"""Rows of packages are taken out of Arrow a few at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.plans import documents, samples
from pagewright.scratch import SENT, sent_at_once
from pagewright.sources import docx
from pagewright.sources.docx import BYTES, DOCUMENTS, slices


def test_slices_by_rows_and_bytes():
    small = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["a"])
    large = pa.RecordBatch.from_arrays([pa.array([b"%d" % i + b"x" * (BYTES // 4) for i in range(40)], pa.binary())], names=["a"])
    none = small.slice(0, 0)
    got = list(slices(iter([small, large, none])))
    assert [x for b in got for x in b.column(0).to_pylist()] == small.column(0).to_pylist() + large.column(0).to_pylist()
    assert max(b.num_rows for b in got[:157]) == DOCUMENTS and max(b.num_rows for b in got[157:]) == 3


def test_few_rows_are_sent_at_once(spark, monkeypatch):
    made = docx.as_packages(spark.createDataFrame([(f"{i}.docx", samples.package(samples.paragraph_xml(i, [("", f"text {i}")]))) for i in range(3 * docx.SENT_ROWS)], "path string, content binary").coalesce(1))
    lines, none = made.select("doc_hash", F.lit("new").alias("text"), F.upper(F.lpad(F.hex(F.regexp_extract("path", "[0-9]+", 0).cast("long")), 8, "0")).alias("para_id")), spark.createDataFrame([], "doc_hash string, registry string")
    most = docx.SENT_ROWS

    def checked(batches):
        for batch in batches:
            assert batch.num_rows <= most, batch.num_rows
            yield batch

    monkeypatch.setattr(documents, "slices", checked)
    monkeypatch.setattr(docx, "slices", checked)
    before = spark.conf.get(SENT)
    rebuilt = documents.rebuild(made, lines, none)
    assert "MapInArrow" not in rebuilt._jdf.queryExecution().toString()  # a written table
    assert spark.conf.get(SENT) == before
    monkeypatch.undo()
    assert [tuple(x) for x in documents.shred(rebuilt).groupBy("text").count().collect()] == [("new", 3 * most)]


def test_fewer_rows_stay_fewer(spark):
    before = spark.conf.get(SENT)
    try:
        spark.conf.set(SENT, 7)
        with sent_at_once(spark, 100):
            assert spark.conf.get(SENT) == "7"
        spark.conf.set(SENT, 0)  # no limit
        with sent_at_once(spark, 100):
            assert spark.conf.get(SENT) == "100"
        assert spark.conf.get(SENT) == "0"
    finally:
        spark.conf.set(SENT, before)
