"""Packages (.docx): read, shredded to runs, and written."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.formats import FORMAT
from ..functions.wordml import DOCUMENT, as_utf8, outline, part, read_runs, spans, unzip

RUNS = T.StructType([
    T.StructField("doc_hash", T.StringType()), T.StructField("para_ord", T.IntegerType()), T.StructField("para_id", T.StringType()), T.StructField("run_ord", T.IntegerType()),
    T.StructField("fmt", FORMAT), T.StructField("rpr_xml", T.StringType()), T.StructField("text", T.StringType()), T.StructField("formulas", T.ArrayType(T.StringType()))])


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, doc_hash of each package under ``path``."""
    return as_packages(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "length", "content"))


def as_packages(files: DataFrame) -> DataFrame:
    return files.withColumn("doc_hash", F.sha2("content", 256))


#: Documents whose rows leave together, and bytes of what is taken out of Arrow for them at once.
DOCUMENTS, BYTES = 64, 1 << 20
#: Packages or paragraphs that Spark sends to a Python worker at once while tables of them are written: a worker holds two such batches, however many rows a task has.
SENT_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: what Spark sends together may be ten thousand, which as Python objects are many times their bytes. Memory that Arrow holds without use is given back."""
    for batch in batches:
        step = max(1, min(DOCUMENTS, BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        pa.default_memory_pool().release_unused()


def parts(packages: DataFrame) -> DataFrame:
    """doc_hash, part_ord, arcname, data of each part of each package."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_hashes, contents in _some(batches):
            rows = [(doc_hash, i, name, data) for doc_hash, content in zip(doc_hashes, contents, strict=True) for i, (name, data) in enumerate(unzip(content))]
            kinds = {"doc_hash": pa.string(), "part_ord": pa.int32(), "arcname": pa.string(), "data": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    return packages.select("doc_hash", "content").mapInArrow(run, "doc_hash string, part_ord int, arcname string, data binary")


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Hashes and contents of a few packages at a time."""
    for batch in slices(batches):
        yield tuple(c.to_pylist() for c in batch.columns)


def runs(packages: DataFrame, *, compat: bool = False) -> DataFrame:
    """The runs of each package's main part. One document is parsed at a time; the rows of a few leave together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(RUNS)
        for doc_hashes, contents in _some(batches):
            rows = []
            for doc_hash, content in zip(doc_hashes, contents, strict=True):
                xml = part(content, DOCUMENT)
                rows += [(doc_hash, *x) for x in read_runs(xml, compat=compat)] if xml else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(shape)], names=RUNS.names)

    return packages.select("doc_hash", "content").mapInArrow(run, RUNS)


def part_runs(members: DataFrame, *, compat: bool = False) -> DataFrame:
    """path and runs of main parts that were read by themselves (path, data)."""
    shape = T.StructType([T.StructField("path", T.StringType()), *RUNS.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, parts in _some(batches):
            rows = [(path, *x) for path, xml in zip(paths, parts, strict=True) if xml for x in read_runs(xml, compat=compat)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(to_arrow_schema(shape))], names=shape.names)

    return members.select("path", "data").mapInArrow(run, shape)


class _Runs:
    """A package's runs as rows, for SQL."""

    def eval(self, content: bytes | None):
        xml = part(bytes(content), DOCUMENT) if content is not None else None
        for x in read_runs(xml) if xml else []:
            yield x.para_ord, x.para_id, x.run_ord, x.fmt and Row(**x.fmt), x.rpr_xml, x.text, x.formulas


def register_runs(spark: SparkSession, name: str = "docx_runs") -> None:
    """Makes a package's runs a table function: ``SELECT ... FROM packages, LATERAL docx_runs(content)``. A package that is null or without a main part has none."""
    spark.udtf.register(name, F.udtf(_Runs, returnType=T.StructType(RUNS.fields[1:]), useArrow=True))


def outlines(packages: DataFrame) -> DataFrame:
    """doc_hash, para_ord, outline: what is in each paragraph of the main part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_hashes, contents in _some(batches):
            rows = [(doc_hash, *x) for doc_hash, content in zip(doc_hashes, contents, strict=True) if (xml := part(content, DOCUMENT)) for x in outline(xml)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string()))], names=["doc_hash", "para_ord", "outline"])

    return packages.select("doc_hash", "content").mapInArrow(run, "doc_hash string, para_ord int, outline string")


SPANS = T.StructType([
    T.StructField("doc_hash", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("para_ids", T.ArrayType(T.StringType())),
    T.StructField("xml", T.StringType()), T.StructField("spaces", T.MapType(T.StringType(), T.StringType()))])


def paragraph_spans(packages: DataFrame, *, compat: bool = False) -> DataFrame:
    """The outermost paragraphs of each package's main part: where their bytes are, the ids of them and of those in them, their XML and what its prefixes stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(SPANS)
        for doc_hashes, contents in _some(batches):
            rows = [(doc_hash, *x) for doc_hash, content in zip(doc_hashes, contents, strict=True) if (xml := part(content, DOCUMENT)) for x in spans(as_utf8(xml), compat=compat)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(shape)], names=SPANS.names)

    return packages.select("doc_hash", "content").mapInArrow(run, SPANS)
