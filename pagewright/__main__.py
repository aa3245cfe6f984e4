"""python -m pagewright extract FILE OUT | verify CHUNKS ORIGIN | rebuild FILE CHUNKS REGISTRY OUT"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks
from .operators.counters import Counters
from .plans import documents
from .scratch import Scratch, is_there
from .sources import chunks, docx


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser("pagewright")
    parser.add_argument("--compat", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in {"extract": ("file", "out"), "verify": ("chunks", "origin"), "rebuild": ("file", "chunks", "registry", "out")}.items():
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("pagewright").getOrCreate()
    return {"extract": extract, "verify": verify, "rebuild": rebuild}[given.command](spark, given)


CHUNKS = "chunk_*.md"


def _packages(spark: SparkSession, path: str) -> DataFrame | None:
    """The packages under a path; if there are none, says so."""
    found = docx.read_packages(spark, path) if is_there(spark, path) else None
    if found is None or found.isEmpty():
        print(f"error: no package *.docx at {path}")
        return None
    return found


def _told(counters: Counters) -> None:
    for step, counter, value in counters.values():
        print(f"{step}: {value} {counter}")


def extract(spark: SparkSession, given: argparse.Namespace) -> int:
    """Chunks and registry in a folder named by the document's hash; the chunks once more under ``origin_chunks``, to be edited against."""
    if (packages := _packages(spark, given.file)) is None:
        return 1
    lines, registries = documents.extract(documents.shred(packages, compat=given.compat), compat=given.compat)
    counters = Counters(spark)
    lines = counters.count(lines, "paragraphs", characters=F.length("text"))
    written = Scratch(spark, "chunks").save(counters.count(chunks.chunk_files(lines, "doc_hash"), "chunks", bytes=F.octet_length("content")), "files")
    _told(counters)
    n, size = chunks.write_files(written.unionByName(registries.select("doc_hash", F.lit("format_registry.json").alias("file_name"), F.col("registry").alias("content"))), given.out, "doc_hash", replaces=CHUNKS)
    chunks.write_files(written.withColumn("folder", F.concat("doc_hash", F.lit("/origin_chunks"))), given.out, "folder", replaces=CHUNKS)
    print(f"{n} files, {size} bytes")
    return 0


def verify(spark: SparkSession, given: argparse.Namespace) -> int:
    folders = spark.createDataFrame([(x, is_there(spark, x)) for x in (given.chunks, given.origin)], "folder string, there boolean")
    faults = checks.missing_folders(folders)
    if faults.isEmpty():
        unread = [chunks.unread(chunks.read_files(spark, x)) for x in (given.chunks, given.origin)]
        counters = Counters(spark)
        scratch = Scratch(spark, "verify")
        read = [scratch.save(counters.count(chunks.read_lines(spark, x), step), step.split()[0]) for step, x in (("edited lines", given.chunks), ("original lines", given.origin))]
        faults = scratch.save(checks.verify(*read, unread=unread[0].unionByName(unread[1])), "faults")
        _told(counters)
    for x in faults.orderBy("file_name", "line_no", "rule").toLocalIterator():
        print(x["severity"], x["file_name"], x["line_no"], x["rule"], x["detail"])
    return 0 if checks.report(faults).first()["passed"] else 1


def rebuild(spark: SparkSession, given: argparse.Namespace) -> int:
    if (packages := _packages(spark, given.file)) is None:
        return 1
    doc_hash = packages.select("doc_hash").first()["doc_hash"]
    own = F.lit(doc_hash)  # one file: one document, whatever hash its registry has, if any
    texts = chunks.paragraph_map(chunks.read_lines(spark, given.chunks)).withColumn("doc_hash", own)
    if is_there(spark, given.registry):
        registries = spark.read.text(given.registry, wholetext=True).select(own.alias("doc_hash"), F.col("value").alias("registry"))
        made_of = registries.select(F.get_json_object("registry", "$.doc_hash").alias("made_of")).first()
        if made_of and made_of["made_of"] not in (None, doc_hash):
            print(f"warning: {given.registry} was made of another document, {made_of['made_of']}")
    else:
        print(f"warning: no registry {given.registry}")
        registries = spark.createDataFrame([], "doc_hash string, registry string")
    counters = Counters(spark)
    out = counters.count(documents.rebuild(packages, counters.count(texts, "edited paragraphs"), registries, compat=given.compat), "packages", bytes=F.octet_length("content"))
    chunks.write_files(out.select(F.lit("restored.docx").alias("file_name"), "content"), given.out)
    _told(counters)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
