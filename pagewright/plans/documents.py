"""The three plans over documents: extract to chunks and registries, verify edits, rebuild."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, text
from ..functions.wordml import DOCUMENT, as_utf8, rebuild_span, spliced, unzip, zip_parts
from ..operators import chunking, formatting, lookups
from ..scratch import Scratch
from ..sources import docx
from ..sources.docx import SENT_ROWS, slices

PARA = ["doc_hash", "para_ord"]


def shred(packages: DataFrame, *, compat: bool = False) -> DataFrame:
    """The runs of all packages, parsed once, as a written table."""
    return Scratch(packages.sparkSession, "runs", SENT_ROWS).save(docx.runs(packages, compat=compat), "runs")


def categories(runs: DataFrame) -> DataFrame:
    """Categories of each paragraph, with label, hint and the first run's properties."""
    keyed = runs.withColumn("key", formats.category_key(F.col("fmt")))
    found = formatting.rank_categories(keyed, [*PARA, "para_id"], "key", "run_ord", firsts=["rpr_xml", "fmt"])
    return found.select("*", formats.label(F.col("fmt")).alias("label"), formats.hint(F.col("fmt")).alias("hint")).drop("fmt")


def profile(runs: DataFrame) -> DataFrame:
    """Categories of each whole document, counted over all its paragraphs, with label and hint."""
    keyed = runs.select("doc_hash", F.struct("para_ord", "run_ord").alias("place"), formats.category_key(F.col("fmt")).alias("key"), "fmt")
    found = formatting.rank_categories(keyed, ["doc_hash"], "key", "place", firsts=["fmt"])
    return found.select("doc_hash", "cat_id", "cnt", "is_baseline", formats.label(F.col("fmt")).alias("label"), formats.hint(F.col("fmt")).alias("hint"))


def tagged_paragraphs(runs: DataFrame, *, compat: bool = False) -> DataFrame:
    """doc_hash, para_ord, para_id, text: tagged; paragraphs that are blank or hold formulas only are left out.

    Counts, ranks, islands and texts of a paragraph all come from one exchange on it.
    """
    keyed = runs.withColumn("key", formats.category_key(F.col("fmt")))
    of_key, of_para = Window.partitionBy(*PARA, "key"), Window.partitionBy(*PARA)
    counted = keyed.select("*", F.count(F.lit(1)).over(of_key).alias("cnt"), F.min("run_ord").over(of_key).alias("first_ord"))
    rank = F.dense_rank().over(of_para.orderBy(F.col("key").isNull(), F.desc("cnt"), "first_ord")) - 1
    ranked = counted.select("*", F.when(F.col("key").isNotNull(), rank).alias("rank"), F.max(F.col("key").isNotNull()).over(of_para).alias("any"))
    cats = ranked.where("any").select(*PARA, "para_id", "run_ord", "text", "formulas", F.concat(F.lit("F"), F.col("rank").cast("string")).alias("cat_id"),
                                      formats.hint(F.col("fmt")).alias("hint"), (F.col("rank") == 0).alias("is_baseline"))
    tagged = formatting.tag_text(cats, [*PARA, "para_id"], "run_ord", formulas="formulas", compat=compat)
    return tagged.where(~text.is_blank(F.col("text"))).withColumn("text", text.math_to_latex(F.col("text"), compat=compat))


def extract(runs: DataFrame, *, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Chunks (doc_hash, chunk_idx, line_no, para_ord, para_id, text) and registries (doc_hash, registry).

    ``runs`` is read for both: it should be a written table, as ``shred`` gives.
    """
    cats = categories(runs)
    paragraphs = tagged_paragraphs(runs, compat=compat)
    chunks = chunking.pack_chunks(paragraphs.withColumn("n_chars", F.length("text")), ["doc_hash"], "para_ord", "n_chars", orders=runs.select("doc_hash", "para_ord"))
    shown = cats.join(paragraphs.select(*PARA), PARA, "left_semi")
    last = shown.join(shown.groupBy("doc_hash", "para_id").agg(F.max("para_ord").alias("para_ord")), ["doc_hash", "para_id", "para_ord"], "left_semi")
    return chunks.drop("n_chars"), lookups.registry_json(last, "doc_hash", "para_id")


#: Bytes of new paragraphs that are sent to where the packages are; beyond it, packages and paragraphs meet in an exchange.
BROADCAST = 32 << 20


def rebuild(packages: DataFrame, texts: DataFrame, registries: DataFrame, *, order: Sequence[str] = ("text",), compat: bool = False) -> DataFrame:
    """doc_hash, content of each package with edited paragraphs (doc_hash, para_id, text, ``order``) and registries (doc_hash, registry).

    Of texts with one id the last by ``order`` goes to all paragraphs that have it. Edits, formats and paragraphs are rows that meet by document and id, so a long document is
    as many rows as it has edited paragraphs. Only new paragraphs are gathered by document, and spliced into the bytes of its main part; all other bytes
    stay as they are. Packages wait where they are unless the new paragraphs are too many to be sent there.
    The result is a written table: what reads it in Python has no second worker for each task beside its own.
    """
    scratch = Scratch(packages.sparkSession, "rebuild", SENT_ROWS)
    edits = lookups.last_by(texts.where("para_id is not null and text is not null").withColumn("para_id", F.upper("para_id")), ["doc_hash", "para_id"], "text", order)
    formats = lookups.registry_formats(F.col("registry"), registries, ["doc_hash"])
    overall = formats.where("para_id is null").select("doc_hash", F.col("formats").alias("all_formats"), F.col("base").alias("all_base"))
    known = edits.join(formats.where("para_id is not null"), ["doc_hash", "para_id"], "left").join(overall, "doc_hash", "left")
    own = F.col("formats").isNotNull()
    base = F.when(own, F.col("base")).otherwise(F.col("all_base"))
    ready = known.select("doc_hash", "para_id", "text", base.alias("base"), text.format_parts(
        F.col("text"), F.coalesce("formats", "all_formats", F.create_map().cast("map<string,string>")), base, compat=compat).alias("parts"))
    paragraphs = docx.paragraph_spans(packages, compat=compat).select("doc_hash", "begin", "end", "xml", "spaces", (F.size("para_ids") > 1).alias("holds_more"), F.posexplode("para_ids").alias("number", "para_id"))
    met = scratch.save(paragraphs.withColumn("para_id", F.upper("para_id")).join(ready, ["doc_hash", "para_id"]), "met")  # written: it is read twice
    edit = F.struct("number", "text", "parts", "base")
    span = ["doc_hash", "begin", "end"]
    alone = met.where("not holds_more").select(*span, "xml", "spaces", F.array(edit).alias("edits"))
    more = met.where("holds_more").groupBy(*span).agg(F.min("xml").alias("xml"), F.any_value("spaces").alias("spaces"), F.collect_set(edit).alias("edits"))
    splice = F.struct("begin", "end", "xml")
    new = _built(alone.unionByName(more), compat).groupBy("doc_hash").agg(F.array_sort(F.collect_set(splice)).alias("splices"))
    new = scratch.save(new, "splices")
    size = new.agg(F.sum(F.aggregate("splices", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["xml"]) + 100))).first()[0] or 0
    joined = packages.select("doc_hash", "content").join(F.broadcast(new) if size <= BROADCAST else new, "doc_hash", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            out = [(doc_hash, _with(content, [(x["begin"], x["end"], x["xml"]) for x in splices or []])) for doc_hash, content, splices in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["doc_hash", "content"])

    return scratch.save(joined.select("doc_hash", "content", "splices").mapInArrow(run, "doc_hash string, content binary"), "rebuilt")


def _built(rows: DataFrame, compat: bool) -> DataFrame:
    """doc_hash, begin, end, xml of paragraphs with their edits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for xml, spaces, edits in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                given = {x["number"]: (x["text"], [tuple(p.values()) for p in x["parts"]], x["base"]) for x in edits}
                out.append(rebuild_span(xml, spaces, given, compat=compat))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.string())], names=["doc_hash", "begin", "end", "xml"])

    return rows.select("doc_hash", "begin", "end", "xml", "spaces", "edits").mapInArrow(run, "doc_hash string, begin long, end long, xml string")


def _with(content: bytes, splices: list[tuple[int, int, str]]) -> bytes:
    return zip_parts([(name, spliced(as_utf8(data), splices) if name == DOCUMENT and splices else data) for name, data in unzip(content)])
