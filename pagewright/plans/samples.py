"""Packages made from ordinary tables, for queries over documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.omml import W
from ..functions.wordml import DOCUMENT, W14, zip_parts
from ..scratch import Scratch
from ..sources.docx import SENT_ROWS, slices
from .adapters import table

OPEN = f'<w:document xmlns:w="{W[1:-1]}" xmlns:w14="{W14[1:-1]}" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><w:body>'


def paragraph_xml(number: int, runs: list[tuple[str, str]]) -> str:
    """A paragraph of runs (inner XML of the properties, text)."""
    inside = "".join(f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text, quote=False)}</w:t></w:r>' for props, text in runs)
    return f'<w:p w14:paraId="{number:08X}">{inside}</w:p>'


def package(body: str, more: tuple[tuple[str, bytes], ...] = (("[Content_Types].xml", b"<Types/>"),)) -> bytes:
    return zip_parts([*more, (DOCUMENT, f"{OPEN}{body}</w:body></w:document>".encode())])


def conversation_packages(spark: SparkSession, sf_dir: str, *, each: int = 0, picture: int = 0) -> DataFrame:
    """A package for each conversation: a paragraph for each turn, its first words bold, its text whole. ``each``: so many paragraphs share an id; ``picture``: bytes of a picture beside the text."""
    def body(rows: list[dict]) -> str:
        return "".join(paragraph_xml(i // each if each else x["turn"], [("<w:b/>", f"{x['role']} "), ("<w:i/>" if x["turn"] % 2 else "", (x["text"] or "").replace("\n", " ") + " end"), ('<w:sz w:val="24"/>', " x"), ('<w:sz w:val="24"/>', "y")]) for i, x in enumerate(rows))

    return _made(spark, sf_dir, body, picture)


def math(inner: str) -> str:
    return f"<m:oMath>{inner}</m:oMath>"


def letters(text: str) -> str:
    return f"<m:r><m:t>{text}</m:t></m:r>"


PROPERTIES = ('<w:rFonts w:ascii="Arial" w:eastAsia="黑体"/><w:b/><w:i w:val="0"/><w:strike/><w:dstrike w:val="off"/><w:smallCaps/><w:color w:val="FF0000"/><w:sz w:val="28"/>'
              '<w:highlight w:val="yellow"/><w:u w:val="double"/><w:vertAlign w:val="subscript"/>')


def odd_paragraph(turn: int, v: int) -> str:
    """By the turn: a formula beside a run; formulas in runs without text, and empty ones; one in an object; one alone; text between tabs; text among bookmarks, a link and a picture."""
    run = lambda inner: f"<w:r>{inner}</w:r>"
    said = lambda text: f'<w:t xml:space="preserve">{text}</w:t>'
    half = f"<m:f><m:num>{letters(str(v))}</m:num><m:den>{letters('2')}</m:den></m:f>"
    inside = [
        run(said(f"x{v}=")) + math(half),
        run(said("A")) + run(math(letters(f"y{v}"))) + run(math("")) + run("<w:rPr><w:b/></w:rPr>") + run(said("B")),
        run(said("o ") + f"<w:object>{math(letters(f'z{v}'))}</w:object>" + said(" p")),
        math(letters(f"w{v}")),
        run("<w:tab/>") + run(said(f"t{v}")) + run("<w:tab/>"),
        '<w:bookmarkStart w:id="1"/>' + run(f"<w:rPr>{PROPERTIES}</w:rPr>" + said("bold")) + f"<w:hyperlink>{run(said('link'))}</w:hyperlink>" + run("<w:drawing/>") + run(said(f" plain {v}")) + '<w:bookmarkEnd w:id="1"/>',
    ][turn % 6]
    return f'<w:p w14:paraId="{turn:08X}">{inside}</w:p>'


def odd_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package for each conversation: a paragraph of ``odd_paragraph`` for each turn."""
    return _made(spark, sf_dir, lambda rows: "".join(odd_paragraph(x["turn"], len(x["text"] or "")) for x in rows))


def _made(spark: SparkSession, sf_dir: str, body: Callable[[list[dict]], str], picture: int = 0) -> DataFrame:
    """path, length, content, doc_hash, conv_id of a package for each conversation, as a written table."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            ids = some.column(0).to_pylist()
            beside = lambda i: (("word/media/image1.png", hashlib.shake_256(str(i).encode()).digest(picture)),) if picture else ()
            made = [package(body(rows), (("[Content_Types].xml", f"<Types of=\"{i}\"/>".encode()), *beside(i))) for i, rows in zip(ids, some.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([f"{i}.docx" for i in ids]), pa.array(made, pa.binary())], names=["conv_id", "path", "content"])

    made = turns.mapInArrow(run, "conv_id long, path string, content binary")
    return Scratch(spark, "samples", SENT_ROWS).save(made.select("path", F.octet_length("content").cast("long").alias("length"), "content", F.sha2("content", 256).alias("doc_hash"), "conv_id"), "packages")
