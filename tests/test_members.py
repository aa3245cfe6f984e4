"""Members of packages by ranges: what is read, what is pushed down, and files that are no packages."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from pagewright.functions.wordml import DOCUMENT
from pagewright.plans import samples
from pagewright.sources import docx
from pagewright.sources.members import read_members


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    for i in range(3):
        picture = os.urandom(3_000_000)
        (tmp_path / "deep" / f"{i}.docx").write_bytes(samples.package(samples.paragraph_xml(1, [("", f"text {i}")]), (("word/media/a.png", picture), ("[Content_Types].xml", b"<Types/>"))))
    (tmp_path / "other.txt").write_text("no package")
    return tmp_path


def test_a_filter_on_the_name_reads_only_that_member(spark, folder):
    main = read_members(spark, str(folder)).where(F.col("arcname") == DOCUMENT)
    rows = main.collect()
    assert len(rows) == 3 and all(r["size"] > 3_000_000 and r["bytes_read"] < 20_000 and r["part_ord"] == 2 for r in rows)
    assert sorted(r["text"] for r in docx.part_runs(main).collect()) == ["text 0", "text 1", "text 2"]
    listed = read_members(spark, f"file://{folder}").where(F.col("arcname").isin("[Content_Types].xml", DOCUMENT) & (F.col("size") > 0))
    assert listed.count() == 6 and listed.agg(F.max("bytes_read")).first()[0] < 30_000


def test_all_members_are_as_zipfile_has_them(spark, folder):
    got = {(os.path.basename(r["path"]), r["part_ord"]): (r["arcname"], bytes(r["data"])) for r in read_members(spark, str(folder), partitionBytes="1").collect()}
    for i in range(3):
        with zipfile.ZipFile(folder / "deep" / f"{i}.docx") as package:
            assert [got[f"{i}.docx", at] for at in range(3)] == [(x.filename, package.read(x)) for x in package.infolist()]
    assert read_members(spark, str(folder), partitionBytes="1").rdd.getNumPartitions() == 3
    assert read_members(spark, str(folder / "deep" / "1.docx")).count() == 3


def test_no_files_empty_ones_and_broken_ones(spark, tmp_path):
    assert read_members(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="is not there"):
        read_members(spark, str(tmp_path / "none")).count()
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    (tmp_path / "empty.docx").write_bytes(empty.getvalue())
    assert read_members(spark, str(tmp_path)).count() == 0
    good = samples.package(samples.paragraph_xml(1, [("", "x" * 5000)]))
    for name, content in (("good", good), ("cut", good[:-100]), ("nothing", b""), ("changed", good.replace(b"<", b"<")[:60] + bytes(40) + good[100:])):
        (tmp_path / f"{name}.docx").write_bytes(content)
    with pytest.raises(Exception, match="is no package"):
        read_members(spark, str(tmp_path)).count()
    kept = read_members(spark, str(tmp_path), skipBroken="true").collect()
    assert {os.path.basename(r["path"]) for r in kept if r["arcname"] == DOCUMENT} >= {"good.docx"} and not any(os.path.basename(r["path"]) in ("cut.docx", "nothing.docx") for r in kept)
