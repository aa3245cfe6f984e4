"""Checks of files that are told apart by digests give what the whole comparison gives; arriving files, too."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import checks
from pagewright.sources.chunks import read_lines
from pagewright.streaming.arriving import check_arriving

SHAPE = "file_name string, line_no int, line string"


def told(faults):
    return sorted((tuple(r) for r in faults.select("file_name", "line_no", "severity", "rule", "detail").collect()), key=repr)


def sides(rng):
    """Files that are equal, differ in a line, in their number of lines or their order, are on one side only, or have no lines."""
    lines = lambda n: [rng.choice(["[0000000{}] plain", "[0000000{}] <b=1>x</b=1>", "no id {}", "[0000000{}] <b>x</i>", "", "[0000000{}] é‹F1:b›"]).format(i) for i in range(n)]
    mine, theirs = [], []
    for f in range(40):
        a = lines(rng.randint(0, 6))
        b = list(a)
        kind = f % 8
        if kind == 1 and b:
            b[rng.randrange(len(b))] = "[0000000F] <b=1,i=2>other</b=1,i=2>"
        elif kind == 2:
            b.append("[00000001] more")
        elif kind == 3:
            b.reverse()
        for side, rows in ((mine, a), (theirs, b)):
            if kind == 4 and side is mine or kind == 5 and side is theirs:
                continue
            side += [(f"chunk_{f}.md", i, x) for i, x in enumerate(rows)] or [(f"chunk_{f}.md", None, None)]
    return [*mine, (None, 0, "x")], theirs


@pytest.mark.parametrize("seed", range(3))
def test_as_the_whole_comparison(spark, seed, monkeypatch):
    mine, theirs = (spark.createDataFrame(x, SHAPE) for x in sides(random.Random(seed)))
    if seed == 2:
        monkeypatch.setattr(checks, "BROADCAST", -1)
    want = told(checks.verify(mine, theirs))
    assert len(want) > 20 and told(checks.verify_changed(mine, theirs)) == want
    assert told(checks.verify_changed(mine, theirs, stored=checks.file_digests(theirs))) == want
    empty = spark.createDataFrame([], SHAPE)
    for a, b in ((mine, mine), (mine, empty), (empty, theirs), (empty, empty)):
        assert told(checks.verify_changed(a, b)) == told(checks.verify(a, b))


def test_digests_see_order_numbers_and_nulls(spark):
    files = {"a": [(0, "x"), (1, "y")], "b": [(0, "y"), (1, "x")], "c": [(0, "x"), (2, "y")], "d": [(0, "x")], "e": [(0, None)], "f": [(0, "")], "g": [(None, None)], "h": [(0, "x"), (0, "x")]}
    rows = [(f, *x) for f, some in files.items() for x in some]
    digests = checks.file_digests(spark.createDataFrame(rows, SHAPE))
    assert digests.count() == digests.select("digest").distinct().count() == len(files)
    assert sorted(digests.collect()) == sorted(checks.file_digests(spark.createDataFrame(rows[::-1], SHAPE).repartition(3)).collect())


def test_files_are_checked_as_they_come(spark, tmp_path):
    origin, folder = tmp_path / "origin", tmp_path / "in"
    origin.mkdir()
    folder.mkdir()
    for i in range(4):
        (origin / f"chunk_{i}.md").write_text(f"[0000000{i}] <b=1>x</b=1>\n[0000001{i}] y")
    lines = read_lines(spark, str(origin))
    checks.file_digests(lines).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    run = lambda: check_arriving(spark, str(folder), lines, stored, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    (folder / "chunk_0.md").write_text((origin / "chunk_0.md").read_text())
    (folder / "chunk_1.md").write_text("[00000001] x\n[00000011] y")
    run()
    (folder / "chunk_2.md").write_text("[00000002] <b=1>x</b=1>")
    (folder / "chunk_9.md").write_text("[00000009] z")
    (folder / "chunk_3.md").write_bytes(b"\xff\xfe")
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    found = sorted((r["file_name"], r["rule"], r["detail"], r["batch"]) for r in got.where(F.col("rule") != "READ_FAILED").collect())
    assert [x for x in found if x[0] != "chunk_3.md"] == [("chunk_1.md", "TAG_TYPE_MISSING", "b=1", 0), ("chunk_2.md", "CHUNK_LINE_MISSING", None, 1), ("chunk_2.md", "LINE_COUNT", "1 2", 1), ("chunk_9.md", "ONLY_IN_CHUNKS", None, 1)]
    assert [r["file_name"] for r in got.where("rule = 'READ_FAILED'").collect()] == ["chunk_3.md"]
