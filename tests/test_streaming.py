"""Packages that come one after another are each shredded once."""

import time

import pytest

from pagewright.operators.counters import StreamCounters
from pagewright.plans import samples
from pagewright.sources import docx
from pagewright.sources.docx import RUNS
from pagewright.streaming import attempts, profile
from pagewright.streaming.ingest import ingest


def test_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    counters = StreamCounters()
    spark.streams.addListener(counters)
    for i in range(2):
        (folder / f"{i}.docx").write_bytes(samples.package(samples.paragraph_xml(1, [("", f"text {i}")])))
        ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = spark.read.schema(RUNS).parquet(str(tmp_path / "out"))
    assert sorted(r["text"] for r in got.collect()) == ["text 0", "text 1"]
    for _ in range(100):  # what was observed is told some time after the query has ended
        if counters.sums.get(("ingest", "rows")) == 2:
            break
        time.sleep(0.2)
    spark.streams.removeListener(counters)
    assert sorted(map(tuple, counters.table(spark).collect())) == [("ingest", "characters", 12), ("ingest", "rows", 2)]


def test_a_file_is_flagged_at_its_third_wrong_version(spark, tmp_path):
    place = lambda x: str(tmp_path / x)
    batches = [[("a", 1, 2), ("b", 1, 1), ("c", 1, 0)], [("a", 2, 1), ("b", 2, 0), ("a", 1, 2), (None, 1, 1)], [("a", 3, 1), ("b", 3, 1), ("b", 3, 1), ("b", 4, 5)]]
    for rows in batches:  # a new start each time, on the state of the one before
        spark.createDataFrame(rows, attempts.CHECKED).write.mode("append").parquet(place("checked"))
        attempts.follow(spark, place("checked"), place("tried"), place("log")).awaitTermination()
    tried = spark.read.schema(attempts.TRIED).parquet(place("tried"))
    assert sorted(map(tuple, attempts.standing(tried).collect())) == [("a", 3, True), ("b", 2, False)]
    assert sorted((r["version"], r["attempt"]) for r in tried.where("file_name = 'a'").collect()) == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("keep_ms, want", [(0, [("a", 3, True), ("b", 1, False)]), (1, [("a", 1, False), ("b", 1, False)])])
def test_files_in_one_bucket(spark, tmp_path, keep_ms, want):
    place = lambda x: str(tmp_path / x)
    for rows in [[("a", 1, 2), ("b", 1, 1), ("c", 1, 1)], [("a", 2, 1), ("b", 2, 0), ("c", 2, 0)], [("b", 3, 1), ("a", 3, 1)]]:
        spark.createDataFrame(rows, attempts.CHECKED).write.mode("append").parquet(place("checked"))
        attempts.follow(spark, place("checked"), place("tried"), place("log"), keep_ms=keep_ms, buckets=1).awaitTermination()
    assert sorted(map(tuple, attempts.standing(spark.read.schema(attempts.TRIED).parquet(place("tried"))).collect())) == want


def test_attempts_at_many_files(spark, tmp_path):
    def took(n):
        place = lambda x: str(tmp_path / f"{n}-{x}")
        spark.range(n).selectExpr("concat('chunk_', id) AS file_name", "1L AS version", "id % 2 AS n_errors").write.parquet(place("checked"))
        began = time.monotonic()
        attempts.follow(spark, place("checked"), place("tried"), place("log")).awaitTermination()
        assert spark.read.schema(attempts.TRIED).parquet(place("tried")).where("attempt = 1").count() == n // 2
        return time.monotonic() - began

    took(10)
    assert took(12_000) < 3 * took(1_000)


def test_categories_of_all_packages_that_came(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    place = lambda x: str(tmp_path / x)
    batches = [[("<w:b/>", "a"), ("", "b"), ("", "c")], [("<w:b/>", "d"), ("<w:b/>", "e"), ("<w:i/>", "f")]]
    for i, some in enumerate(batches):  # a new start each time, on the state of the one before
        (folder / f"{i}.docx").write_bytes(samples.package(samples.paragraph_xml(1, some)))
        profile.count_categories(spark, str(folder), place("out"), place("log")).awaitTermination()
    got = profile.ranked(spark.read.parquet(place("out"))).select("cat_id", "cnt", "key.bold", "key.italic", "is_baseline")
    assert sorted(map(tuple, got.collect())) == [("F0", 3, True, False, True), ("F1", 2, False, False, False), ("F2", 1, False, True, False)]
    whole = profile.counted(docx.runs(docx.read_packages(spark, str(folder)))).select("key", "cnt")
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, profile.ranked(spark.read.parquet(place("out"))).select("key", "cnt").collect()), key=repr)
