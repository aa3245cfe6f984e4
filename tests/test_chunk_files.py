"""Very many small files: read by tasks of many files each, whatever the number of folders."""

from pagewright.sources import chunks


def test_files_in_many_folders(spark, tmp_path):
    for i in range(120):
        place = tmp_path / f"of-{i}"
        place.mkdir()
        for name, content in (("chunk_0.md", b"a%d" % i), ("chunk_1.md", b"\xff"), ("notes.md", b""), (".hidden.md", b"x"), ("_made.md", b"x")):
            (place / name).write_bytes(content)
    (tmp_path / "chunk_2.md").write_bytes(b"top")
    read = chunks.read_tree(spark, f"file://{tmp_path}", "chunk_*.md")
    theirs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "chunk_*.md").load(str(tmp_path))
    rows = lambda files: sorted((r["path"].removeprefix("file:").lstrip("/"), bytes(r["content"])) for r in files.select("path", "content").collect())
    assert len(rows(read)) == 241 and rows(read) == rows(theirs)
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < theirs.rdd.getNumPartitions()  # tasks
    assert chunks.unread(chunks.as_text(read)).count() == 120


def test_no_files(spark, tmp_path):
    assert chunks.read_tree(spark, f"file://{tmp_path}").collect() == []


def test_files_replace_those_of_their_name(spark, tmp_path):
    for content in (b"old", b"new"):
        files = spark.createDataFrame([(f"f{i % 3}", f"{i}.md", content) for i in range(9)], "folder string, file_name string, content binary")
        assert chunks.write_files(files, f"file://{tmp_path}", "folder") == (9, 27)
    assert {bytes(r["content"]) for r in chunks.read_tree(spark, f"file://{tmp_path}").collect()} == {b"new"}
    assert sorted(x.name for x in tmp_path.iterdir()) == ["f0", "f1", "f2"]
