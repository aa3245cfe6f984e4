"""Chunk files and registries as text: read by line, written by name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_line, parse_line
from ..scratch import Scratch


def read_files(spark: SparkSession, path: str, glob: str = "chunk_*.md") -> DataFrame:
    """file_name, value of the files under ``path``; the value is null if a file is no UTF-8 text."""
    return as_text(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


#: Files that a task reads, and bytes of them that leave it together.
FILES, TOGETHER = 2000, 1 << 20


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, content of the files in ``root``, a URI of a store that Arrow knows, and in the folders in it (not in those below); names that begin with a dot or a line are left out, as Spark does.

    For very many small files: Spark's own reader lists them to the driver and makes a task of each 32. Here tasks list the folders, and the names, a written table, are dealt over tasks that read
    ``FILES`` each. What one folder holds is listed by one task, so files should be dealt over folders.
    """
    from pyarrow import fs

    scratch, cores, names = Scratch(spark, "read-tree"), spark.sparkContext.defaultParallelism, ["folder", "file_name"]

    def rows(found: list[tuple[str, str | None]]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found[at:at + 10_000]], pa.string()) for i in range(2)], names=names)

    def inside(store, place: str, folder: str) -> list[tuple[str, str | None]]:
        """Files in a folder; of the root, the folders in it, too, without a name."""
        own = [x for x in store.get_file_info(fs.FileSelector(place)) if not x.base_name.startswith((".", "_"))]
        return [(folder, x.base_name) if x.is_file else (x.base_name, None) for x in own if (fnmatch(x.base_name, glob) if x.is_file else not folder)]

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for _ in batches:
            yield from rows(inside(store, base, ""))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                yield from rows(inside(store, f"{base}/{folder}", folder))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        paths, contents, size = [], [], 0
        for batch in batches:
            for folder, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                paths.append("/".join([root, *([folder] if folder else []), name]))
                with store.open_input_stream("/".join([base, *([folder] if folder else []), name])) as file:
                    contents.append(file.read())
                size += len(contents[-1])
                if size >= TOGETHER or len(paths) == FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])

    first = scratch.save(spark.range(0, 1, 1, 1).mapInArrow(top, "folder string, file_name string"), "top")
    found = first.where("file_name is not null")
    folders = first.where("file_name is null")
    found = scratch.save(found.unionByName(folders.repartition(4 * cores).mapInArrow(below, "folder string, file_name string")), "names")
    return found.repartition(max(cores, -(-found.count() // FILES))).mapInArrow(read, "path string, content binary")


def as_text(files: DataFrame) -> DataFrame:
    return files.select(F.element_at(F.split(F.col("path"), "/"), -1).alias("file_name"), F.try_validate_utf8(F.col("content").cast("string")).alias("value"))


def unread(files: DataFrame) -> DataFrame:
    """file_name, detail of those that could not be read."""
    return files.where("value is null").select("file_name", F.lit("not UTF-8").alias("detail"))


def read_lines(spark: SparkSession, path: str, glob: str = "chunk_*.md") -> DataFrame:
    """Lines of the files under ``path``: file_name, line_no, line, had_newline. A file is one row first, so that its lines keep their order.

    A file without lines, or one that cannot be read, is a row without a number.
    """
    return lines_of(read_files(spark, path, glob))


def lines_of(files: DataFrame) -> DataFrame:
    """The lines of files (file_name, value)."""
    split = files.where("value <> ''").select("file_name", F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("line_no", "line"), F.size(F.split("value", "\r\n|\r|\n", -1)).alias("n"))
    lines = split.where("not (line_no = n - 1 and line = '')").select("file_name", "line_no", "line", (F.col("line_no") < F.col("n") - 1).alias("had_newline"))
    return lines.unionByName(files.where("coalesce(value, '') = ''").select("file_name", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit(False).alias("had_newline")))


def paragraph_map(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, para_id, text: of lines that share an id, the last by file name and number."""
    whole = F.when(F.col("had_newline"), F.concat("line", F.lit("\n"))).otherwise(F.col("line"))
    parsed = lines.withColumn("p", parse_line(whole)).where("p is not null")
    return parsed.groupBy(*keep, F.col("p.para_id").alias("para_id")).agg(F.max_by("p.text", F.struct("file_name", "line_no")).alias("text"))


def chunk_files(chunks: DataFrame, doc: str) -> DataFrame:
    """``doc``, file_name, content of chunks (``doc``, chunk_idx, line_no, para_id, text)."""
    line = F.struct("line_no", chunk_line(F.col("para_id"), F.col("text")).alias("line"))
    return chunks.groupBy(doc, "chunk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("content")).select(
        doc, F.concat(F.lit("chunk_"), F.col("chunk_idx").cast("string"), F.lit(".md")).alias("file_name"), "content")


def write_files(files: DataFrame, root: str, folder: str | None = None, *, replaces: str | None = None) -> tuple[int, int]:
    """Writes each row's ``content`` under its ``file_name``, in a folder by column ``folder`` if named; returns how many files and bytes.

    In two steps, so that a job that fails leaves nothing under the files' names. Tasks first write under names of their own, and give rows of what they wrote, which are written down: of a task that ran
    twice one attempt's. Other tasks then move these to the files' names; to do so again does no harm. ``replaces``: a pattern of names; of the folders that were written to, files of such
    names that are not among the new ones are removed, as those of an earlier run.
    """
    from pyarrow import fs

    scratch, staging = Scratch(files.sparkSession, "write-files"), f".writing-{uuid.uuid4().hex}"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        mine = uuid.uuid4().hex  # a folder for each task: they do not wait for each other
        store.create_dir(f"{base}/{staging}/{mine}", recursive=True)
        for batch in batches:
            names, contents, places = (c.to_pylist() for c in batch.columns)
            own = [f"{mine}/{uuid.uuid4().hex}" for _ in names]
            for name, content in zip(own, contents, strict=True):
                with store.open_output_stream(f"{base}/{staging}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(names, pa.string()), pa.array(own), pa.array(map(len, contents), pa.int64())], names=["folder", "file_name", "own", "size"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        made = ""
        for batch in batches:
            for place, name, own, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source, target = f"{base}/{staging}/{own}", "/".join([base, *([place] if place else []), name])
                if (parent := target.rpartition("/")[0]) != made:
                    store.create_dir(parent, recursive=True)
                    made = parent
                try:
                    store.move(source, target)
                except OSError:
                    if store.get_file_info(source).type == fs.FileType.NotFound:  # an earlier attempt has moved it
                        continue
                    if store.get_file_info(target).type == fs.FileType.NotFound:
                        raise
                    store.delete_file(target)  # a store that moves to no name that is taken
                    store.move(source, target)
            yield batch.select(["size"])

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for place in batch.column(0).to_pylist():
                found = [x.base_name for x in store.get_file_info(fs.FileSelector("/".join([base, *([place] if place else [])]))) if x.is_file and fnmatch(x.base_name, replaces)]
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(found), pa.string()), pa.array(found, pa.string())], names=["folder", "file_name"])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for place, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target = "/".join([base, *([place] if place else []), name])
                if store.get_file_info(target).type != fs.FileType.NotFound:
                    store.delete_file(target)
            yield batch.select(["file_name"])

    rows = files.select("file_name", F.col("content").cast("binary").alias("content"), (F.col(folder) if folder else F.lit("")).cast("string").alias("folder"))
    try:
        new = scratch.save(rows.mapInArrow(written, "folder string, file_name string, own string, size long"), "written")
        counts = new.mapInArrow(moved, "size long").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        if replaces:
            old = scratch.save(new.select("folder").distinct().mapInArrow(there, "folder string, file_name string"), "there").join(new, ["folder", "file_name"], "left_anti")
            old.mapInArrow(removed, "file_name string").count()
    finally:
        store, base = fs.FileSystem.from_uri(root)
        if store.get_file_info(f"{base}/{staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{staging}")
    return counts["files"], counts["bytes"]
