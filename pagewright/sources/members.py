"""Members of packages as a data source: the directory at a file's end is read, then the members asked for and no other bytes."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SHAPE = "path string, size long, part_ord int, arcname string, data binary, bytes_read long"
#: Bytes of files that a task is given, unless option ``partitionBytes`` says otherwise: whole files, of which it reads only parts.
PARTITION = 128 << 20
#: Bytes that a file counts for beside its own: to open it and to read its directory takes time, too.
OPEN = 256 << 10
#: Bytes of members that leave a task together.
BATCH = 8 << 20
#: Bytes that a read of the directory or of a member's head takes at least.
BLOCK = 4096


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(None)
        self.files = files


class _Member(NamedTuple):
    path: str
    size: int
    part_ord: int
    arcname: str
    data: bytes
    bytes_read: int


class _Ranges:
    """A file as ``zipfile`` wants it, read in blocks where it is asked for; counts what was read."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size, self.at, self.held, self.begin, self.bytes_read = file, size, 0, b"", 0, 0

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def fetch(self, at: int, n: int) -> None:
        """Reads so many bytes at once, for reads of parts of them to come."""
        n = max(0, min(n, self.size - at))
        self.held, self.begin = self.file.read_at(n, at), at
        self.bytes_read += n

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(self.size - self.at, self.size if n is None or n < 0 else n))
        if not self.begin <= self.at <= self.at + n <= self.begin + len(self.held):
            self.fetch(self.at, max(n, BLOCK))
        out = self.held[self.at - self.begin:self.at - self.begin + n]
        self.at += n
        return out


class Members(DataSource):
    """``spark.read.format("package_members").load(folder)``: path, size (of the file), part_ord, arcname, data, bytes_read of each member of each package.

    Options: ``glob`` of file names (``*.docx``), ``partitionBytes``. A filter on ``arcname`` (equal to, or in a list) is pushed down: members of other names are not read.
    ``bytes_read`` is what has been read of the file when the member leaves. Files that are no packages stop the query with their names; with option ``skipBroken`` they have no rows.
    Folders are gone through at any depth by the driver, which keeps a name and a size for each file; tasks are planned by size.
    """

    @classmethod
    def name(cls) -> str:
        return "package_members"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.glob = options.get("glob", "*.docx")
        self.most = int(options.get("partitionBytes", PARTITION))
        self.skips = str(options.get("skipBroken", "false")).lower() == "true"
        self.names: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if isinstance(x, EqualTo | In) and x.attribute == ("arcname",):
                names = frozenset([x.value] if isinstance(x, EqualTo) else x.value)
                self.names = names if self.names is None else self.names & names
            else:
                yield x

    def partitions(self) -> Sequence[InputPartition]:
        store, base = _store(self.root)
        found = store.get_file_info(base)
        if found.type.name == "NotFound":
            raise FileNotFoundError(f"{self.root} is not there")
        files = [found] if found.is_file else store.get_file_info(_everything(base))
        groups: list[list[tuple[str, int]]] = []
        held = self.most
        for x in sorted((x for x in files if x.is_file and (found.is_file or fnmatchcase(x.base_name, self.glob))), key=lambda x: x.path):
            if held + x.size + OPEN > self.most:
                groups.append([])
                held = 0
            groups[-1].append((x.path, x.size))
            held += x.size + OPEN
        return [_Files(x) for x in groups or [[]]]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        rows: list[_Member] = []
        held = 0
        for path, size in partition.files:
            for row in self._members(store, path, size):
                rows.append(row)
                held += len(row.data)
                if held >= BATCH:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _members(self, store, path: str, size: int) -> Iterator[_Member]:
        with store.open_input_file(path) as file:
            ranges = _Ranges(file, size)
            try:
                with zipfile.ZipFile(ranges) as package:
                    for i, x in enumerate(y for y in package.infolist() if not y.is_dir()):
                        if self.names is None or x.filename in self.names:
                            ranges.fetch(x.header_offset, x.compress_size + BLOCK)
                            yield _Member(path, size, i, x.filename, package.read(x), ranges.bytes_read)
            except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError) as e:
                if not self.skips:
                    raise ValueError(f"{path} is no package: {e}") from e


def _batch(rows: list[_Member]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=list(_Member._fields))


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _everything(base: str):
    from pyarrow import fs

    return fs.FileSelector(base, recursive=True)


def read_members(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The members of the packages under ``root``, a URI or an absolute path, of any store that Arrow knows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else names are compared only after all members were read
    spark.dataSource.register(Members)
    return spark.read.format("package_members").options(**options).load(root)
