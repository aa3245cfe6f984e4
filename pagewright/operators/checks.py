"""Checks of edited lines against the original ones, as rows of faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strict_para_id, tag_faults, tag_types
from ..scratch import Scratch

FAULTS = "array<struct<severity:string,rule:string,detail:string>>"


def compare_names(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """One row per distinct name of either side: name, in_left, in_right. Nulls are left out."""
    a = left.select(name).where(F.col(name).isNotNull()).distinct().withColumn("in_left", F.lit(True))
    b = right.select(name).where(F.col(name).isNotNull()).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, name, "full_outer").select(name, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def _fault(rule: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit("error").alias("severity"), F.lit(rule).alias("rule"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def _none() -> Column:
    return F.array().cast(FAULTS)


def _if(test: Column, rule: str, detail: Column | None = None) -> Column:
    return F.when(test, F.array(_fault(rule, detail))).otherwise(_none())


def _of_line(mine: Column, theirs: Column, equal: bool = False) -> Column:
    """Faults of a pair of lines. A missing line or id ends its checks. ``equal``: nothing of the other line can be lost."""
    my_id, their_id = strict_para_id(mine), strict_para_id(theirs)
    tags = F.transform(tag_faults(mine), lambda f: F.struct(F.lit("error").alias("severity"), f["rule"].alias("rule"), F.concat_ws(" ", f["found"], f["expected"]).alias("detail")))
    lost = F.transform(F.array_except(tag_types(theirs), tag_types(mine)), lambda x: _fault("TAG_TYPE_MISSING", x))
    lost = F.when(F.contains(theirs, F.lit("<")), lost).otherwise(_none())
    rest = tags if equal else F.concat(_if(my_id != their_id, "ID_MISMATCH", F.concat_ws(" ", my_id, their_id)), tags, lost)
    faults = (F.when(mine.isNull(), F.array(_fault("CHUNK_LINE_MISSING"))).when(theirs.isNull(), F.array(_fault("ORIGIN_LINE_MISSING")))
              .when(my_id.isNull(), F.array(_fault("CHUNK_NO_ID"))).when(their_id.isNull(), F.array(_fault("ORIGIN_NO_ID"))).otherwise(rest))
    return faults.cast(FAULTS)


def name_faults(names: DataFrame) -> DataFrame:
    """Faults of all file names together (name, in_left: edited, in_right: original): numbers that differ (a warning), nothing in common."""
    totals = names.agg(F.count_if("in_left").alias("a"), F.count_if("in_right").alias("b"), F.count_if(F.col("in_left") & F.col("in_right")).alias("c"))
    numbers = F.when(F.col("a") != F.col("b"), F.array(F.struct(F.lit("warning").alias("severity"), F.lit("FILE_COUNT").alias("rule"), F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail")))).otherwise(_none())
    return totals.select(F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("int").alias("line_no"), F.inline(F.concat(numbers, _if(F.col("c") == 0, "NO_COMMON_FILES"))))


def verify(chunks: DataFrame, origin: DataFrame, *, unread: DataFrame | None = None) -> DataFrame:
    """All faults of two tables of lines (file_name, line_no, line). Lines are compared for files on both sides only.

    Both sides are one table, dealt by file once and gone through once: a line's row has its pair, and by windows over the file whether it is on both sides and how many lines it has on each;
    a file's first row has the file's own faults, too. Only names are counted beside that. ``unread``: files (file_name, detail) that could not be
    read; a file that is there without lines is a row with a null line_no.
    """
    both = _both(chunks, origin)
    names = both.groupBy("file_name").agg(F.max(F.col("side") == 0).alias("in_left"), F.max(F.col("side") == 1).alias("in_right"))
    return _with_unread(_pair_faults(both).unionByName(name_faults(names)), unread)


def _both(chunks: DataFrame, origin: DataFrame) -> DataFrame:
    sides = [d.select("file_name", "line_no", "line", F.lit(i).alias("side")) for i, d in enumerate((chunks, origin))]
    return sides[0].unionByName(sides[1]).where("file_name is not null")


def _with_unread(faults: DataFrame, unread: DataFrame | None) -> DataFrame:
    return faults if unread is None else faults.unionByName(read_faults(unread))


def _pair_faults(both: DataFrame) -> DataFrame:
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(("chunk_line", "origin_line")[side])
    on = [F.max(F.col("side") == i).alias(f"on_{i}") for i in (0, 1)]
    lines = both.repartition("file_name").groupBy("file_name", "line_no").agg(*(of(i, "line") for i in (0, 1)), *on)
    file = Window.partitionBy("file_name")
    counted = F.col("line_no").isNotNull()
    seen = lines.select("*", F.max("on_0").over(file).alias("in_left"), F.max("on_1").over(file).alias("in_right"), F.count_if(counted & F.col("chunk_line").isNotNull()).over(file).alias("a"),
                        F.count_if(counted & F.col("origin_line").isNotNull()).over(file).alias("b"), (F.row_number().over(file.orderBy("line_no")) == 1).alias("first"))
    common = F.col("in_left") & F.col("in_right")
    of_file = F.concat(_if(common & (F.col("a") != F.col("b")), "LINE_COUNT", F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string"))),
                       _if(~F.col("in_right"), "ONLY_IN_CHUNKS"), _if(~F.col("in_left"), "ONLY_IN_ORIGIN"))
    placed = lambda at, faults: F.transform(faults, lambda f: F.struct(at.cast("int").alias("line_no"), *(f[x].alias(x) for x in ("severity", "rule", "detail"))))
    own = placed(F.col("line_no"), F.when(common & counted, _of_line(F.col("chunk_line"), F.col("origin_line"))).otherwise(_none()))
    return seen.select("file_name", F.inline(F.concat(own, placed(F.lit(None), F.when(F.col("first"), of_file).otherwise(_none())))))


#: Bytes of file names that are sent to where the lines are; beyond it, names and lines meet in an exchange.
BROADCAST = 32 << 20


def file_digests(lines: DataFrame) -> DataFrame:
    """file_name, digest of each file (file_name, line_no, line): its number of lines and sums of two 64-bit hashes of each numbered line.

    Sums, so that each task adds up its own rows and a row for each file and task is exchanged, not lines; in halves, so that they can't overflow. Written down, it stands for a side that stays as it is.
    """
    line = (F.coalesce(F.col("line_no").cast("long"), F.lit(-1)), F.col("line").isNull(), F.coalesce("line", F.lit("")))
    hashed = lines.where("file_name is not null").select("file_name", *(F.xxhash64(F.lit(i), *line).alias(f"h{i}") for i in (1, 2)))
    half = [F.sum(x(F.col(h))).alias(f"{h}_{name}") for h in ("h1", "h2") for name, x in (("high", lambda c: F.shiftrightunsigned(c, 32)), ("low", lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))))]
    sums = hashed.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), *half)
    return sums.select("file_name", F.struct(*(c for c in sums.columns if c != "file_name")).alias("digest"))


def compare_digests(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """file_name, in_left, in_right, same of each file of either side (file_name, digest)."""
    a, b = mine.select("file_name", F.col("digest").alias("_a")), theirs.select("file_name", F.col("digest").alias("_b"))
    has = lambda c: F.col(c).isNotNull()
    return a.join(b, "file_name", "full_outer").select("file_name", has("_a").alias("in_left"), has("_b").alias("in_right"), F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def verify_changed(chunks: DataFrame, origin: DataFrame, *, stored: DataFrame | None = None, whole: bool = True, unread: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The faults that ``verify`` gives, for sides that are mostly equal: only lines of files that differ are exchanged and paired.

    Files are told apart by ``file_digests``; ``stored`` are those of ``origin``, which is then read for files that differ only. Lines of equal files are checked where they are, without a pair (a row that
    is there twice has its faults twice). Files of one side only are known by their digests. ``whole``: without it, ``chunks`` are some of the
    files, and what is not among them is no fault, nor are numbers of files compared. ``scratch``: where table ``files`` goes, for the caller to drop.
    """
    scratch = scratch or Scratch(chunks.sparkSession, "verify-changed")
    theirs = file_digests(origin) if stored is None else stored
    compared = compare_digests(file_digests(chunks), theirs)
    files = scratch.save(compared if whole else compared.where("in_left"), "files")
    differ = files.where("in_left and in_right and not same").select("file_name")
    equal = files.where("same").select("file_name")
    only = F.concat(_if(~F.col("in_right"), "ONLY_IN_CHUNKS"), _if(~F.col("in_left"), "ONLY_IN_ORIGIN"))
    faults = files.where("in_left <> in_right").select("file_name", F.lit(None).cast("int").alias("line_no"), F.inline(only))
    faults = faults.unionByName(_pair_faults(_both(_of(chunks, differ), _of(origin, differ))))
    alone = _of(chunks.where("line_no is not null"), equal)
    faults = faults.unionByName(alone.select("file_name", F.col("line_no").cast("int").alias("line_no"), F.inline(_of_line(F.col("line"), F.col("line"), equal=True))))
    return _with_unread(faults.unionByName(name_faults(files)) if whole else faults, unread)


def _of(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines of the named files, which are rows of a written table: their bytes are summed up before they are sent to all tasks."""
    size = names.agg(F.sum(F.octet_length("file_name") + 32)).first()[0] or 0
    return lines.join(F.broadcast(names) if size <= BROADCAST else names, "file_name", "left_semi")


def read_faults(unread: DataFrame) -> DataFrame:
    """A fault for each file (file_name, detail) that could not be read."""
    return unread.select("file_name", F.lit(None).cast("int").alias("line_no"), F.lit("error").alias("severity"), F.lit("READ_FAILED").alias("rule"), "detail")


def missing_folders(folders: DataFrame) -> DataFrame:
    """A fault for each folder (folder, there) that is not there."""
    return folders.where("not there").select(F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("int").alias("line_no"), F.lit("error").alias("severity"), F.lit("DIR_MISSING").alias("rule"), F.col("folder").alias("detail"))


def report(faults: DataFrame) -> DataFrame:
    """One row: n_errors, n_warnings, passed."""
    return faults.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings")).withColumn("passed", F.col("n_errors") == 0)


#: Attempts at a file, after which its faults are for a human to see to.
ATTEMPTS = 3


def attempts(faults: DataFrame, earlier: DataFrame) -> DataFrame:
    """file_name, attempt, for_a_human of each file with an error; ``earlier``: file_name, attempt of those tried before."""
    wrong = faults.where("severity = 'error' and file_name is not null").select("file_name").distinct()
    before = earlier.groupBy("file_name").agg(F.max("attempt").alias("before"))
    attempt = F.coalesce("before", F.lit(0)) + 1
    return wrong.join(before, "file_name", "left").select("file_name", attempt.alias("attempt"), (attempt >= ATTEMPTS).alias("for_a_human"))
