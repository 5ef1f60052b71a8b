"""Files of a folder chosen before they are read: a listing without contents, then the contents of the chosen ones.

Both passes are Spark's own file source. The listing never opens a file, as its
scan has no content column; the second pass starts from the selected skills'
folders alone and has the size limit pushed into the reader, so a file beyond it
is noted and never loaded.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import ancestors
from siftwell.operators import classify
from siftwell.sources.bundles import FILE_BYTES, SKIPPED, TOTAL_BYTES, decoded, read_budget, with_kinds
from siftwell.session import stored

#: Folders deep and files of a target at most. Fixed values.
MOST_DEPTH, MOST_FILES = 24, 20_000
#: Folders of a selection that are opened by name; beyond it the whole target is read and then narrowed.
MOST_ROOTS = 1000


def _base(root: str) -> str:
    """What stands before a path below the root in the full URIs that the reader gives, without scheme and host."""
    return re.sub(r"^[a-z][a-z0-9+.-]*:/*(?=/)", "", root.rstrip("/")) + "/"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """target, path (below root), size and modified of every file; no content is read. Names that begin with a dot or an underscore are not listed by the reader."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = found.select(F.lit(root).alias("target"), F.col("path").alias("_uri"), F.lit(_base(root)).alias("_base"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return rows.select("target", F.expr("substring(_uri, locate(_base, _uri) + length(_base))").alias("path"), "size", "modified")


def skill_roots(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """target and dir of the skills that a selection may mean: folders with a skill file whose own name is one of `names` (case doesn't count); `*` means all of them."""
    skills = files.filter(classify.is_skill_file(F.col("path"))).select("target", F.element_at(ancestors(F.col("path")), -1).alias("dir")).distinct()
    if "*" in names:
        return skills
    return skills.filter(F.lower(F.substring_index("dir", "/", -1)).isin([n.lower() for n in names]))


def union_of(first: Sequence[str] | None, second: Sequence[str] | None) -> list[str] | None:
    """What two selections select together: none given means all, and `*` takes in the rest."""
    if first is None or second is None:
        return None
    both = list(dict.fromkeys([*first, *second]))
    return ["*"] if "*" in both else both


def chosen(files: DataFrame, skills: Sequence[str] | None = None, file_bytes: int = FILE_BYTES, total_bytes: int = TOTAL_BYTES, most_files: int = MOST_FILES, most_depth: int = MOST_DEPTH) -> DataFrame:
    """files of a listing with read (bytes to read, 0 for none) and note (why not all of it is).

    In this order: skipped folders and those outside the selection leave; files
    too deep, too many in order of path, or too large are noted; skill files
    come first and then the smallest, until the target's budget is used up.
    """
    kept = files.filter(~F.concat(F.lit("/"), "path").rlike("/(?:" + "|".join(re.escape(s) for s in SKIPPED) + ")/"))
    if skills is not None and "*" not in skills:
        roots = skill_roots(kept, skills)
        up = kept.select("target", "path", F.explode(ancestors(F.col("path"))).alias("dir")).join(roots, ["target", "dir"], "left_semi").select("target", "path").distinct()
        kept = kept.join(up, ["target", "path"], "left_semi")
    deep = F.size(F.split("path", "/")) - 1 > most_depth
    counted = read_budget(kept.withColumn("_deep", deep), most_files, "target", F.when(F.col("_deep"), 0).otherwise(1), [F.col("path")]).withColumnRenamed("read", "_counts")
    note = F.when(F.col("_deep"), "too deep").when(F.col("_counts") == 0, "too many files").when(F.col("size") > file_bytes, "too large")
    noted = counted.withColumn("note", note).drop("_deep", "_counts")
    first = F.when(classify.is_skill_file(F.col("path")), 0).otherwise(1)
    budgeted = read_budget(noted, total_bytes, "target", F.when(F.col("note").isNull(), F.col("size")).otherwise(0), [first, F.col("size"), F.col("path")])
    over = F.col("note").isNull() & (F.col("read") < F.col("size"))
    return budgeted.withColumns({"note": F.when(over, "over the budget").otherwise(F.col("note")), "read": F.when(over, 0).otherwise(F.col("read"))})


def notes(files: DataFrame) -> DataFrame:
    """target, note and n of what a scan leaves unread."""
    return files.filter(F.col("note").isNotNull()).groupBy("target", "note").agg(F.count("*").alias("n"))


def contents(spark: SparkSession, root: str, files: DataFrame, skills: Sequence[str] | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """files (see chosen) with content, truncated, binary_format, binary, text, kind, role and path_context; content and text are null where nothing is read."""
    folders = [root]
    if skills is not None and "*" not in skills:
        # named by the user: as few as the selection
        dirs = [r["dir"] for r in skill_roots(files, skills).select("dir").limit(MOST_ROOTS + 1).collect()]
        if len(dirs) <= MOST_ROOTS:
            folders = [root if d == "." else f"{root.rstrip('/')}/{d}" for d in dirs]
    if folders:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).filter(F.col("length") <= file_bytes)
        read = found.select(F.col("path").alias("_uri"), F.lit(_base(root)).alias("_base"), "content").select(F.expr("substring(_uri, locate(_base, _uri) + length(_base))").alias("path"), "content").dropDuplicates(["path"])
    else:
        read = spark.createDataFrame([], "path string, content binary")
    rows = files.join(read, "path", "left").withColumn("content", F.when(F.col("read") > 0, F.col("content")).when(F.col("note").isNull(), F.lit(b"").cast("binary")))
    rows = rows.withColumns({"truncated": F.col("note").isNotNull(), "binary_format": classify.binary_format(F.col("content"), F.col("path")), "binary": F.coalesce(classify.looks_binary(F.col("content")), F.lit(False))})
    return with_kinds(rows.withColumn("text", decoded(F.col("content"))))


def read_selected(spark: SparkSession, root: str, skills: Sequence[str] | None = None, file_bytes: int = FILE_BYTES, total_bytes: int = TOTAL_BYTES, most_files: int = MOST_FILES, most_depth: int = MOST_DEPTH) -> DataFrame:
    """The files of a folder, or of the skills selected in it, within all limits (see chosen and contents)."""
    picked = stored(chosen(listing(spark, root), skills, file_bytes, total_bytes, most_files, most_depth), "chosen")
    return contents(spark, root, picked, skills, file_bytes)
