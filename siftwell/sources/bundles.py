"""Folders of files as DataFrames: reading, budgets, and grouping into bundles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import ancestors
from siftwell.operators import classify
from siftwell.session import stored

#: Folders that are not read. Fixed values.
SKIPPED = [".git", "node_modules", ".venv", "venv", "__MACOSX"]
FILE_BYTES = 4 << 20
TOTAL_BYTES = 128 << 20


def read_tree(spark: SparkSession, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """target, path (below root), size, content (the first file_bytes), truncated, binary_format, binary, text, kind, role, path_context.

    Text is UTF-8, or UTF-16 after a byte order mark; a binary file has null text. Files below SKIPPED folders are left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the reader gives full URIs: what follows the root's own path is kept
    base = F.lit(re.sub(r"^[a-z][a-z0-9]*:/*(?=/)", "", root.rstrip("/")) + "/")
    rows = found.select(F.lit(root).alias("target"), F.col("path").alias("_uri"), base.alias("_base"), F.col("length").alias("size"), "content")
    rows = rows.withColumn("path", F.expr("substring(_uri, locate(_base, _uri) + length(_base))"))
    rows = rows.filter(~F.concat(F.lit("/"), "path").rlike("/(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    rows = rows.withColumns({"truncated": F.col("size") > file_bytes, "content": F.substring("content", 1, file_bytes)})
    rows = rows.withColumns({"binary_format": classify.binary_format(F.col("content"), F.col("path")), "binary": classify.looks_binary(F.col("content"))})
    return with_kinds(rows.withColumn("text", decoded(F.col("content")))).drop("_uri", "_base")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 after its byte order mark, else UTF-8 without one; bytes that aren't valid become U+FFFD, so a bad byte hides no text."""
    head = F.hex(F.substring(content, 1, 3))
    wide = F.when(head.startswith("FFFE"), F.decode(content, "UTF-16")).when(head.startswith("FEFF"), F.decode(content, "UTF-16"))
    plain = F.make_valid_utf8(F.when(head == "EFBBBF", F.substring(content, 4, 2**31 - 1)).otherwise(content).cast("string"))
    return F.when(wide.isNotNull(), wide).otherwise(plain)


def with_kinds(rows: DataFrame) -> DataFrame:
    """kind, role and path_context from path, text and binary; text of binaries becomes null."""
    wide = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    is_binary = (F.col("binary") & ~wide) | F.col("binary_format").isNotNull() | F.col("text").isNull()
    head = F.substring_index(F.substring(F.coalesce("text", F.lit("")), 1, 200), "\n", 1)
    kinds = rows.withColumn("kind", classify.kind(F.col("path"), head, is_binary))
    return kinds.withColumns({"text": F.when(F.col("kind") != "binary", F.col("text")), "role": classify.role(F.col("path"), F.col("kind")), "path_context": classify.path_context(F.col("path"), F.col("kind"))})


def read_budget(files: DataFrame, budget: int, by: str, size: Column, order: list[Column]) -> DataFrame:
    """files with read: bytes of each that a budget for its group still covers, in order. The last one is cut, later ones have 0.

    Files are stored once in ranges of group and order, so leave their contents
    out. Sizes are summed within a range and over the ranges of a group, so a
    task holds one range, however many files a group has.
    """
    # stored, as ranges are drawn anew whenever they are computed
    ranged = stored(files.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()), "budget")
    sums = ranged.groupBy(by, "_part").agg(F.sum(size).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_range"), F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    within = F.coalesce(F.sum(size).over(Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.withColumn("_within", within).join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_range")))
    left = F.lit(budget) - F.col("_earlier") - F.col("_within")
    return rows.withColumn("read", F.greatest(F.lit(0), F.least(size, left)).cast("long")).drop("_part", "_within", "_by", "_range", "_earlier")


def group_bundles(files: DataFrame) -> DataFrame:
    """files with bundle_root and bundle_id: the nearest folder above that holds a skill file owns a file, the root the others.

    A file's ancestors are exploded and meet the skill folders by equality.
    """
    skills = files.filter(classify.is_skill_file(F.col("path"))).select("target", F.element_at(ancestors(F.col("path")), -1).alias("dir")).distinct()
    up = files.select("target", "path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    owner = up.join(skills, ["target", "dir"]).groupBy("target", "path").agg(F.max_by("dir", "depth").alias("_dir"))
    owned = files.join(owner, ["target", "path"], "left").withColumn("bundle_root", F.coalesce("_dir", F.lit("."))).drop("_dir")
    return owned.withColumns({"bundle_id": F.concat_ws("!", "target", "bundle_root"), "file_id": F.xxhash64("target", "path")})


def packaging_findings(files: DataFrame) -> DataFrame:
    """Findings about files as such, of grouped files: executables, archives, a content that belies the extension, hidden files, truncation, several skill files."""
    name = classify.basename(F.col("path"))
    hidden = F.col("path").rlike(r"(?:^|/)\.(?!github/|gitignore$|gitattributes$|editorconfig$|claude-plugin/|mcp\.json$)[^/.][^/]*")
    harmless = classify.extension(F.col("path")).isin("png", "jpg", "jpeg", "gif", "txt", "md", "csv", "json", "pdf")
    risky = F.col("binary_format").isin(*classify.EXECUTABLE)
    made = [
        (risky, "packaging/executable-binary", "A compiled program lies in it", 3, 2, True), (F.col("binary_format").isin(*classify.ARCHIVES), "packaging/archive", "An archive lies in it", 2, 2, False),
        (risky & harmless, "packaging/extension-mismatch", "Content belies the extension", 4, 2, True), (hidden, "packaging/unexpected-dotfile", "A hidden file or folder", 1, 1, False),
        (F.col("truncated"), "packaging/incomplete-scan", "Not all of it could be read", 2, 2, False), (name.rlike(r"[\u202A-\u202E\u2066-\u2069]|\.\w{2,4}\s{3,}\.\w+$"), "packaging/deceptive-filename", "A name that misleads", 3, 2, False),
        (name.rlike(r"(?i)^\.(?:gitleaksignore|semgrepignore|snyk|trivyignore|osv-scanner\.toml)$"), "packaging/scanner-suppression-file", "Settings that mute a scanner", 2, 2, False),
    ]
    each = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(t).alias("title"), F.lit(s).alias("sev"), F.lit(k).alias("conf"), F.lit(h).alias("hard"))) for c, i, t, s, k, h in made]), lambda x: x.isNotNull())
    rows = files.select("bundle_id", F.col("path").alias("file"), F.explode(each).alias("r")).select("bundle_id", "r.rule_id", "r.title", F.lit("packaging").alias("category"), "r.sev", "r.conf", "r.hard", "file")
    second = files.filter(classify.is_skill_file(F.col("path"))).withColumn("_d", F.element_at(ancestors(F.col("path")), -1)).withColumn("_n", F.row_number().over(Window.partitionBy("bundle_id", "_d").orderBy("path"))).filter("_n = 2")
    double = second.select("bundle_id", F.lit("packaging/duplicate-skill-file").alias("rule_id"), F.lit("Several skill files in one folder").alias("title"), F.lit("packaging").alias("category"), F.lit(2).alias("sev"), F.lit(2).alias("conf"), F.lit(False).alias("hard"), F.col("path").alias("file"))
    return rows.unionByName(double).select("*", F.lit(None).cast("int").alias("line"), F.lit(1).alias("column"), F.lit(None).cast("string").alias("snippet"), F.lit(20_000).alias("ord"), F.lit("static").alias("source"))


def metadata_findings(files: DataFrame) -> DataFrame:
    """Findings about the front matter of grouped skill files: missing, an invalid name, a missing or overlong description, a stuffed one."""
    skill = files.filter(F.col("kind") == "skill-md")
    front = F.regexp_extract("text", r"(?s)\A\uFEFF?---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    value = lambda key: F.regexp_replace(F.btrim(F.regexp_extract(F.col("_front"), rf"(?m)^{key}:[ \t]*(.*)$", 1)), "^([\"'])(.*)\\1$", "$2")
    rows = skill.withColumn("_front", front).withColumns({"_name": value("name"), "_desc": value("description")})
    has = F.col("_front") != ""
    made = [
        (~has, "metadata/missing-frontmatter", "Front matter is absent", 1, 2), (has & (~F.col("_name").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") | (F.length("_name") > 64)), "metadata/invalid-name", "Name breaks the naming rules", 1, 2),
        (has & ((F.col("_desc") == "") | (F.length("_desc") > 1024)), "metadata/invalid-description", "Description absent or overlong", 1, 2), (has & (F.regexp_count(F.col("_desc"), F.lit(",")) >= 25), "metadata/trigger-stuffing", "Description names too many occasions", 2, 1),
    ]
    each = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("rule_id"), F.lit(t).alias("title"), F.lit(s).alias("sev"), F.lit(k).alias("conf"))) for c, i, t, s, k in made]), lambda x: x.isNotNull())
    return rows.select("bundle_id", F.col("path").alias("file"), F.explode(each).alias("r")).select(
        "bundle_id", "r.rule_id", "r.title", F.lit("metadata").alias("category"), "r.sev", "r.conf", F.lit(False).alias("hard"), "file", F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(None).cast("string").alias("snippet"), F.lit(30_000).alias("ord"), F.lit("static").alias("source")
    )
