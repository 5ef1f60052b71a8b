"""Path context by reference: development files that something runs or reads keep their full grade.

What instructions, references and scripts name is an inverted index: behind a
word that runs, loads or reads, every path within reach gives the keys by which
it may name a file (its last two parts, or the name alone), and files meet
their mentions by equality of bundle and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words before a path that make it something to run, load or read. Fixed values.
RUNNERS = "node python[0-9.]* bash sh zsh deno bun ruby perl pwsh powershell npx tsx ts-node uv[ ]+run source require import from spawn[a-z]* exec[a-z]* run[a-z]* execute invoke call launch start use load read see follow open"
#: Characters between such a word and a path, at most. Fixed value.
REACH = 40
_PATH = r"[A-Za-z0-9_@+.-]+(?:/[A-Za-z0-9_@+.-]+)*"
_WORD = rf"\b(?i:{'|'.join(RUNNERS.replace('uv[ ]+run', 'uv_run').split()).replace('uv_run', 'uv[ ]+run')})\b"
#: The text behind each such word, up to where a path that starts within reach ends; windows may overlap.
_WINDOW = rf"(?=({_WORD}[^\n]{{0,{REACH}}}[A-Za-z0-9_@+./-]*))."
#: Values of a manifest that a host runs by itself. Fixed values.
AUTOMATIC = r'"(?:command|preinstall|install|postinstall|prepare)"\s*:\s*"((?:[^"\\\n]|\\.)*)"'


def reference_key(path: Column) -> Column:
    """How a reference names a file: the last two parts of its path in the bundle; the name alone where there is one part. What stands behind `!/` lies in an archive."""
    return F.substring_index(F.substring_index(path, "!/", 1), "/", -2)


def named_keys(text: Column) -> Column:
    """The keys of all paths that a text runs, loads or reads: pairs of neighbouring parts, and single parts that have a dot."""
    windows = F.regexp_extract_all(text, F.lit(_WINDOW), F.lit(1))
    paths = F.array_distinct(F.flatten(F.transform(windows, lambda w: F.regexp_extract_all(w, F.lit(_PATH), F.lit(0)))))
    paths = F.filter(F.transform(paths, lambda p: F.regexp_replace(p, r"^(?:\./)+|\.+$", "")), lambda p: p.rlike("[./]"))

    def keys(path: Column) -> Column:
        parts = F.split(path, "/")
        pairs = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i > 1), lambda i: F.concat_ws("/", F.get(parts, i - 2), F.get(parts, i - 1)))
        return F.concat(pairs, F.filter(parts, lambda x: x.contains(".")))

    return F.array_distinct(F.flatten(F.transform(paths, keys)))


def mentions(files: DataFrame) -> DataFrame:
    """bundle_id and key, without repeats, of all that the bundle's instructions, references, scripts and automatic commands name. READMEs, and files that are themselves of some path context, don't count."""
    automatic = F.array_join(F.regexp_extract_all("text", F.lit(AUTOMATIC), F.lit(1)), "\n")
    text = F.when(F.col("kind") == "manifest", F.concat(F.lit("run "), F.replace(automatic, F.lit("\n"), F.lit("\nrun ")))).otherwise(F.col("text"))
    rows = files.filter(F.col("kind").isin("skill-md", "markdown", "script", "manifest") & (F.col("role") != "readme") & F.col("path_context").isNull())
    rows = rows.select("bundle_id", text.alias("text")).filter(F.col("text").rlike(_WORD))
    return rows.select("bundle_id", F.explode(named_keys(F.col("text"))).alias("key")).distinct()


def run_files(files: DataFrame, root: Column | None = None) -> DataFrame:
    """file_id of the development files (path context dev, of a kind that can run) that their bundle mentions. root: the bundle's folder, cut from paths before keys are made."""
    path = F.col("path") if root is None else F.when(F.col("path").startswith(F.concat(root, F.lit("/"))), F.expr("substring(path, length(bundle_root) + 2)")).otherwise(F.col("path"))
    dev = files.filter((F.col("path_context") == "dev") & (F.col("kind") != "text")).select("file_id", "bundle_id", reference_key(path).alias("key"))
    return dev.join(mentions(files), ["bundle_id", "key"], "left_semi").select("file_id")


def with_references(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (of files, or of their matches; no texts, as they are shuffled) with path_context null where their file is run or read by its bundle."""
    run = run_files(files).withColumn("_run", F.lit(True))
    joined = rows.join(run, "file_id", "left")
    return joined.withColumn("path_context", F.when(F.col("_run").isNull(), F.col("path_context"))).select(*rows.columns)
