"""Lines of texts, runs of blank lines, and context of a line from its neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_index(files: DataFrame, key: str = "file_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, kept columns, line (from 1) and line_text of every line; null text has none. No shuffle."""
    rows = files.filter(F.col(text).isNotNull()).select(key, *keep, F.split(F.col(text), "\n", -1).alias("_l"))
    exploded = rows.select(key, *keep, F.posexplode("_l").alias("pos", "line_text"))
    return exploded.select(key, *keep, (F.col("pos") + 1).cast("int").alias("line"), "line_text")


def line_starts(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """lines with start: code points before the line in its file."""
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.length("line_text") + 1).over(before), F.lit(0)).cast("long"))


def blank_runs(lines: DataFrame, least: int, key: str = "file_id") -> DataFrame:
    """key, first_line and n of each run of at least `least` blank lines: gaps and islands."""
    blank = F.col("line_text").rlike(r"^\s*$")
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = lines.withColumn("_island", F.sum(F.when(blank, 0).otherwise(1)).over(w)).filter(blank)
    return islands.groupBy(key, "_island").agg(F.min("line").alias("first_line"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_island")


def long_lines(lines: DataFrame, key: str = "file_id", longest_at: int = 3000, mean_over: int = 500, total_over: int = 5000) -> DataFrame:
    """key, n_lines, n_chars, longest, longest_line (the first of the longest) and minified, of each file."""
    size = F.length("line_text")
    per = lines.groupBy(key).agg(
        F.count("*").alias("n_lines"), F.sum(size).alias("n_chars"), F.max(F.struct(size.alias("n"), (-F.col("line")).alias("at"))).alias("m")
    )
    longest, mean = F.col("m.n"), F.col("n_chars") / F.col("n_lines")
    return per.select(key, "n_lines", "n_chars", longest.alias("longest"), (-F.col("m.at")).alias("longest_line"), ((longest >= longest_at) | ((mean > mean_over) & (F.col("n_chars") > total_over))).alias("minified"))


#: Words by which a sentence warns of what it names. Fixed values.
CAUTION = r"(?i)\b(?:never|do not|don't|avoid|warning|caution|dangerous|unsafe|must not|should not|refuse|reject|block|forbidden|prohibited|malicious|attack(?:er)?s?)\b"


def is_cautionary(text: Column) -> Column:
    return text.rlike(CAUTION)
