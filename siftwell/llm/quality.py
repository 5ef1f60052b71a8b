"""Quality rules over whole texts, with built-in functions only, and a short-circuit cascade of them.

The verdict is a cascade: each rule's cost, with the counts that it needs, and
share of rejected rows are measured on a bounded sample, rules run in
descending order of rejection per cost, and a row that one rule rejects is not
given to the next, nor are the next one's counts computed for it. The order
changes the time only: the verdict is that of all rules together. Where all
counts are reported they are computed for every row, in projections that build
each array once.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, random_rows, unused

WINDOW = 8
SAMPLE_ROWS = 1000
_SPACE = r"\x20\x09-\x0D"
_EDGE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A rule rejects rows where `fails` holds (null: it does not). `fails` may use the text and the counts that it needs."""

    name: str
    fails: Column
    needs: tuple[str, ...] = ()


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _whole(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def with_counts(rows: DataFrame, names: Sequence[str], text: str, w: str) -> DataFrame:
    """rows with the named counts and w, the array of the text's words; what rows has already is not made again. See counts()."""
    whole = _whole(text)
    todo = [n for n in names if n not in rows.columns]
    if {"n_words", "word_chars", "n_repeat_words"} & set(todo) and w not in rows.columns:
        bare = F.btrim(whole, F.lit(_EDGE))
        rows = rows.withColumn(w, F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"[{_SPACE}]+")))
    lines, temporary = unused("_lines", rows.columns), []
    if "n_dup_lines" in todo:
        rows, temporary = rows.withColumn(lines, F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{_SPACE}]"))), [lines]
    made = {
        "n_words": lambda: F.size(w).cast("long"),
        "word_chars": lambda: F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": lambda: F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": lambda: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }
    rows = rows.withColumns({n: made[n]() for n in todo if n in made}).drop(*temporary)
    return _with_repeats(rows, w) if "n_repeat_words" in todo else rows


def _with_repeats(rows: DataFrame, w: str) -> DataFrame:
    """rows with n_repeat_words. Only texts with a repeated window sort their windows."""
    keys, ordered, at = (unused(n, rows.columns) for n in ("_keys", "_sorted", "_at"))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    first = rows.withColumn(keys, F.when(F.size(w) > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    placed = F.transform(keys, lambda x, i: F.struct(x.alias("k"), i.alias("i")))
    second = first.withColumn(ordered, F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.sort_array(placed))).drop(keys)
    twice = F.filter(
        F.transform(ordered, lambda x, j: F.when((F.get(ordered, j - 1)["k"] == x["k"]) | (F.get(ordered, j + 1)["k"] == x["k"]), x["i"])), lambda i: i.isNotNull()
    )
    third = second.withColumn(at, F.sort_array(twice)).drop(ordered)
    covered = F.aggregate(F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.get(at, j + 1) - i)), F.lit(0), lambda a, x: a + x)
    return third.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(at)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text (null: no words, all 0).

    n_repeat_words counts the words inside windows of 8 words that stand twice
    or more in the text, the first one included. Windows are told apart by a
    64-bit hash of their words. Columns of docs with these names are replaced.
    """
    rows = docs.select(*[c for c in docs.columns if c not in COUNTS])
    w = unused("_words", rows.columns)
    return with_counts(rows, COUNTS, text, w).drop(w)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def standard_rules(text: str = "text") -> list[Rule]:
    """Rules for prose; the first two make up base_failed(). Capitals are ASCII ones."""
    capitals = F.length(F.regexp_replace(_whole(text), "[^A-Z]+", ""))
    return [
        Rule("few_words", F.col("n_words") < 20, ("n_words",)),
        Rule("repeated_words", F.col("n_repeat_words") * 100 > F.col("n_words") * 30, ("n_words", "n_repeat_words")),
        Rule("symbols", F.col("n_symbols") * 10 > F.col("n_words"), ("n_words", "n_symbols")),
        Rule("capitals", capitals * 10 > F.col("word_chars") * 3, ("word_chars",)),
        Rule("word_length", (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 20), ("n_words", "word_chars")),
    ]


#: The sample is repeated so often for a measurement, which is the least of so many runs; costs within a factor of two, or below this share of the costliest, are alike.
REPEATS, RUNS, LEAST_SHARE = 4, 3, 1 / 16


def by_rejection_per_cost(rows: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in descending order of share rejected per cost, measured on a random sample of sample_rows different texts.

    Rules are over `text` and counts. A rule's cost is the time of a job that computes its counts and tests it
    over the stored texts of the sample, repeated, less that of a job that only
    reads them. It is rounded to a power of two, so that noise doesn't order
    rules. Rules that tie, and all of them on an empty table, keep their order.
    """
    texts = rows.select(F.col(text).alias("text"))
    n = texts.count()
    if not n:
        return list(rules)
    shelf = Scratch(rows.sparkSession)
    sample = shelf.stored(random_rows(texts.distinct(), n, sample_rows, [F.xxhash64("text"), F.col("text")]).coalesce(1), "quality-sample")
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(job: DataFrame) -> float:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            job.collect()  # one row of counts
            runs.append(time.perf_counter() - began)
        return min(runs)

    empty = seconds(again.agg(F.sum(F.length("text"))))
    costs, shares = [], []
    for rule in rules:
        counted = with_counts(again, rule.needs, "text", "_words")
        costs.append(seconds(counted.agg(F.count_if(rule.fails))) - empty)
        seen = with_counts(sample, rule.needs, "text", "_words").agg(F.count("*").alias("n"), F.count_if(rule.fails).alias("failed")).first()
        shares.append(seen["failed"] / max(seen["n"], 1))
    shelf.drop()
    least = max(max(costs) * LEAST_SHARE, 1e-3)
    gains = [share / 2.0 ** round(math.log2(max(cost, least) / least)) for share, cost in zip(shares, costs, strict=True)]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gains[i])]


def passes(rules: Sequence[Rule]) -> Column:
    """Whether no rule rejects the row, tested in the order given; the first that rejects ends it. The rules' counts must stand in the row."""
    verdict = F.when(F.coalesce(rules[0].fails, F.lit(False)), False)
    for rule in rules[1:]:
        verdict = verdict.when(F.coalesce(rule.fails, F.lit(False)), False)
    return verdict.otherwise(True)


def cascade(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs, whatever their names. Each rule's counts are computed only for rows that the rules before it let pass. Rules are over `text` and counts."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).cast("string").alias("text"))
    for k, rule in enumerate(rules):
        rows = with_counts(rows, rule.needs, "text", "_words")
        # the row's number keeps the optimizer from merging this filter with the next rule's, and from copying counts into it
        rows = rows.withColumn(f"_n{k}", F.monotonically_increasing_id())
        rows = rows.filter(~F.coalesce(rule.fails, F.lit(False)) & (F.col(f"_n{k}") >= 0)).drop(f"_n{k}")
    return rows.select("_row.*")


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts, base_failed and kept. Rows stay as they are, repeated ones too; an empty table stays empty."""
    named = {r.name: r for r in standard_rules(text)}
    rules = [named[r.name] for r in by_rejection_per_cost(docs, standard_rules(), text)]
    found = counts(docs.drop("base_failed", "kept"), text)
    return found.withColumn("base_failed", base_failed()).withColumn("kept", passes(rules))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    rows = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n >= 2),
c AS (
  SELECT r, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM d) GROUP BY r),
b AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR length(regexp_replace(text, '[^A-Z]', '', 'g')) * 10 > word_chars * 3
            OR word_chars < n_words * 2 OR word_chars > n_words * 20) AS kept
FROM f"""
