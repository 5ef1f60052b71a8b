"""Findings without duplicates, ranked, capped, suppressed, and rolled up to verdicts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.ranks import SEVERITIES, effective_severity, verdict
from siftwell.functions.text import glob_regex


def dedupe(findings: DataFrame) -> DataFrame:
    """The worst finding of each rule, file and line of a bundle; the first by ord and column on ties."""
    w = Window.partitionBy("bundle_id", "rule_id", "file", F.coalesce("line", F.lit(0))).orderBy(F.desc("sev"), "ord", "column", F.desc("conf"))
    return findings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def order() -> list[Column]:
    """Worst first: severity, confidence, file, line (none as 0), rule."""
    return [F.desc("sev"), F.desc("conf"), F.col("file"), F.coalesce("line", F.lit(0)), F.col("rule_id")]


def worst(findings: DataFrame, n: int, by: str = "bundle_id") -> DataFrame:
    """The first n findings of each bundle in order."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order(), "ord"))).filter(F.col("_n") <= n).drop("_n")


def suppression_conditions(suppressions: list[dict]) -> Column:
    """Whether any suppression holds: rule (an id, a category with /*, or *), path glob and digest, each only if given."""
    out = F.lit(False)
    for s in suppressions:
        rule = s["rule"]
        one = F.lit(True) if rule == "*" else F.col("rule_id").startswith(rule[:-1]) if rule.endswith("/*") else F.col("rule_id") == rule
        if s.get("path"):
            one = one & F.col("file").rlike(glob_regex(s["path"]))
        if s.get("digest"):
            one = one & (F.col("digest") == s["digest"])
        out = out | F.coalesce(one, F.lit(False))
    return out


def suppress(findings: DataFrame, suppressions: list[dict]) -> DataFrame:
    """findings with suppressed; the list is short and comes from the user, so it is one expression and no join."""
    return findings.withColumn("suppressed", suppression_conditions(suppressions))


def bundle_verdicts(bundles: DataFrame, findings: DataFrame, block_at: int = 3, warn_at: int = 2) -> DataFrame:
    """bundle_id, verdict rank, and counts by raw severity of every bundle; without findings: pass and zeros."""
    eff = effective_severity(F.col("sev"), F.col("conf"))
    per = findings.groupBy("bundle_id").agg(F.max(eff).alias("_worst"), *[F.count_if(F.col("sev") == i).alias(f"n_{s}") for i, s in enumerate(SEVERITIES)])
    rows = bundles.select("bundle_id").distinct().join(per, "bundle_id", "left")
    return rows.select("bundle_id", verdict(F.coalesce("_worst", F.lit(0)), block_at, warn_at).alias("verdict"), *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in SEVERITIES])


def target_verdict(bundle_rows: DataFrame) -> DataFrame:
    """One row: the worst verdict (pass for no bundles) and how many bundles have each."""
    return bundle_rows.agg(
        F.coalesce(F.max("verdict"), F.lit(0)).alias("verdict"), F.count_if(F.col("verdict") == 0).alias("n_pass"), F.count_if(F.col("verdict") == 1).alias("n_warn"), F.count_if(F.col("verdict") == 2).alias("n_block")
    )


def verdict_rollup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Worst effective severity by every prefix of keys, the empty one included."""
    eff = effective_severity(F.col("sev"), F.col("conf"))
    return findings.rollup(*keys).agg(F.max(eff).alias("worst"), F.count("*").alias("n"))


def bundle_digest(files: DataFrame) -> DataFrame:
    """bundle_id and sha256 over its files' paths and hashes in path order, read as a stream: a task hashes one bundle's rows one by one and holds none of them. tree_digest() spreads a bundle over tasks."""
    rows = files.select("bundle_id", "path", F.concat(F.col("path"), F.lit("\x00"), F.sha2(F.col("text"), 256), F.lit("\n")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, digest, names = None, None, []
        for b in batches:
            for name, part in zip(b.column("bundle_id"), b.column("part"), strict=True):
                name, part = name.as_py(), part.as_py()
                if digest is None or name != bundle:
                    if digest is not None:
                        names.append((bundle, "sha256:" + digest.hexdigest()))
                    bundle, digest = name, hashlib.sha256()
                digest.update(b"" if part is None else part.encode())
            yield made(names)
            names = []
        if digest is not None:
            yield made([(bundle, "sha256:" + digest.hexdigest())])

    def made(names: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.string()), pa.array([d for _, d in names], pa.string())], ["bundle_id", "digest"])

    return rows.repartition("bundle_id").sortWithinPartitions("bundle_id", "path").mapInArrow(run, "bundle_id string, digest string")


#: Hexadecimal digits of a path's hash that name a leaf, and by which its parents are told, up to the root. Fixed values of the digest.
LEAF_DIGITS, NODE_DIGITS = 6, (4, 2, 0)


def tree_digest(entries: DataFrame, by: str, path: str = "path", content: str = "hash") -> DataFrame:
    """by and digest: a hash tree over each group's entries (path and hash of content; repeated entries count once).

    A leaf takes the entries whose path's SHA-256 begins with the same
    LEAF_DIGITS, in order of path; a node takes its children, in order. The cut
    depends on paths alone, so equal entries give equal digests however they are
    dealt out, and trees of parts can be merged. A leaf holds a 16.8 millionth
    of a group, a node at most 256 children, so no task holds a group.
    """
    name = lambda n: F.substring(F.col("_p"), 1, n) if n else F.lit("")
    rows = entries.select(F.col(by), F.col(path).alias("_path"), F.col(content).alias("_hash")).distinct().withColumn("_p", F.sha2(F.col("_path"), 256))
    part = F.concat("_path", F.lit("\x00"), F.coalesce("_hash", F.lit("")), F.lit("\n"))
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"]), ""), 256)
    level = rows.select(by, name(LEAF_DIGITS).alias("_p"), F.struct("_path", "_hash").alias("_at"), part.alias("_part")).groupBy(by, "_p").agg(joined().alias("_d"))
    for digits in NODE_DIGITS:
        part = F.concat("_p", F.lit(":"), "_d", F.lit("\n"))
        level = level.select(by, name(digits).alias("_up"), F.col("_p").alias("_at"), part.alias("_part")).groupBy(by, F.col("_up").alias("_p")).agg(joined().alias("_d"))
    return level.select(by, F.concat(F.lit("tree:"), "_d").alias("digest"))


def bundle_tree_digest(files: DataFrame) -> DataFrame:
    """bundle_id and digest of each bundle's files (path and text) as a tree."""
    return tree_digest(files.select("bundle_id", "path", F.sha2("text", 256).alias("hash")), "bundle_id")


def target_digest(bundles: DataFrame) -> DataFrame:
    """target and digest of the bundles (target, bundle_id, digest) of each target as a tree."""
    return tree_digest(bundles, "target", "bundle_id", "digest")
