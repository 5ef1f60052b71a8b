"""A whole scan: files grouped into bundles, every sort of finding, verdicts, and the report of a target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import ancestors
from siftwell.operators import rollup
from siftwell.operators.catalog import RULES, Rule
from siftwell.operators.scan import FILE, scan_bundles
from siftwell.session import stored
from siftwell.sources.bundles import group_bundles, metadata_findings, packaging_findings
from siftwell.sources.selection import read_selected


@dataclass(frozen=True)
class Scan:
    """files (grouped, with bundle_id), findings and verdicts (a row a bundle) of a target."""

    files: DataFrame
    findings: DataFrame
    verdicts: DataFrame

    def verdict(self) -> DataFrame:
        """One row: the worst verdict, and how many bundles have each."""
        return rollup.target_verdict(self.verdicts)


def own_bundle(external: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of other tools (target, file and their own columns; no bundle_id) with the bundle that owns their file: that of the file itself, else of the nearest folder above it that is a bundle's, else of the target's root.

    A finding's folders are exploded and meet the bundles' roots by equality.
    """
    roots = files.select("target", F.col("bundle_root").alias("dir"), "bundle_id").distinct()
    up = external.select("target", "file").distinct().select("target", "file", F.posexplode(ancestors(F.col("file"))).alias("depth", "dir"))
    owner = up.join(roots, ["target", "dir"]).groupBy("target", "file").agg(F.max_by("bundle_id", "depth").alias("bundle_id"))
    return external.join(owner, ["target", "file"], "left").withColumn("bundle_id", F.coalesce("bundle_id", F.concat_ws("!", "target", F.lit("."))))


def scan_files(files: DataFrame, rules: list[Rule] = RULES, external: DataFrame | None = None, suppressions: list[dict] | None = None, block_at: int = 3, warn_at: int = 2) -> Scan:
    """A scan of the files of one or more targets (see sources: read_tree, read_selected).

    Packaging, metadata and other tools' findings join those of the catalog;
    findings that a suppression names stand in the report and count in no verdict.
    """
    grouped = stored(group_bundles(files.drop("content")), "grouped")
    more = packaging_findings(grouped).unionByName(metadata_findings(grouped))
    if external is not None:
        more = more.unionByName(own_bundle(external, grouped).select(*more.columns))
    texts = grouped.filter(F.col("text").isNotNull()).select(*FILE)
    found = stored(rollup.suppress(scan_bundles(texts, rules, more), suppressions or []), "findings")
    counted = found.filter(~F.col("suppressed"))
    return Scan(grouped, found, rollup.bundle_verdicts(grouped, counted, block_at, warn_at))


def scan_folder(spark: SparkSession, root: str, skills: list[str] | None = None, **options) -> Scan:
    """A scan of a folder, or of the skills selected in it."""
    return scan_files(read_selected(spark, root, skills), **options)
