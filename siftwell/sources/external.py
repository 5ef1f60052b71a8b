"""Reports of other analyzers, read as JSON and mapped to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import clip, mask_secret, one_line

SEMGREP = {"ERROR": 3, "WARNING": 2, "INFO": 1}
WORDS = {"critical": 4, "high": 3, "error": 3, "medium": 2, "moderate": 2, "warning": 2, "low": 1, "note": 1, "info": 0, "informational": 0}


def _by_word(word: Column, table: dict[str, int], other: int = 2) -> Column:
    out = None
    for k, v in table.items():
        hit = F.lower(word) == k.lower()
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(other)


#: Category by a word of the rule or message, first match wins. Fixed values.
CATEGORIES = [("secrets", "secret|credential|key|token|password|leak"), ("prompt-injection", "inject|jailbreak|prompt"), ("supply-chain", "vuln|cve|ghsa|depend|package"), ("remote-execution", "exec|command|eval|shell|rce"), ("exfiltration", "exfil|upload|network|ssrf"), ("obfuscation", "obfusc|encod|base64"), ("persistence", "persist|cron|startup"), ("privilege", "sudo|privilege|root"), ("destructive", "delete|destruct|wipe")]


def category_of(text: Column) -> Column:
    """Category by the words of a rule and its message; execution-surface for none."""
    low, out = F.lower(text), None
    for name, words in CATEGORIES:
        out = F.when(low.rlike(words), name) if out is None else out.when(low.rlike(words), name)
    return out.otherwise("execution-surface")


def _finding(tool: str, bundle: Column, rule: Column, sev: Column, message: Column, file: Column, line: Column) -> list[Column]:
    """The columns of findings (see operators/scan.py), so reports of tools unite with them."""
    return [
        bundle.alias("bundle_id"), F.concat(F.lit(f"external/{tool}:"), rule).alias("rule_id"), clip(one_line(message), 200).alias("title"), category_of(F.concat_ws(" ", rule, message)).alias("category"), sev.cast("int").alias("sev"), F.lit(1).alias("conf"), F.lit(False).alias("hard"),
        file.alias("file"), F.when(line > 0, line).cast("int").alias("line"), F.lit(1).alias("column"), F.lit(None).cast("string").alias("snippet"), F.lit(50_000).alias("ord"), F.lit(f"external:{tool}").alias("source"),
    ]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def gitleaks(spark: SparkSession, path: str, bundle: str) -> DataFrame:
    """Leaks: private keys high, generic keys low, others medium. The secret is masked."""
    rows = _read(spark, path, "RuleID string, Description string, StartLine int, Secret string, File string")
    sev = F.when(F.col("RuleID") == "private-key", 3).when(F.col("RuleID") == "generic-api-key", 1).otherwise(2)
    return rows.select(*_finding("gitleaks", F.lit(bundle), F.col("RuleID"), sev, F.concat_ws(" ", "Description", mask_secret(F.col("Secret"))), F.col("File"), F.col("StartLine")))


def semgrep(spark: SparkSession, path: str, bundle: str) -> DataFrame:
    rows = _read(spark, path, "results array<struct<check_id:string,path:string,start:struct<line:int,col:int>,extra:struct<message:string,severity:string>>>")
    r = rows.select(F.explode("results").alias("r"))
    return r.select(*_finding("semgrep", F.lit(bundle), F.col("r.check_id"), _by_word(F.col("r.extra.severity"), SEMGREP), F.col("r.extra.message"), F.col("r.path"), F.col("r.start.line")))


def osv(spark: SparkSession, path: str, bundle: str) -> DataFrame:
    """Packages' vulnerability groups: bands of the score at 9, 7, 4 and 0."""
    schema = "results array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,groups:array<struct<ids:array<string>,max_severity:string>>>>>>"
    p = _read(spark, path, schema).select(F.explode("results").alias("r")).select("r.source.path", F.explode("r.packages").alias("p")).select("path", "p.package", F.explode("p.groups").alias("g"))
    score = F.expr("try_cast(g.max_severity as double)")
    sev = F.when(score >= 9, 4).when(score >= 7, 3).when(score >= 4, 2).when(score > 0, 1).otherwise(2)
    return p.select(*_finding("osv-scanner", F.lit(bundle), F.element_at("g.ids", 1), sev, F.concat_ws(" ", "package.name", "package.version"), F.col("path"), F.lit(None).cast("int")))


def worded(spark: SparkSession, path: str, bundle: str, tool: str) -> DataFrame:
    """Reports of {findings: [{id, severity, location: {file, start_line}, finding}]} with severities as words."""
    rows = _read(spark, path, "findings array<struct<id:string,severity:string,location:struct<file:string,start_line:int>,finding:string>>")
    r = rows.select(F.explode("findings").alias("r"))
    return r.select(*_finding(tool, F.lit(bundle), F.col("r.id"), _by_word(F.col("r.severity"), WORDS), F.col("r.finding"), F.col("r.location.file"), F.col("r.location.start_line")))
