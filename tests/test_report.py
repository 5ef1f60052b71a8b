"""Reports: names, URIs, SARIF results, summaries."""

import json

from pyspark.sql import functions as F

from siftwell.operators import report, rollup

ROWS = "bundle_id string, rule_id string, sev int, conf int, file string, line int, column int, snippet string, message string, ord int"


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_names_and_uris(spark):
    assert _one(spark, report.rule_name(F.col("r")), r="exec/download-and_run") == "DownloadAndRun"
    assert _one(spark, report.rule_anchor(F.col("r")), r="exec/a/b") == "exec-a-b"
    for file, prefix, want in [
        ("a b/c+(1)!~'é.md", "", "a%20b/c%2B(1)!~'%C3%A9.md"), ("x\\y.md", "root//", "root/x/y.md"), ("package.json#scripts.x", "", "package.json"), ("./", "", "."), ("", "", "."), ("*.md", "", "*.md"),
    ]:
        assert _one(spark, report.uri(F.col("f"), prefix), f=file) == want


def test_sarif_rows(spark):
    rows = spark.createDataFrame([("b", "x/y-z", 3, 2, "f#part", 4, None, "s", "m", 0), ("b", "x/y", 1, 0, "g", None, None, None, None, 1)], ROWS)
    first, second = [json.loads(r[0]) for r in report.sarif_results(rows).select(F.to_json("result")).collect()]
    assert first["level"] == "error" and first["properties"] == {"severity": "high", "confidence": "high", "bundle": "b", "path": "f#part"}
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "f", "uriBaseId": "%SRCROOT%"}, "region": {"startLine": 4, "snippet": {"text": "s"}}}
    assert second["level"] == "note" and "region" not in second["locations"][0]["physicalLocation"] and len(second["partialFingerprints"]["siftwell/v1"]) == 64
    assert report.sarif_results(rows.limit(0)).count() == 0


def test_summary_keeps_to_its_budget(spark):
    rows = spark.createDataFrame([("b", "x/y", 3, 2, "f", i, 1, None, "m" * 1000, i) for i in range(9)] + [("c", "x/y", 1, 2, "f", 1, 1, None, "m", 0)], ROWS)
    bundles = spark.createDataFrame([("b",), ("c",), ("d",)], "bundle_id string")
    got = {r["bundle_id"]: r["summary"] for r in report.agent_summary(rollup.bundle_verdicts(bundles, rows), rows).collect()}
    lines = got["b"].split("\n")
    assert lines[0] == "siftwell blocked b: 9 high." and lines[-1] == "- and 5 more." and len(lines) == 6 and all(len(x) == 300 for x in lines[1:-1]) and len(got["b"]) <= report.SUMMARY
    assert got["c"] == "siftwell passed c (1 low, below the warning threshold)." and got["d"] == "siftwell found no issues in d."
    assert {r["summary"] for r in report.one_line(rollup.bundle_verdicts(bundles, rows)).collect()} == {"siftwell: block for b (9 high)", "siftwell: pass for c (1 low)", "siftwell: pass for d"}


def test_markdown_cells(spark):
    rows = spark.createDataFrame([("b", "x/y", 2, 2, "f|g", 0, 1, None, "one\n\\two", 0)], ROWS)
    assert report.markdown_rows(rows, 3).first()["row"] == "| medium | `x/y` | f\\|g | one \\\\two |"
