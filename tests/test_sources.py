"""Reading of files, reports of other tools, the reviewer's scores and guard decisions."""

import json

from pyspark.sql import functions as F

from siftwell.operators import classify, guard, judge
from siftwell.operators.scan import as_files, findings, scan
from siftwell.sources import external
from siftwell.sources.bundles import decoded, group_bundles, read_tree


def test_bad_bytes_hide_no_text(spark):
    rows = [(1, b"ok \xff text"), (2, b"\xef\xbb\xbfbom"), (3, "wide".encode("utf-16")), (4, b""), (5, None)]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, c binary").select("i", decoded(F.col("c")).alias("t")).collect()}
    assert got == {1: "ok \ufffd text", 2: "bom", 3: "wide", 4: "", 5: None}


def test_class_files_are_no_programs(spark):
    rows = [("a/X.class", b"\xca\xfe\xba\xbe rest"), ("a/x", b"\xca\xfe\xba\xbe rest"), ("a/y", b"text")]
    got = spark.createDataFrame(rows, "path string, c binary").select("path", classify.binary_format(F.col("c"), F.col("path")).alias("f")).collect()
    assert {r["path"]: r["f"] for r in got} == {"a/X.class": "java-class", "a/x": "macho-fat", "a/y": None}


def test_a_tree_is_read_and_grouped(spark, tmp_path):
    for name, text in {"one/SKILL.md": b"---\nname: one\n---\nsudo x", "one/run.sh": b"sudo y \xff", "top.txt": b"t", "node_modules/x.js": b"z"}.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(text)
    rows = group_bundles(read_tree(spark, str(tmp_path)))
    assert {(r["path"], r["bundle_root"], r["kind"]) for r in rows.collect()} == {("one/SKILL.md", "one", "skill-md"), ("one/run.sh", "one", "script"), ("top.txt", ".", "text")}
    found = scan(rows.select("bundle_id", "file_id", "path", "kind", "role", "path_context", "text")).collect()
    assert [r["path"] for r in found if r["rule_id"] == "privilege/sudo"] == ["one/run.sh"]


def test_reports_of_tools_unite_with_findings(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"RuleID": "private-key", "Description": "A key", "StartLine": 3, "Secret": "abcdefghijkl", "File": "a.txt"}]))
    (tmp_path / "s.json").write_text(json.dumps({"results": [{"check_id": "exec-call", "path": "b.py", "start": {"line": 0, "col": 1}, "extra": {"message": "eval", "severity": "ERROR"}}]}))
    own = findings(scan(as_files(spark.createDataFrame([("b", "x.sh", "sudo x")], "b string, p string, t string"), F.col("p"), F.col("b"), F.col("t"))))
    rows = own.unionByName(external.gitleaks(spark, str(tmp_path / "g.json"), "b")).unionByName(external.semgrep(spark, str(tmp_path / "s.json"), "b")).collect()
    got = {r["rule_id"]: r for r in rows}
    assert got["external/gitleaks:private-key"]["sev"] == 3 and "abcdefghijkl" not in got["external/gitleaks:private-key"]["title"]
    assert got["external/gitleaks:private-key"]["category"] == "secrets" and got["external/semgrep:exec-call"]["line"] is None and "privilege/sudo" in got


def test_threat_scores_by_hand(spark):
    rows = [("a", p, 0.5) for p in judge.INTENT_PROBES] + [("a", "unofficial_download", 0.1), ("a", "other", 1.0), ("b", "unofficial_download", 0.2), ("c", judge.INTENT_PROBES[0], 0.1)]
    df = spark.createDataFrame(rows, "bundle_id string, probe string, p double")
    got = {r["bundle_id"]: (round(r["score"], 6), r["flagged"]) for r in judge.threat_scores(df).collect()}
    assert got == {"a": (0.3, True), "b": (0.1, True), "c": (0.01, False)}
    said = {r["bundle_id"]: r["snippet"] for r in judge.threat_findings(df).collect()}
    assert said.keys() == {"a", "b"} and said["a"].count(",") == 2 and said["b"] == "unofficial_download 0.20"
    assert judge.dropped(df.selectExpr("bundle_id", "probe rule_id", "'f' file", "1 line"), df.limit(2).selectExpr("bundle_id", "probe rule_id", "'f' file", "1 line")).count() == len(rows) - 2


def test_guard_decides_by_report_and_trust(spark):
    c = spark.createDataFrame([(1, "git clone https://a.example/x && npx skills add good/one"), (2, "git clone https://b.example/y"), (3, "export SKILL_GUARD=0"), (4, "ls")], "command_id int, command string")
    reports = spark.createDataFrame([("https://a.example/x", 2, "d1"), ("good/one", 0, "d2"), ("https://b.example/y", 2, "d3")], "source string, verdict int, digest string")
    decided = guard.decide(guard.intents(c), reports, spark.createDataFrame([("d3",)], "digest string"))
    got = {r["command_id"]: (r["action"], r["guard_required"]) for r in guard.most_severe(decided, "command_id").collect()}
    assert got == {1: (2, False), 2: (0, False), 3: (2, True)}
    flagged = spark.createDataFrame([("p", "d1"), ("q", "d3")], "path string, digest string")
    assert [r["path"] for r in guard.flagged_untrusted(flagged, spark.createDataFrame([("d3",)], "digest string")).collect()] == ["p"]
