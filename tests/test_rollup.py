"""Ranks, roll-up, suppression, evaluation, guard, state and readers."""

import json

from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import classify, evaluate, guard, judge, rollup
from siftwell.sources import bundles, external
from siftwell.streaming import audit

FINDING = "bundle_id string, rule_id string, sev int, conf int, file string, line int, column int, ord int"


def test_verdicts(spark):
    rows = spark.createDataFrame([("a", "x/y", 3, 1, "f", 1, 1, 0), ("b", "x/y", 3, 0, "f", 1, 1, 0), ("c", "x/z", 1, 2, "f", None, 1, 0)], FINDING)
    all_ = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "bundle_id string")
    got = {r["bundle_id"]: r for r in rollup.bundle_verdicts(all_, rows).collect()}
    assert [got[k]["verdict"] for k in "abcd"] == [2, 1, 0, 0] and got["d"]["n_high"] == 0
    assert rollup.target_verdict(rollup.bundle_verdicts(all_, rows)).first().asDict() == {"verdict": 2, "n_pass": 2, "n_warn": 1, "n_block": 1}


def test_dedupe_keeps_the_worst_and_the_first(spark):
    rows = spark.createDataFrame([("a", "r", 1, 1, "f", 1, 1, 0), ("a", "r", 3, 1, "f", 1, 2, 1), ("a", "r", 3, 2, "f", 1, 3, 2), ("a", "r", 2, 2, "f", None, 1, 3)], FINDING)
    assert sorted((r["sev"], r["column"]) for r in rollup.dedupe(rows).collect()) == [(2, 1), (3, 2)]


def test_suppressions(spark):
    rows = spark.createDataFrame([("a", "x/y", 1, 1, "d/f.md", 1, 1, 0), ("a", "z/y", 1, 1, "f.md", 1, 1, 0), ("a", "z/w", 1, 1, "d/e/f.md", 1, 1, 0)], FINDING)
    keep = lambda s: sorted(r["rule_id"] for r in rollup.suppress(rows, s).filter("not suppressed").collect())
    assert keep([{"rule": "x/*"}]) == ["z/w", "z/y"] and keep([{"rule": "*", "path": "d/**"}]) == ["z/y"] and keep([{"rule": "*", "path": "*.md"}]) == ["x/y", "z/w"] and len(keep([])) == 3


def test_metrics_of_six_rows(spark):
    rows = spark.createDataFrame([(True, 2), (True, 1), (True, 0), (False, 2), (False, 1), (False, 0)], "positive boolean, verdict int")
    assert evaluate.confusion(rows, 2).first().asDict() == {"tp": 1, "fp": 1, "fn": 2, "tn": 2}
    m = evaluate.metrics(evaluate.confusion(rows, 1)).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 2, 1, 1) and m["precision"] == 0.5
    none = evaluate.metrics(evaluate.confusion(rows.filter("false"), 1)).first()
    assert none["f1"] == 0 and none["precision"] == 0


def test_auc_and_threshold_against_pairs(spark):
    pos, neg = [1, 2, 2, 5, 9], [0, 1, 2, 4]
    rows = spark.createDataFrame([(True, float(x)) for x in pos] + [(False, float(x)) for x in neg], "positive boolean, score double")
    plain = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(evaluate.auc(rows).first()["auc"] - plain) < 1e-12
    assert evaluate.threshold_at_rate(rows, 0.25).first()["threshold"] == sorted(neg)[::-1][1]


def test_text_functions(spark):
    df = spark.createDataFrame([("a" + chr(0x200B) + "b", "https://u@WWW.Example.com:8/x", "aabb"), (None, None, "")], "t string, u string, e string")
    r = X.with_entropy(df, "e", "h").select(X.reveal_invisible(F.col("t")).alias("t"), X.host_of(F.col("u")).alias("u"), "h", X.mask_secret(F.lit("abcdefghij")).alias("m")).collect()
    assert r[0]["t"] == "a<U+200B>b" and r[0]["u"] == "www.example.com" and abs(r[0]["h"] - 1) < 1e-12 and r[0]["m"] == "abcd************ij" and r[1]["t"] is None and r[1]["h"] == 0
    assert spark.range(1).select(X.strict_base64(F.lit("aGk=")).alias("a"), X.strict_base64(F.lit("!!")).alias("b")).first() == ("hi", None)


def test_classification(spark):
    rows = [("a/SKILL.md", "", "skill-md"), ("x.py", "", "script"), ("x", "#!/usr/bin/env bash", "script"), ("package.json", "", "manifest"), ("p.png", "", "binary"), ("n.txt", "", "text"), ("R.md", "", "markdown")]
    df = spark.createDataFrame(rows, "path string, head string, kind string")
    assert df.filter(classify.kind(F.col("path"), F.col("head"), F.lit(False)) != F.col("kind")).count() == 0


def test_tree_bundles_and_packaging(spark, tmp_path):
    for name, data in {"a/SKILL.md": b"---\nname: Bad Name\n---\nhi", "a/lib/x.sh": b"echo", "b.txt": b"z", "a/i.png": b"\x7fELF" + bytes(20), "node_modules/q.js": b"x", "w.md": "é".encode("utf-16")}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    tree = bundles.group_bundles(bundles.read_tree(spark, str(tmp_path)))
    got = {r["path"]: r for r in tree.collect()}
    assert set(got) == {"a/SKILL.md", "a/lib/x.sh", "b.txt", "a/i.png", "w.md"}
    assert got["a/lib/x.sh"]["bundle_root"] == "a" and got["b.txt"]["bundle_root"] == "." and got["w.md"]["text"] == "é"
    ids = {r["rule_id"] for r in bundles.packaging_findings(tree).collect()}
    assert {"packaging/executable-binary", "packaging/extension-mismatch"} <= ids
    assert {r["rule_id"] for r in bundles.metadata_findings(tree).collect()} == {"metadata/invalid-name", "metadata/invalid-description"}


def test_external_reports(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"RuleID": "private-key", "Description": "Key", "StartLine": 3, "Secret": "x" * 20, "File": "a"}]))
    (tmp_path / "s.json").write_text(json.dumps({"results": [{"check_id": "r", "path": "p", "start": {"line": 2, "col": 1}, "extra": {"message": "m", "severity": "ERROR"}}]}))
    (tmp_path / "o.json").write_text(json.dumps({"results": [{"source": {"path": "l"}, "packages": [{"package": {"name": "n", "version": "1"}, "groups": [{"ids": ["CVE"], "max_severity": "9.8"}, {"ids": ["X"], "max_severity": ""}]}]}]}))
    assert external.gitleaks(spark, str(tmp_path / "g.json"), "b").first()["sev"] == 3
    assert external.semgrep(spark, str(tmp_path / "s.json"), "b").first()["sev"] == 3
    assert sorted(r["sev"] for r in external.osv(spark, str(tmp_path / "o.json"), "b").collect()) == [2, 4]


def test_intents(spark):
    rows = [(1, "cd x && git clone https://h/o/r.git"), (2, 'bash -c "npx skills add o/r"'), (3, "echo 'git clone x'"), (4, "sudo claude plugin install p; ls"), (5, None), (6, "cp -r s ~/.claude/skills/s")]
    got = {(r["command_id"], r["kind"]): r["source"] for r in guard.intents(spark.createDataFrame(rows, "command_id int, command string")).collect()}
    assert got == {(1, "git-clone"): "https://h/o/r.git", (2, "skills-cli"): "o/r", (4, "claude-plugin"): "p", (6, "copy-into-skills"): "s"}


def test_judge(spark):
    f = spark.createDataFrame([("b", "c", 2, 2, False), ("b", "c", 4, 2, False), ("b", "d", 2, 2, True)], "bundle_id string, category string, sev int, conf int, hard boolean")
    s = spark.createDataFrame([("b", "c", 0.01), ("b", "d", 0.01)], "bundle_id string, category string, p_true double")
    assert sorted((r["sev"], r["conf"], r["effect"]) for r in judge.doubt(f, s).collect()) == [(2, 0, "doubted"), (2, 2, "confirmed"), (4, 2, "confirmed")]
    assert judge.doubt(f, s).count() == f.count()


def test_registry_upsert(spark):
    row = "path string, digest string, verdict int, flagged_at int, quarantined boolean"
    old = spark.createDataFrame([("a", "1", 2, 10, False), ("b", "2", 2, 10, True), ("c", "3", 2, 10, False), ("d", "4", 2, 10, False)], row)
    fresh = spark.createDataFrame([("a", "1", 2, 99, False)], row)
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = {r["path"]: r["flagged_at"] for r in audit.upsert_registry(old, fresh, paths("a", "b"), spark.createDataFrame([("4",)], "digest string"), paths("c", "d")).collect()}
    assert got == {"a": 10, "b": 10, "c": 10}


def test_audit_stream(spark, tmp_path):
    src = tmp_path / "in"
    schema = "user_id int, n int"
    changed = []
    for batch in ([(1, 1), (2, 1), (1, 2)], [(2, 5), (3, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        log = spark.readStream.schema(schema).parquet(str(src))
        audit.audit_stream(log, str(tmp_path / "state"), str(tmp_path / "cp"), "user_id", ["n"], lambda d, i: changed.append(sorted(tuple(r) for r in d.collect()))).awaitTermination(60)
    assert changed == [[(1, 2), (2, 1)], [(2, 5), (3, 1)]]
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "state/v=1")).collect()) == [(1, 2), (2, 5), (3, 1)]


def test_running_windows_in_parts(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.random() < 0.4, rng.choice([rng.random(), 0.5])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "positive boolean, score double")
    neg = sorted((s for p, s in rows if not p), reverse=True)
    pos = [s for p, s in rows if p]
    plain = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(evaluate.auc(df).first()["auc"] - plain) < 1e-9
    assert evaluate.threshold_at_rate(df, 0.1).first()["threshold"] == neg[int(len(neg) * 0.1)]
    assert evaluate.auc(df.filter("false")).first()["auc"] is None
    assert evaluate.auc(spark.createDataFrame([(True, None), (False, 1.0), (False, None)], df.schema)).first()["auc"] == 0.25


def test_sessions_against_a_walk(spark):
    from datetime import datetime, timedelta
    import random

    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    log = [(u, start + timedelta(seconds=rng.randrange(200_000))) for u in ("a", "b") for _ in range(120)] + [("c", start), ("c", start + timedelta(minutes=30)), ("c", start + timedelta(minutes=59)), ("d", None)]
    want = []
    for user in "abc":
        times = sorted(t for u, t in log if u == user)
        runs = [[times[0]]]
        for t in times[1:]:
            if t - runs[-1][-1] < timedelta(minutes=30):
                runs[-1].append(t)
            else:
                runs.append([t])
        want += [(user, i + 1, r[0], len(r)) for i, r in enumerate(runs)]
    got = audit.sessions(spark.createDataFrame(log, "user_id string, ts timestamp_ntz")).collect()
    assert sorted((r["user_id"], r["session"], r["start"], r["n"]) for r in got) == want


def test_read_budget_of_groups(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 5, 0, 9, 4])] + [(None, 7, 3), (None, 8, 30)], "g string, i int, s long")
    got = {(r["g"], r["i"]): r["read"] for r in bundles.read_budget(rows, 12, "g", F.col("s"), [F.desc("i")]).collect()}
    assert got == {("a", 4): 4, ("a", 3): 8, ("a", 2): 0, ("a", 1): 0, ("a", 0): 0, (None, 8): 12, (None, 7): 0}
    assert bundles.read_budget(rows.filter("false"), 12, "g", F.col("s"), [F.col("i")]).count() == 0


def test_arms_without_the_rules(spark):
    arm = spark.createDataFrame([("a", 10), ("b", 3), ("c", 5)], "bundle_id string, ms long")
    static = spark.createDataFrame([("a", 0, 4), ("b", 2, 9)], "bundle_id string, verdict int, ms long")
    found = spark.createDataFrame([("a", "tool/x", 3, 1), ("a", "x/y", 2, 1), ("b", "x/y", 3, 1), ("c", "tool/x", 2, 0)], "bundle_id string, rule_id string, sev int, conf int")
    alone = evaluate.arm_alone(arm, found, static, F.col("rule_id").startswith("tool/"))
    assert sorted(tuple(r) for r in alone.collect()) == [("a", 2, 6, True), ("b", 0, 0, False), ("c", 0, 5, False)]
    assert sorted(tuple(r) for r in evaluate.with_static(static, alone.filter("bundle_id <> 'b'")).collect()) == [("a", 2, 10), ("b", 2, 9)]


def test_a_policy_replayed(spark):
    found = spark.createDataFrame([("a", "s/1", "s", 3, 1, False), ("a", "s/2", "s", 3, 1, True), ("a", "t/1", "t", 2, 1, False), ("a", "u/1", "u", 1, 1, False), ("b", "s/1", "s", 4, 1, False)], "bundle_id string, rule_id string, category string, sev int, conf int, hard boolean")
    probes = spark.createDataFrame([("a", "P", 0.1), ("a", "Q", 0.9), ("a", "R", 0.95), ("b", "P", 0.1), ("c", "Q", 0.9), ("c", "R", 0.5)], "bundle_id string, probe string, p double")
    got = sorted((r["bundle_id"], r["rule_id"], r["sev"], r["conf"]) for r in judge.replay(found, probes, {"s": "P", "t": "Q"}, {"Q": 0.9, "R": 0.9}, 0.3, 0.7).collect())
    assert got == [("a", "judge/R", 2, 1), ("a", "s/1", 3, 0), ("a", "s/2", 3, 1), ("a", "t/1", 2, 2), ("a", "u/1", 1, 1), ("b", "s/1", 4, 1), ("c", "judge/Q", 2, 1)]


def test_markdown_text(spark):
    df = spark.createDataFrame([("a*b at https://x.y/_z, ask @me", "x`y``"), ("", ""), (None, None)], "t string, c string")
    got = df.select(X.markdown_text(F.col("t")), X.inline_code(F.col("c")), X.table_cell(F.lit("a|b\r\nc")), X.plural(F.length("t"), "sign")).collect()
    assert got[0][0] == "a\\*b at `https://x.y/_z,` ask `@me`" and got[0][1] == "``` x`y`` ```" and got[0][2] == "a\\|b c" and got[0][3] == "30 signs"
    assert got[1][:2] == ("", "``") and got[2][:2] == (None, None)
    runs = spark.createDataFrame([("deadbeef",), ("AB12",), ("zzzz",), ("z",), ("aB3",), (None,)], "r string")
    assert [r[0] for r in runs.select(X.looks_like_id(F.col("r"))).collect()] == [True, True, True, False, False, None]


def test_edits_in_order(spark):
    schema = "t string, e array<struct<old:string,new:string,every:boolean>>"
    rows = [("aXbX", [("X", "$1", False)]), ("aXbX", [("X", "", True), ("ab", "c", False)]), ("a", [("x", "y", False), ("a", "b", False)]), (None, [("", "new", False), ("n", "N", False)]), (None, [("x", "y", False), ("", "z", False)]), ("a", [("", "z", False)]), ("a", [])]
    got = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", i int").orderBy("i").select(guard.edited(F.col("t"), F.col("e")))
    assert [r[0] for r in got.collect()] == ["a$1bX", "c", None, "New", None, None, "a"]
    files = spark.createDataFrame([("b", "p", "old"), ("b", "q", "kept")], "bundle_id string, path string, text string")
    assert sorted(tuple(r) for r in guard.with_writes(files, files.filter("path = 'p'").withColumn("text", F.lit("new"))).collect()) == [("b", "p", "new"), ("b", "q", "kept")]


def test_trust_changes_and_quarantine(spark):
    a, b = "sha256:" + "a" * 64, "sha256:" + "b" * 64
    log = spark.createDataFrame([(a, "trust", 1), (b, "trust", 2), (b, "untrust", 3), (a, "untrust", 0), ("a", "trust", 9)], "digest string, op string, at int")
    now = audit.trusted(log, ["at"])
    assert [tuple(r) for r in now.collect()] == [(a, 1)]
    have = spark.createDataFrame([("x", None, a, 2), ("y", None, b, 2), ("z", "plugin", b, 2), ("w", "skill", b, 1)], "path string, kind string, digest string, verdict int")
    assert [r["path"] for r in guard.quarantinable(have, now).collect()] == ["y"]
    before = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None), ("v", None)], "path string, digest string")
    after = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None), ("v", "1"), ("n", None)], "path string, digest string")
    assert sorted(tuple(r) for r in audit.changes(before, after).collect()) == [("n", "added"), ("v", "changed"), ("y", "changed")]
    assert [tuple(r) for r in audit.changes(before.limit(1), after.limit(0)).collect()] == [("x", "removed")]
