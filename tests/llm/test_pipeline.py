"""The corpus pipeline, stage by stage, on a small corpus."""

import random

import corpus_pipeline
from siftwell.llm.common import stored
from siftwell.llm.mixing import WORD  # noqa: F401


def corpus(spark, tmp_path):
    r = random.Random(0)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randrange(30, 200)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[3][1] + " tail", "en", "s1")]
    rows += [(200, "JUNK!! " * 50, "en", "s0"), (201, "a ### b $$$ " * 40, "en", "s1"), (202, "few words", "en", None), (203, None, "en", "s2")]
    rows += [(300 + i, text(60) + f' token = "{r.getrandbits(160):040x}" ' + text(30), "en", "s2") for i in range(4)]
    path = tmp_path / "sf"
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return rows, str(path)


def test_stages(spark, tmp_path):
    rows, sf = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        kept.append(docs)
        if name != "best-fit packing":
            assert docs.columns == columns
    quality, dedup, secrets, mixed, packed = kept
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(quality) == [*range(60), 100, 101, 300, 301, 302, 303]
    assert ids(dedup) == [*range(60), 300, 301, 302, 303]
    assert ids(secrets) == ids(dedup)
    texts = {r["doc_id"]: r for r in secrets.collect()}
    assert all("[secret]" in texts[i]["text"] and texts[i]["n_chars"] == len(texts[i]["text"]) for i in range(300, 304))
    assert all(texts[i]["text"] == rows[i][1] for i in range(60))
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
        assert r["text"] == texts[r["doc_id"]]["text"]
    words = {}
    for i, r in texts.items():
        words.setdefault(r["source"], [0, 0])
        words[r["source"]][0] += len(r["text"].split())
        words[r["source"]][1] += counts.get(i, 0) * len(r["text"].split())
    total = sum(a for a, _ in words.values())
    for k, s in enumerate(sorted(words)):
        assert abs(words[s][1] - min(3 * words[s][0], total * (k + 1) / 6)) <= 200
    starts = {}
    for r in packed.collect():
        starts.setdefault(r["doc_id"], 0)
        starts[r["doc_id"]] += r["piece"] == 0
    assert starts == counts


def test_run_equals_its_stages_on_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_pass(spark):
    r = random.Random(1)
    text = lambda: " ".join(r.choice(["tree", "house", "river", "stone", "cloud", "table"]) + str(r.randrange(90)) for _ in range(60))
    rows = [(i if i % 5 else None, text(), "en", f"s{i % 2}", 1, "keep-me", [f"w{i}"], "r", 7.5, "x") for i in range(20)] + [(3, "junk", "en", "s0", 4, "keep-me", None, "r", 7.5, "x")]
    names = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _words array<string>, _row string, size double, copies string"
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), "stage")
        got = docs.collect()
        assert docs.columns == [x.split()[0] for x in names.split(", ")] and got, name
        assert all((x["n_words"], x["_row"], x["size"], x["copies"]) == ("keep-me", "r", 7.5, "x") and x["_words"][0][0] == "w" for x in got), name
        assert "junk" not in {x["text"] for x in got}
    assert {x["text"] for x in got if x["doc_id"] is None} <= {x[1] for x in rows}
