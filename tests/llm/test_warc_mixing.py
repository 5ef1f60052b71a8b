"""WARC round trip and index order; mixing against plain arithmetic."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftwell.llm import mixing, warc
from siftwell.llm.common import new_path

PAGES = [(3, "http://b.example/x", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (1, "HTTP://www.B.example:80/X#f", "same"), (2, "https://a.b.example/", "same"), (4, None, None), (5, "http://a.example", ""), (6, "http://a.example", "same"), (7, "u\r\nv", "x" * 300_000)]


def sha(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 4, 5])
def test_archives_round_trip(spark, least):
    out = new_path(spark, "w")
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, original string")
    warc.write_archives(df, out, least, file_bytes=100_000)
    rows = warc.merged_index(warc.index_runs(spark, out), 3).collect()
    first = {}
    for i, _, h in sorted(PAGES, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    for r in rows:
        h = next(p[2] for p in PAGES if p[0] == r["page_id"]) or ""
        of = first[h] if len(h.encode()) >= least and first[h] != r["page_id"] else None
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(h.encode()), sha(h), "revisit" if of else "response", of)
    assert len(rows) == len(PAGES)
    keys = [(r["url_key"], r["capture_s"], r["page_id"]) for r in rows]
    assert keys == sorted(keys)
    files = list(Path(out.removeprefix("file:")).glob("part-*"))
    assert len(files) > 1 and all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files if f.stat().st_size > 40)


def test_empty_and_repeated_pages(spark):
    schema = "page_id long, url string, html string"
    for data in ([], [(1, "u", "a"), (1, "u", "a"), (None, "u", "a")]):
        out = new_path(spark, "w")
        warc.write_archives(spark.createDataFrame(data, schema), out)
        assert warc.merged_index(warc.index_runs(spark, out)).count() == len(data)


def test_loser_tree_merges():
    r = random.Random(0)
    for k in range(9):
        runs = [sorted(((r.choice("abc"), r.randrange(5), r.choice([None, 1, 2]), 0, "", "", None, f"f{i}", n) for n in range(r.randrange(6))), key=warc._order) for i in range(k)]
        merged = list(warc.LoserTree([iter(x) for x in runs])) if k else []
        assert [warc._order(x) for x in merged] == sorted(warc._order(x) for x in sum(runs, []))


def test_url_keys():
    assert warc.url_key("https://www2.A.example:443/P?q#f") == "example,a)/p?q" and warc.url_key("") == ")/" and warc.url_key("http://u@h:81") == "h:81)/"


def waterfill(sizes, weights):
    left, target, total = dict(sizes), {}, sum(sizes.values())
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w > 3 * sizes[s] + 1e-9]
        if not over:
            return target | {s: total * weights[s] / w for s in left}
        for s in over:
            target[s] = 3.0 * sizes[s]
        total -= sum(3 * sizes[s] for s in over)
        left = {s: n for s, n in left.items() if s not in over}
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 20, None: 1}, {"a": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 1000, "d": 1000}, {}])
def test_targets(spark, sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = waterfill(sizes, weights)
    assert got == pytest.approx({s: want.get(s, 0.0) for s in sizes})


def test_mix_takes_its_targets_and_agrees(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", "c", None]) if i % 3 else "hot", r.randrange(0, 60), r.choice([1.0, 0.5])) for i in range(3000)] + [(7, "a", 9, 1.0)] * 2 + [(None, None, 5, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double").withColumn("tie", F.xxhash64("doc_id"))
    targets = mixing.source_targets(df.groupBy("source").sum("size").withColumnRenamed("sum(size)", "source_size"))
    runs = [sorted(map(str, mixing.mix(df.repartition(n), targets, bucket_rows=50).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    taken = mixing.mix(df, targets, bucket_rows=50).toPandas()
    assert (taken["taken"] <= 3 * taken["size"]).all() and (taken["taken"] >= 0).all()
    per = taken.groupby("source", dropna=False).agg(t=("taken", "sum"), target=("target", "first"))
    assert ((per["t"] - per["target"]).abs() <= 1).all()
    assert (taken["taken"] >= taken["size"] * taken["epochs"]).all()


def test_heavier_documents_come_first(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 10, 1.0 if i % 4 < 2 else 0.1) for i in range(8000)], "doc_id long, source string, size long, weight double").withColumn("tie", F.xxhash64("doc_id"))
    targets = mixing.source_targets(df.groupBy("source").sum("size").withColumnRenamed("sum(size)", "source_size"))
    got = mixing.mix(df, targets).filter("source = 'a'").groupBy("weight").avg("drawn").collect()
    drawn = {r["weight"]: r["avg(drawn)"] for r in got}
    assert drawn[1.0] > 2 * drawn[0.1]


def test_sizes_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", " x\x0by z\n"), (4, "a", "   ")], "doc_id long, source string, text string")
    assert [r["size"] for r in mixing.sized(df).orderBy("doc_id").collect()] == [0, 0, 2, 0]
    assert mixing.mix(mixing.sized(df.filter("false")), mixing.source_targets(spark.createDataFrame([], "source string, source_size long"))).count() == 0
