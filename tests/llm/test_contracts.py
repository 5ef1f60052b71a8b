"""The opN queries on a small folder with odd rows and clashing columns, against brute force."""

import gzip
import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest

from siftwell.llm import near_duplicates, warc
from siftwell.llm.common import new_path
from siftwell.llm.registry import QUERIES

PATTERNS = [("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    words = [f"word{k}" for k in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randrange(3, 150))) for i in range(80)] + [(80, ""), (81, None), (None, text(40)), (5, text(9)), (5, text(9))]
    rows += [(100, f"é password: hunter2hunter2 {text(20)} AKIA{'B7' * 9} x"), (101, f'{text(9)} "token" = "{r.getrandbits(160):040x}" secret=short'), (102, "0" * 40), (103, text(60_000) + " api_key=abcdefgh1")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, "clash", -1.0, 9) for x in rows], "doc_id long, text string, spans string, score double, n_hex int").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(70)] + [(3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return rows, str(path)


def test_op3(spark, folder):
    rows, sf = folder
    got = QUERIES["op3_quality_classifier"](spark, sf)
    assert {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}.items() <= dict(got.dtypes).items()
    got = got.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_op6(spark, folder):
    rows, sf = folder
    got = QUERIES["op6_secret_scan"](spark, sf)
    assert {"n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}.items() <= dict(got.dtypes).items()
    want = []
    for i, t in rows:
        spans = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(PATTERNS) for m in re.finditer(p, t or "", re.A) if m.end(g) - m.start(g) >= least]
        said = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in sorted(spans))
        want.append((str(i), *[sum(x[1] == k for x in spans) for k in range(3)], hashlib.sha256(said.encode()).hexdigest()))
    rows = got.collect()
    assert sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == sorted(want)


def test_sets_of_rows_without_an_id_are_confirmed(spark):
    r = random.Random(5)
    base = [f"t{r.random()}" for _ in range(200)]
    one, two = list(base), list(base)
    one[7], two[150] = "changed", "other"
    df = spark.createDataFrame([(None, " ".join(base)), (4, " ".join(one)), (9, " ".join(two))], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["component_id"]) for x in near_duplicates.near_duplicates(df).collect())
    assert got == [("4", 4), ("9", 4), ("None", 4)]


def test_longer_shingles_link_less(spark):
    base = [f"t{i}" for i in range(150)]
    edited = ["x" if i in (20, 60, 100, 140) else w for i, w in enumerate(base)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited))], "doc_id long, text string")
    kept = lambda n: sum(x["kept"] for x in near_duplicates.near_duplicates(df, shingle=n).collect())
    assert (kept(4), kept(5)) == (1, 2)


def test_record_ids_are_unique_and_dates_are_utc(spark):
    rows = [(-1, "u", "a"), (-2, "u", "b"), (2**48 + 5, "u", "c"), (5, "u", "d"), (None, "u", "e"), (0, "u", "f"), (7, "u", "g"), (7, "u", "g"), (8, "u", "g")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = new_path(spark, "w")
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), out)
        lines = warc.merged_index(warc.index_runs(spark, out)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    text = b"".join(gzip.decompress(f.read_bytes()) for f in Path(out.removeprefix("file:")).glob("part-*"))
    ids = re.findall(rb"WARC-Record-ID: (\S+)", text)
    assert len(ids) == len(rows) == len(set(ids)) == len(lines)
    assert {x["capture_s"] for x in lines if x["page_id"] == 5} == {warc.FIRST_CAPTURE + 5} and b"WARC-Date: 2024-01-01T00:00:05Z" in text
    assert {x["page_id"]: x["refers_to"] for x in lines}[8] == 7
