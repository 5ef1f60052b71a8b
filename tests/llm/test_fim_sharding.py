"""Fill-in-middle and sharding against plain Python, on odd rows with clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.llm import fill_in_middle as fim
from siftwell.llm import sharding
from siftwell.llm.common import new_path
from siftwell.llm.registry import QUERIES


def plain_fim(doc_id, text, seed="1", plain_from=90, spm_below=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= plain_from:
        return len(units), "plain", text, None, None
    if h[3] % 100 < spm_below:
        return len(units), "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return len(units), "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    letters = "ab Z\n\t<>PSM|.0é中\U0001f600\u0000ÿ\u2028"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(60)))) for i in range(300)]
    rows += [(400, ""), (401, None), (None, "no id at all"), (None, "no id at all"), (5, "same id, other text"), (5, "same id, other text"), (402, "holds <S> itself")]
    rows += [(500 + i, f"{'<' * (i % 3)}{'S>' * (i % 2)} x <{'P' * (i % 4)} y M> <S") for i in range(40)]
    rows += [(600, "word " * 400_000), (601, "x" * 1_500_000), (602, "é" * 300_000)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, "clash", 7, 9, -1) for x in rows], "doc_id long, text string, output string, n int, shard int, slot int").write.parquet(str(path / "documents.parquet"))
    empty = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(empty / "documents.parquet"))
    return rows, str(path), str(empty)


def test_op11_equals_plain_code_and_restores_every_text(spark, folder):
    rows, sf, empty = folder
    got = QUERIES["op11_fill_in_middle"](spark, sf)
    assert {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}.items() <= dict(got.dtypes).items()
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        n, form, out, pre, mid = plain_fim(i, t)
        want[i, n, form, pre, mid, sha(out), sha(t)] += 1
    assert Counter((x["doc_id"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output_sha256"], x["restored_sha256"]) for x in got.collect()) == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    assert QUERIES["op11_fill_in_middle"](spark, empty).collect() == []


def test_fim_shares_and_seed_are_parameters(spark, folder):
    rows, sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 600")
    got = fim.fill_in_middle(docs, seed="other", plain_from=50, spm_below=100).collect()
    want = Counter((i, *plain_fim(i, t, "other", 50, 100)) for i, t in rows if i is not None and i < 600)
    assert Counter((x["doc_id"], x["n"], x["form"], x["output"], x["prefix_chars"], x["middle_chars"]) for x in got) == want


def plain_shard(key, weights):
    import math

    def score(s):
        digest = hashlib.sha256(f"{'' if key is None else key}:{s}".encode()).hexdigest()
        return -math.log((int(digest[:13], 16) + 0.5) / 16.0**13) / weights[s]

    return min(weights, key=lambda s: (score(s), s))


def test_op13_equals_plain_code(spark, folder):
    rows, sf, empty = folder
    got = QUERIES["op13_sharding"](spark, sf)
    assert {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}.items() <= dict(got.dtypes).items()
    got = got.collect()
    want = Counter()
    for i, t in rows:
        data = (t or "").encode()
        want[i, len(data) + 1, zlib.crc32(data), "key", plain_shard(i, sharding.even(16)), plain_shard(i, sharding.even(17))] += 1
    assert Counter((x["doc_id"], x["size"], x["text_crc32"], x["law"], x["shard"], x["grown_shard"]) for x in got) == want
    by = {}
    for x in got:
        by.setdefault(x["shard"], []).append(x)
    for part in by.values():
        part.sort(key=lambda x: x["slot"])
        assert [x["slot"] for x in part] == list(range(len(part)))
        order = [(x["doc_id"] is not None, x["doc_id"] or 0, x["text_crc32"], x["size"]) for x in part]
        assert order == sorted(order)
    assert all(x["grown_shard"] in (x["shard"], 16) for x in got) and any(x["grown_shard"] == 16 for x in got)
    assert QUERIES["op13_sharding"](spark, empty).collect() == []


def test_shards_follow_their_weights(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    weights = {0: 1.0, 1: 2.0, 2: 0.0, 7: 5.0}
    got = {r["shard"]: r["n"] for r in sharding.shard_rows(ids, weights, {9: 2.0}).groupBy("shard").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {0, 1, 7} and all(abs(got[s] / 20_000 - w / 8) < 0.02 for s, w in weights.items() if w)
    moved = sharding.shard_rows(ids, weights, {9: 2.0}).filter("shard <> grown_shard").agg(F.count("*").alias("n"), F.min("grown_shard"), F.max("grown_shard")).first()
    assert moved[1] == moved[2] == 9 and abs(moved["n"] / 20_000 - 0.2) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), {0: 0.0})


def test_one_hot_key_of_equal_rows_spreads(spark):
    rows = spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_rows(rows, sharding.even(4)).select("shard", "slot").collect()
    assert len({x["shard"] for x in got}) == 1 and sorted(x["slot"] for x in got) == list(range(5000))


def test_written_shards_read_back(spark, folder):
    rows, sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "output")
    out = new_path(spark, "shards")
    sharding.write_shards(docs, sharding.even(4), out, file_bytes=1 << 20)
    back = sharding.read_shards(spark, out)
    assert Counter((x["doc_id"], x["text"]) for x in back.collect()) == Counter(rows)
    some = sharding.read_shards(spark, out, [2])
    assert {x["doc_id"] for x in some.collect()} == {i for i, _ in rows if plain_shard(i, sharding.even(4)) == 2}
    assert all("shard=2" in f for f in some.select(F.input_file_name().alias("f")).distinct().toPandas()["f"])
