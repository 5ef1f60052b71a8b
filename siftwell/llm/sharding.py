"""Sharding by rendezvous hashing over weighted shards, with built-in functions only.

Each record's stable key and each shard's id give a uniform hash u; the record
goes to the shard of the least -ln(u) / weight. A shard's score doesn't depend
on the others, so one more shard takes records only into itself, its share by
weight, and one less hands its own out among the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import stored, unused

SHARDS = 16
#: Hexadecimal digits of a hash that make up u: 52 bits, which a double holds exactly.
_DIGITS = 13
#: Bytes of text in a written file, about.
FILE_BYTES = 256 << 20


def even(n: int) -> dict[int, float]:
    """Shards 0 to n - 1 of equal weight."""
    return dict.fromkeys(range(n), 1.0)


def score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight of a key on one shard: less is better. A null key counts as the empty string."""
    digest = F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")), 256)
    u = (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return -F.log(u) / float(weight)


def _best(key: Column, weights: Mapping[int, float]) -> Column:
    """Score and id of the shard of the least score, the smaller id on ties."""
    best = [F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items()) if w > 0]
    if not best:
        raise ValueError("no shard has a weight above 0")
    return F.least(*best) if len(best) > 1 else best[0]


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key: that of the least score, the smaller id on ties. Shards of weight 0 take nothing."""
    return _best(key, weights)["shard"]


def grown(key: Column, weights: Mapping[int, float], more: Mapping[int, float]) -> Column:
    """The shard of a key once the shards of `more`, which must be new ids, stand beside the others."""
    if set(weights) & set(more):
        raise ValueError("shards that stand in both")
    return rendezvous(key, {**weights, **more})


def slots(rows: DataFrame, shard: str, order: Sequence[Column], slot: str = "slot") -> DataFrame:
    """rows with slot: the place, gapless from 0, of each row in its shard by `order`.

    Rows are stored once in ranges of shard and order, so leave texts out.
    Counts of the ranges before it place a range, and a window numbers the rows
    within one, so no task holds a shard; rows that tie in the whole order are
    dealt over ranges by their row number, and stand for each other.
    """
    at, part, before, one = (unused(n, rows.columns) for n in ("_at", "_part", "_before", "_one"))
    ranged = rows.withColumn(at, F.monotonically_increasing_id()).repartitionByRange(shard, *order, at)
    ranged = stored(ranged.withColumn(part, F.spark_partition_id()), "shard-ranges")
    # one row for each shard of a range: as many as ranges and shards
    sizes = ranged.groupBy(shard, part).agg(F.count("*").alias(one))
    earlier = F.sum(one).over(Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(shard).alias("_s"), F.col(part).alias("_p"), F.coalesce(earlier, F.lit(0)).alias(before))
    within = F.row_number().over(Window.partitionBy(shard, part).orderBy(*order, at)) - 1
    placed = ranged.withColumn(one, within).join(sizes, (F.col(shard) == F.col("_s")) & (F.col(part) == F.col("_p")))
    return placed.withColumn(slot, (F.col(before) + F.col(one)).cast("long")).select(*rows.columns, slot)


def shard_rows(docs: DataFrame, weights: Mapping[int, float], more: Mapping[int, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot and grown_shard of each row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1. grown_shard: the shard
    once those of `more` stand beside the others (null without them). Within a
    shard rows stand by key, nulls first, then crc and size. The key alone sets
    the shard: rows that share one, or have none, lie in one shard; equal texts
    with different keys may not. A text never moves: only digests are shuffled.
    An empty table gives none; other columns of docs are not read.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    after = grown(F.col(key), weights, more) if more else F.lit(None)
    rows = docs.select(
        F.col(key), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"), after.cast("int").alias("grown_shard"),
    )
    return slots(rows, "shard", [F.col(key), F.col("text_crc32"), F.col("size")]).select(key, "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: Mapping[int, float], path: str, key: str = "doc_id", column: str = "shard", file_bytes: int = FILE_BYTES, text: str = "text") -> None:
    """docs as parquet in a folder a shard (`shard=3/`), each shard in as many files of about file_bytes of text as it needs.

    A column of docs by the name of `column` is replaced. A shard's rows are
    dealt to its files by row number, so equal keys spread.
    """
    sized = docs.drop(column).withColumn(column, rendezvous(F.col(key), weights).cast("int"))
    total = sized.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    files = max(1, round(total / file_bytes / max(len(weights), 1)))
    file = unused("_file", sized.columns)
    dealt = sized.withColumn(file, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)).cast("int"))
    dealt.repartition(files * max(len(weights), 1), column, file).drop(file).write.partitionBy(column).parquet(path)


def read_shards(spark: SparkSession, path: str, shards: Sequence[int] | None = None, column: str = "shard") -> DataFrame:
    """Rows of a folder that write_shards() wrote; with `shards`, those folders alone are opened."""
    rows = spark.read.parquet(path)
    return rows if shards is None else rows.filter(F.col(column).isin(*shards))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards, and its shard were there 17."""
    rows = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), even(SHARDS), {SHARDS: 1.0})
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: DuckDB has no CRC-32: its table of bytes follows from the polynomial, and each text's bytes are folded over it.
OP13_SQL = r"""
WITH RECURSIVE k(i, v, step) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END, step + 1 FROM k WHERE step < 8),
bytes AS (SELECT list(v ORDER BY i) AS t FROM k WHERE step = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT r, doc_id, strlen(text)::BIGINT + 1 AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
                                     lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM d, bytes),
scored AS (
  SELECT r, s, -ln((('0x' || sha256(coalesce(doc_id::VARCHAR, '') || ':' || s)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS score
  FROM d, range(17) t(s)),
best AS (SELECT r, arg_min(s, (score, s)) FILTER (s < 16)::INTEGER AS shard, arg_min(s, (score, s))::INTEGER AS grown_shard FROM scored GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM c JOIN best USING (r)"""
