"""Keyed state in hash buckets: a batch rewrites the buckets of its keys and no other.

State is the last row of each key. A key lies in the bucket of its hash; a
bucket's rows are a folder a version, and a manifest a batch names the version
of each bucket that counts. A batch that runs again writes the same folders and
the same manifest again. A row that comes late loses to the one it is older
than, in whichever batch it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.streaming.audit import latest

BUCKETS = 256
_MANIFEST = "bucket int, version long, replaced long"


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, tuple[int, int | None]]:
    """Version and replaced version of each bucket after a batch: at most as many rows as buckets. A batch that wrote none, like any before the first, leaves nothing."""
    if number < 0:
        return {}
    return {r["bucket"]: (r["version"], r["replaced"]) for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/v={number}").collect()}


def _rows(spark: SparkSession, path: str, versions: dict[int, int], schema) -> DataFrame:
    folders = [f"{path}/data/b={b}/v={v}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _remove(spark: SparkSession, folders: list[str]) -> None:
    hadoop, context = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for folder in folders:
        at = hadoop(folder)
        at.getFileSystem(context).delete(at, True)


def merge_batch(batch: DataFrame, number: int, path: str, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Merge batch `number` (from 0, one after another) into the state under path: the rows of keys that are new or whose row now differs.

    Rows of the batch are reduced to one a key before they meet the state. The
    batch's buckets, and no others, are read and written; versions that the
    batch before replaced are removed, so a reader may lag by one batch.
    """
    spark, schema = batch.sparkSession, batch.schema
    now = latest(batch, key, order).select(*batch.columns)
    known = _manifest(spark, path, number - 1)
    touched = [r["b"] for r in now.select(bucket_of(key, buckets).alias("b")).distinct().collect()]  # at most as many as buckets
    before = _rows(spark, path, {b: known[b][0] for b in touched if b in known}, schema)
    merged = latest(before.unionByName(now), key, order).select(*batch.columns)
    dealt = merged.withColumns({"b": bucket_of(key, buckets), "v": F.lit(number).cast("long")})
    dealt.repartition(max(len(touched), 1), "b").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("b", "v").parquet(f"{path}/data")
    after = {b: (v, None) for b, (v, _) in known.items()} | {b: (number, known[b][0] if b in known else None) for b in touched}
    spark.createDataFrame([(b, v, r) for b, (v, r) in sorted(after.items())], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={number}")
    _remove(spark, [f"{path}/data/b={b}/v={r}" for b, (_, r) in known.items() if r is not None])
    return _rows(spark, path, dict.fromkeys(touched, number), schema).exceptAll(before)


def state(spark: SparkSession, path: str, number: int, schema) -> DataFrame:
    """The last row of each key after batch `number`."""
    return _rows(spark, path, {b: v for b, (v, _) in _manifest(spark, path, number).items()}, schema)


def keyed_stream(log: DataFrame, path: str, checkpoint: str, key: str, order: list[str], on_change: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the last row of each key of a stream under path (see merge_batch); on_change gets the keys whose row is new or differs. A batch without rows leaves the state as it is."""

    def step(batch: DataFrame, number: int) -> None:
        changed = merge_batch(batch, number, path, key, order, buckets)
        if on_change:
            on_change(changed, number)

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
