"""Helpers of this subpackage: shared tables, hot-key joins, batches of bounded size."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import new_path, shared_dir, stored, tidy  # noqa: F401

#: A broadcast side has at most this many rows; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000
#: Bytes of a file of a table whose size is known to be small, and files for each core that such a table has at least.
FILE_BYTES, FILES_PER_CORE = 4 << 20, 4
#: Bytes of a batch of rows that Spark hands to Python, unless the session says otherwise.
ARROW_BYTES, ARROW_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key is hot if it holds over one in HOT_PARTS of the rows, so there are fewer hot keys than this.
HOT_PARTS = 1000


def gathered(df: DataFrame, most_bytes: int) -> DataFrame:
    """df of at most so many bytes in no more partitions than they need, and a few for each core: a small table takes as many tasks and files as it has rows for, not as many as a shuffle has partitions."""
    return df.coalesce(max(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, most_bytes // FILE_BYTES + 1))


class Scratch:
    """Tables that a job writes for itself, and can drop once what it returns no longer reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str, most_bytes: int | None = None) -> DataFrame:
        """See stored() and, where it is known how many bytes df has at most, gathered()."""
        if most_bytes is not None:
            df = gathered(df, most_bytes)
        path = new_path(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keep: DataFrame) -> None:
        """Remove all tables stored so far but for those given, which stored() has returned."""
        held = {f.rpartition("/")[0].rpartition("/")[2] for df in keep for f in df.inputFiles()}
        hadoop, context = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            if path.rpartition("/")[2] not in held:
                at = hadoop(path)
                at.getFileSystem(context).delete(at, True)
        self.paths = [p for p in self.paths if p.rpartition("/")[2] in held]


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as make it none of the columns (case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives the memory it freed back to the system at a task's end: Python workers wait for other work, beside a JVM that needs the room."""

    @functools.wraps(run)
    def lean(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return lean


def small_batches(spark: SparkSession) -> None:
    """Let batches for Python have ARROW_BYTES, where the session doesn't set their size: by default 10,000 whole texts stand in memory at once in the JVM, which doubles its buffers as they grow, and in Python."""
    if ARROW_SETTING not in spark.conf.getAll:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))


def release_memory() -> None:
    """Give free memory of Arrow's and the C library's allocators back to the system, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has


def join_dimension(left: DataFrame, dim: DataFrame, on: str, hot_salts: int = 16) -> DataFrame:
    """Left join of large rows to a dimension with one row a key, nulls matching nulls.

    The dimension is broadcast only if it is counted to have at most
    BROADCAST_ROWS rows. Beyond that it is repeated over salts, so that a key
    with a third of the rows still spreads over `hot_salts` tasks.
    """
    dim = dim.withColumnRenamed(on, "_dim_key")
    if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(dim), F.col(on).eqNullSafe(F.col("_dim_key")), "left").drop("_dim_key")
    salted = left.withColumn("_salt", (F.rand(7) * hot_salts).cast("int"))
    dim = dim.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(hot_salts - 1))))
    cond = F.col(on).eqNullSafe(F.col("_dim_key")) & (F.col("_salt") == F.col("_dim_salt"))
    return salted.join(dim, cond, "left").drop("_dim_key", "_salt", "_dim_salt")


def join_unique(left: DataFrame, right: DataFrame, key: str, n_rows: str, total: int, how: str = "left", parts: int = HOT_PARTS, whole: bool = False) -> DataFrame:
    """Join to `right`, which has one row a key and in `n_rows` the left rows of that key.

    Keys that hold over 1/parts of `total` rows are fewer than `parts`, whatever
    the data: these are broadcast. All others are joined by a shuffle. Values of
    right that stand in left under the same name replace it. If right
    may be broadcast whole, it is where left has at most BROADCAST_ROWS rows, so
    right no more keys; then left isn't shuffled.
    """
    if whole and total <= BROADCAST_ROWS:
        values = [c for c in right.columns if c != key]
        return left.join(F.broadcast(right), key, how).select(*left.columns, *values)
    least = max(total // parts, 1000)
    hot = right.filter(F.col(n_rows) > least).select(F.col(key).alias("_hot_key"), F.struct(*[c for c in right.columns if c != key]).alias("_hot"))
    values = [c for c in right.columns if c != key]
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    rest = marked.filter(F.col("_hot_key").isNull()).drop("_hot_key", "_hot").join(right.filter(F.col(n_rows) <= least), key, how)
    on_hot = marked.filter(F.col("_hot_key").isNotNull()).select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in values])
    return rest.select(*left.columns, *values).unionByName(on_hot)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most max_bytes of `column`; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def random_rows(df: DataFrame, n: int, rows: int, order: list[Column]) -> DataFrame:
    """At most `rows` of df's n rows, those of the least order, whose first column is an xxhash64: a random choice that is the same however df is dealt out.

    Rows above the hash below which about twice as many lie are left out first,
    so no task sees many more.
    """
    if n > 2 * rows:
        df = df.filter(order[0] < F.lit(-(1 << 63) + int(2 * rows / n * 2.0**64)))
    return df.orderBy(*order).limit(rows)
