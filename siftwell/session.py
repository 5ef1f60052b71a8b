"""Session settings and table readers shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "siftwell") -> SparkSession:
    """A local session with the settings the queries expect (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent, a local session gets a temporary folder and a
    cluster a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local["):
            found = tempfile.mkdtemp(prefix="siftwell-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/siftwell-{label}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage if its heap has grown beyond half of what it may take.

    Plans of jobs that are done are garbage, but the heap rather grows than
    collects them, and their shuffle files stay with them.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() * 2 > heap.maxMemory():
        spark._jvm.System.gc()


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: later uses neither recompute it nor depend on one executor."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
