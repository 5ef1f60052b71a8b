"""Incremental audits: change detection against stored state, and windows over the decision log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order: last write wins. Aggregated before the shuffle."""
    values = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return top.select(key, *[F.col(f"_v.{c}").alias(c) for c in values])


def to_scan(targets: DataFrame, cache: DataFrame, policy: str) -> DataFrame:
    """Targets (path, digest) that no cached scan under this policy covers."""
    return targets.join(cache.filter(F.col("policy") == policy).select("digest").distinct(), "digest", "left_anti")


def trusted(log: DataFrame, order: list[str]) -> DataFrame:
    """The digests trusted now, with the columns of their last entry: log has digest and op (trust or untrust), the last one counts. Entries that name no digest are left out."""
    return latest(log.filter(F.col("digest").rlike("^sha256:[0-9a-f]{64}$")), "digest", order).filter("op = 'trust'").drop("op")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed or changed) between two states (path, digest; a row a path)."""
    rows = before.select("path", F.struct("digest").alias("_a")).join(after.select("path", F.struct("digest").alias("_b")), "path", "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return rows.select("path", change.alias("change")).filter("change is not null")


def newly_flagged(now: DataFrame, before: DataFrame) -> DataFrame:
    """Flagged (path, digest) that were not flagged before."""
    return now.join(before.select("path", "digest").distinct(), ["path", "digest"], "left_anti")


def upsert_registry(old: DataFrame, fresh: DataFrame, audited: DataFrame, trusted: DataFrame, existing: DataFrame) -> DataFrame:
    """The registry after an audit (path, digest, verdict, flagged_at, quarantined).

    Fresh entries replace audited ones and keep flagged_at of the same digest;
    old entries stay if they are quarantined, or neither audited nor trusted and
    still exist.
    """
    seen = old.select("path", "digest", F.col("flagged_at").alias("_first"))
    new = fresh.join(seen, ["path", "digest"], "left").withColumn("flagged_at", F.coalesce("_first", "flagged_at")).drop("_first").select(*old.columns)
    rest = old.join(fresh.select("path").distinct(), "path", "left_anti")
    kept = rest.filter("quarantined").unionByName(
        rest.filter(~F.col("quarantined")).join(audited.select("path").distinct(), "path", "left_anti").join(trusted.select("digest").distinct(), "digest", "left_anti").join(existing.select("path").distinct(), "path", "left_semi").select(*old.columns)
    )
    return new.unionByName(kept)


def decision_windows(log: DataFrame, ts: str = "ts", action: str = "event_type", length: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, action and n per tumbling window; on a stream, late sets the watermark."""
    rows = log.withWatermark(ts, late) if late else log
    return rows.groupBy(F.window(ts, length).alias("w"), F.col(action).alias("action")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def audit_stream(log: DataFrame, state_path: str, checkpoint: str, key: str, order: list[str], on_change: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps the last row of each key of a stream as a table of versions under state_path, one folder a batch.

    A batch that runs again writes the same version again, so a failed batch
    leaves nothing twice. on_change gets the keys whose row is new or differs.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = latest(batch, key, order)
        before = spark.read.schema(batch.schema).parquet(f"{state_path}/v={number - 1}") if number else spark.createDataFrame([], batch.schema)
        merged = latest(before.unionByName(now), key, order)
        merged.write.mode("overwrite").parquet(f"{state_path}/v={number}")
        if on_change:
            after = spark.read.schema(batch.schema).parquet(f"{state_path}/v={number}")
            on_change(after.exceptAll(before), number)

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(log: DataFrame, user: str = "user_id", ts: str = "ts", gap_minutes: int = 30) -> DataFrame:
    """user, session (from 1), start, n: runs of events less than gap_minutes apart; events without a time take no part.

    Events of a slot as long as the gap are always of one session, so they are
    counted first: the window sees a row a user and slot, however many events
    a user has.
    """
    gap = gap_minutes * 60_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    events = log.filter(F.col(ts).isNotNull()).select(user, F.col(ts).alias("_ts"), at.alias("_at"))
    slots = events.groupBy(user, (F.col("_at") - F.pmod("_at", F.lit(gap))).alias("_slot")).agg(F.min("_ts").alias("_start"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count("*").alias("_n"))
    w = Window.partitionBy(user).orderBy("_first")
    new = F.when(F.col("_first") - F.lag("_last").over(w) < gap, 0).otherwise(1)
    rows = slots.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return rows.groupBy(user, "session").agg(F.min("_start").alias("start"), F.sum("_n").alias("n"))
