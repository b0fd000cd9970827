"""Incremental maintenance: change classes by content hash, replacement by key, and a task queue as a fold of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, changed, unchanged or deleted, by one full outer join on the key."""
    b, n = before.select(key, F.col(digest).alias("__b")), now.select(key, F.col(digest).alias("__n"))
    joined = b.withColumn("__in_b", F.lit(True)).join(n.withColumn("__in_n", F.lit(True)), key, "full_outer")
    change = F.when(F.col("__in_b").isNull(), "added").when(F.col("__in_n").isNull(), "deleted").when(F.col("__b").eqNullSafe(F.col("__n")), "unchanged").otherwise("changed")
    return joined.select(key, change.alias("change"))


def replace(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with all rows of new's keys replaced by new's rows."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


#: Claims before a task is dead, and seconds until a claim lapses.
MAX_ATTEMPTS, VISIBILITY = 3, 300


def queue_state(events: DataFrame, now: str, max_attempts: int = MAX_ATTEMPTS, visibility: int = VISIBILITY) -> DataFrame:
    """(id, status, attempts) of tasks from their events (id, op, at): publish, claim, ack, nack, heartbeat.

    The latest of publish, ack and nack decides, with claims after it; a claim without a heartbeat for the visibility
    timeout is pending again; after max_attempts failed claims the task is dead. Publishing again re-arms done tasks only.
    """
    order = F.struct("at", F.expr("array_position(array('publish', 'claim', 'heartbeat', 'nack', 'ack'), op)"))
    last = events.groupBy("id").agg(
        F.max_by("op", order).alias("op"), F.max("at").alias("at"),
        F.max(F.when(F.col("op") == "ack", F.col("at"))).alias("acked"),
        F.max(F.when(F.col("op") == "publish", F.col("at"))).alias("published"),
    )
    joined = events.join(last.select("id", "acked"), "id")
    claims = joined.where("op = 'claim' AND (acked IS NULL OR at > acked)").groupBy("id").agg(F.count("*").alias("n"))
    rows = last.join(claims, "id", "left").withColumn("attempts", F.coalesce("n", F.lit(0)))
    lapsed = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("at") > visibility
    done = F.col("acked").isNotNull() & (F.col("published") <= F.col("acked")) & (F.col("attempts") == 0)
    running = F.col("op").isin("claim", "heartbeat") & ~lapsed
    status = F.when(done, "done").when(running, "running").when(F.col("attempts") >= max_attempts, "dead").otherwise("pending")
    return rows.select("id", status.alias("status"), "attempts")


def sessions(events: DataFrame, key: str, at: str, gap_seconds: float) -> DataFrame:
    """(key, session, first, last, n): events closer than the gap are one batch."""
    order = W.partitionBy(key).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    new = F.coalesce((seconds - F.lag(seconds).over(order) > gap_seconds).cast("int"), F.lit(0))
    rows = events.withColumn("__new", new).withColumn("session", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
