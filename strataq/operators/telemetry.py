"""Figures of a running system: histograms and their exposition, progress of jobs, and shards of sources."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import ship_package

#: Bounds of a histogram's buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
#: Samples that a rate is taken over, and seconds without progress after which a job has stalled.
SAMPLES, STALL_SECONDS = 30, 300
FINAL = ("succeeded", "failed", "cancelled")


def histogram(rows: DataFrame, value: str, labels: list[str], buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(labels, counts, sum, count): values at or below each bound, by one pass with partial sums. Nulls aren't observed."""
    seen = rows.where(F.col(value).isNotNull())
    below = F.array(*[F.sum((F.col(value) <= b).cast("long")) for b in buckets])
    return seen.groupBy(*labels).agg(below.alias("counts"), F.sum(value).alias("sum"), F.count("*").alias("count"))


def _escaped(text: Column) -> Column:
    plain = F.coalesce(text.cast("string"), F.lit(""))
    for what, by in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        plain = F.replace(plain, F.lit(what), F.lit(by))
    return plain


def exposition(found: DataFrame, name: str, labels: list[str], about: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(place, line): a histogram() in the text form that scrapers read, a line a row; labels sort their blocks."""
    of = F.concat_ws(",", *[F.concat(F.lit(f'{label}="'), _escaped(F.col(label)), F.lit('"')) for label in sorted(labels)])

    def bucket(bound: str, count: Column) -> Column:
        return F.concat(F.lit(f"{name}_bucket{{"), F.concat_ws(",", F.when(of != "", of), F.lit(f'le="{bound}"')), F.lit("} "), count.cast("string"))

    braces = F.when(of == "", "").otherwise(F.concat(F.lit("{"), of, F.lit("}")))
    lines = [bucket(f"{b:g}", F.col("counts")[i]) for i, b in enumerate(buckets)] + [bucket("+Inf", F.col("count"))]
    lines += [F.concat(F.lit(f"{name}_sum"), braces, F.lit(" "), F.col("sum").cast("string")), F.concat(F.lit(f"{name}_count"), braces, F.lit(" "), F.col("count").cast("string"))]
    rows = found.select(of.alias("labels"), F.posexplode(F.array(*lines)).alias("n", "line"))
    head = found.sparkSession.createDataFrame([("", -2, f"# HELP {name} {about}"), ("", -1, f"# TYPE {name} histogram")], "labels string, n int, line string")
    return head.unionByName(rows).select(F.struct("labels", "n").alias("place"), "line").orderBy("place").select(F.concat_ws("|", "place.labels", "place.n").alias("place"), "line")


def job_rollup(progress: DataFrame) -> DataFrame:
    """(job, current, total, phase): progress (job, source, current, total, status, phase, at) of a job's sources.

    The total is unknown if one source's is; the phase is that of the source that moved last, of active ones if any.
    """
    active = ~F.coalesce("status", F.lit("")).isin(*FINAL)
    known = F.coalesce("total", F.lit(0)) > 0
    newest = F.struct(active.cast("int"), F.col("at"), F.col("source"))
    return progress.groupBy("job").agg(
        F.sum("current").alias("current"), F.when(F.bool_and(known), F.sum("total")).alias("total"), F.max_by("phase", newest).alias("phase"),
    )


def throughput(samples: DataFrame, key: str, now: float, overdue: bool = False) -> DataFrame:
    """(key, rate, eta, stalled): from samples (key, at, done, total) in seconds; the last 30 of a key make its rate.

    There is no rate without two samples, time between them and progress, no end without a rate and a total. Who has done
    more than the total ends in 0 seconds, or with overdue in as many below 0 as that more has taken at this rate.
    """
    back = W.partitionBy(key).orderBy(F.desc("at"), F.desc("done"))
    kept = samples.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= SAMPLES)
    ends = kept.groupBy(key).agg(
        F.min_by("at", -F.col("__n")).alias("a0"), F.min_by("done", -F.col("__n")).alias("d0"), F.min_by("at", "__n").alias("a1"),
        F.min_by("done", "__n").alias("d1"), F.min_by("total", "__n").alias("total"),
    )
    moved = (F.col("a1") > F.col("a0")) & (F.col("d1") > F.col("d0"))
    rate = F.when(moved, (F.col("d1") - F.col("d0")) / (F.col("a1") - F.col("a0")))
    left = F.col("total") - F.col("d1")
    left = left if overdue else F.greatest(F.lit(0), left)
    return ends.select(key, rate.alias("rate"), F.when(F.col("total") > 0, left / rate).alias("eta"), (F.lit(now) - F.col("a1") > STALL_SECONDS).alias("stalled"))


def shards(sizes: DataFrame, count: int | None = None, most: int | None = 1_500_000) -> DataFrame:
    """(source, files, nodes, shard, over): sources (source, files, nodes), the largest first, each into the least full shard.

    Without a count, as few shards as hold all nodes. over: the shard holds more than it should, which whole sources can't
    mend; without a most, which takes a count, none is over. A row a source is all that is read here: the totals of
    sources, which are few, in one task.
    """
    if count is None and most is None:
        raise ValueError("shards need a count, or the most that one holds")
    ship_package(sizes.sparkSession)
    wanted = sizes.where("files > 0").select("source", F.col("files").cast("long").alias("files"), F.col("nodes").cast("long").alias("nodes"))
    known = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes")).first()
    bins = max(1, min(count or max(1, -(-known["nodes"] // max(1, most or 1))), known["n"]))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap = [(0, i + 1) for i in range(bins)]
        for batch in batches:
            of = []
            for nodes in batch["nodes"]:
                held, shard = heapq.heappop(heap)
                of.append(shard)
                heapq.heappush(heap, (held + int(nodes), shard))
            yield batch.assign(shard=of)

    placed = wanted.repartition(1).sortWithinPartitions(F.desc("files"), "source").mapInPandas(place, "source string, files long, nodes long, shard int")
    return placed.withColumn("over", F.lit(False) if most is None else F.sum("nodes").over(W.partitionBy("shard")) > most)
