"""Reciprocal rank fusion of ranked arms, and the filters that follow it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added to each rank (fixed value).
DAMPING = 60


def reciprocal_rank(arms: list[tuple[str, DataFrame]], k: int = 10) -> DataFrame:
    """(rank, key, node, score, best_rank, retrieved_by) of arms with columns (key, node, rank).

    Arms come in the order of their priority: a key's record is that of its first arm. A node appears once, by its best
    key; ties go to the better single rank, then to the smaller key.
    """
    rows = reduce(DataFrame.unionByName, [df.select("key", "node", "rank", F.lit(name).alias("arm"), F.lit(i).alias("priority")) for i, (name, df) in enumerate(arms)])
    fused = rows.groupBy("key").agg(
        F.round(F.sum(1.0 / (DAMPING + F.col("rank"))), 6).alias("score"),
        F.min("rank").alias("best_rank"),
        F.concat_ws("+", F.sort_array(F.collect_set("arm"))).alias("retrieved_by"),
        F.min_by("node", F.struct("priority", "rank")).alias("node"),
    )
    order = [F.desc("score"), "best_rank", "key"]
    once = fused.withColumn("n", F.row_number().over(W.partitionBy("node").orderBy(*order))).where("n = 1").drop("n")
    top = once.orderBy(*order).limit(k)
    return top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "key", "node", "score", "best_rank", "retrieved_by")


def promoted(hits: DataFrame, is_memory: Column, k: int, share: float = 0.5) -> DataFrame:
    """Ranks with the first max(1, k * share) memory hits moved to the front."""
    ranked = hits.withColumn("m", is_memory).withColumn("mr", F.when(F.col("m"), F.row_number().over(W.partitionBy("m").orderBy("rank"))))
    front = F.coalesce(F.col("mr") <= max(1, int(k * share)), F.lit(False))
    return ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc(front), "rank"))).drop("m", "mr")


def criteria(exclude_sources=(), node_types=(), min_score=None, source_types=(), exclude_source_types=()) -> Column:
    """Filters over ranked hits: an unknown source type fails a list of wanted types and passes one of unwanted types."""
    keep = F.lit(True)
    if exclude_sources:
        keep &= ~F.coalesce(F.col("source_id"), F.lit("")).isin(*exclude_sources)
    if node_types:
        keep &= F.coalesce(F.col("type"), F.lit("")).isin(*node_types)
    if source_types:
        keep &= F.coalesce(F.col("source_type").isin(*source_types), F.lit(False))
    if exclude_source_types:
        keep &= ~F.coalesce(F.col("source_type").isin(*exclude_source_types), F.lit(False))
    if min_score is not None:
        keep &= F.coalesce(F.col("score"), F.lit(0.0)) >= min_score
    return keep
