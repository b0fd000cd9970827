"""Agent memory: validity, salience, consolidation, capacity, and near-duplicate compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import setjoin
from .graph import components

#: Fixed values of the salience formula.
HALF_LIFE_DAYS, USE_WEIGHT, OBSERVATION_WEIGHT = 90.0, 0.5, 0.5
SCOPE_WEIGHTS = {"org": 1.25, "user": 1.0, "session": 0.6}
STEERING_KINDS = ("alias", "preference", "exclusion")
SIMILAR = 0.6


def instant(text: Column) -> Column:
    return F.try_to_timestamp(F.when(text == "", None).otherwise(text))


def seconds(text: Column) -> Column:
    return F.unix_timestamp(instant(text))


def effective_end(records: DataFrame) -> DataFrame:
    """records with ends: the earlier of valid_until and the first assertion that supersedes the record."""
    by = records.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("record_id")).agg(F.min("asserted_at").alias("superseded_at"))
    until = F.when(F.col("valid_until") == "", None).otherwise(F.col("valid_until"))
    return records.join(by, "record_id", "left").withColumn("ends", F.least(until, "superseded_at"))


def salience(now: str, columns: tuple[str, ...] = ("asserted_at", "last_seen", "last_used_at")) -> Column:
    """Recency (by the latest instant of the record) times evidence times the scope's weight.

    columns are the instants that the records have: asserted, seen again, used.
    """
    latest = F.greatest(*[F.when(F.col(c) == "", None).otherwise(F.col(c)) for c in ("asserted_at", "last_seen", "last_used_at") if c in columns])
    age = F.greatest(F.lit(0.0), F.coalesce((seconds(F.lit(now)) - seconds(latest)) / 86400.0, F.lit(0.0)))
    evidence = 1 + USE_WEIGHT * F.log1p(F.greatest(F.lit(0), F.coalesce("uses", F.lit(0)))) + OBSERVATION_WEIGHT * F.log1p(F.greatest(F.lit(0), F.coalesce("observations", F.lit(0))))
    weight = F.coalesce(*[F.when(F.col("scope") == s, w) for s, w in SCOPE_WEIGHTS.items()], F.lit(1.0))
    return F.round(F.pow(F.lit(0.5), age / HALF_LIFE_DAYS) * evidence * weight, 6)


def consolidate(records: DataFrame, now: str, ttl_days: dict[str, int], retention_days: int = 0) -> DataFrame:
    """(record_id, reason) to archive: superseded, else past its scope's TTL, once whole retention days have passed."""
    by = records.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("record_id")).agg(F.min("asserted_at").alias("superseded_at"))
    ttl = F.coalesce(*[F.when(F.col("scope") == s, d) for s, d in ttl_days.items()], F.lit(None).cast("int")) if ttl_days else F.lit(None).cast("int")
    deadline = seconds(F.col("asserted_at")) + ttl * 86400
    at = seconds(F.lit(now))
    rows = records.join(by, "record_id", "left")
    end = F.when(F.col("superseded_at").isNotNull(), seconds(F.col("superseded_at"))).when(at >= deadline, deadline)
    reason = F.when(F.col("superseded_at").isNotNull(), "superseded").otherwise("expired")
    return rows.where(end.isNotNull() & (F.floor((at - end) / 86400) >= retention_days)).select("record_id", reason.alias("reason"))


def prune(records: DataFrame, now: str, per_scope: int, per_subject: int, total: int) -> DataFrame:
    """record_id of records over a cap: scope and subject caps first, then the global one. Steering kinds are exempt."""
    scored = records.where(~F.col("kind").isin(*STEERING_KINDS)).withColumn("s", salience(now))
    best = [F.desc("s"), "record_id"]
    ranked = scored.withColumn("r1", F.row_number().over(W.partitionBy("scope").orderBy(*best))).withColumn("r2", F.when(F.col("subject") != "", F.row_number().over(W.partitionBy("subject").orderBy(*best))))
    over = (F.col("r1") > per_scope) | F.coalesce(F.col("r2") > per_subject, F.lit(False))
    stay = ranked.where(~over).orderBy(*best).limit(total).select("record_id")
    return scored.select("record_id").join(stay, "record_id", "left_anti")


def token_rows(records: DataFrame) -> DataFrame:
    """(record_id, bucket, token): tokens of two letters or more; only records of one bucket are compared."""
    bucket = F.concat_ws("|", "scope", F.coalesce("subject", F.lit("")), "kind", F.when(F.col("scope") == "org", "").otherwise(F.col("written_by")))
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " ")
    return records.select("record_id", bucket.alias("bucket"), F.explode(F.array_distinct(words)).alias("token")).where("length(token) > 1")


def similar_pairs(records: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b, jaccard) within buckets, by a join of sets with prefix filters."""
    sets = token_rows(records).groupBy("bucket", F.col("record_id").alias("id")).agg(F.collect_set("token").alias("tokens"))
    found = setjoin.similar(sets, least - 1e-6)  # similarities count as rounded
    return found.select("a", "b", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard")).where(F.col("jaccard") >= least)


def clusters(records: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(record_id, canonical, absorbed): members of near-duplicate clusters; the medoid stands for its cluster."""
    pairs = similar_pairs(records, least)
    labels = components(pairs)
    both = pairs.select("a", "jaccard").union(pairs.select("b", "jaccard"))
    closeness = both.groupBy(F.col("a").alias("node")).agg(F.round(F.sum("jaccard"), 6).alias("sim"))
    members = labels.join(closeness, "node").join(records.select(F.col("record_id").alias("node"), "observations"), "node")
    best = W.partitionBy("label").orderBy(F.desc("sim"), "node")
    of_cluster = W.partitionBy("label")
    return members.select(F.col("node").alias("record_id"), F.first("node").over(best).alias("canonical"), (F.sum("observations").over(of_cluster) + F.count("*").over(of_cluster)).alias("absorbed"))
