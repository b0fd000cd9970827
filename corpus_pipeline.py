"""A corpus pipeline of five stages over documents: each works on what its predecessor kept.

Toxic documents go; of near duplicates the one with the least id stays; byte spans that repeat are cut out of texts;
documents that hold benchmark passages go; the rest is encoded and decoded. Every function takes (spark, docs, sf_dir);
all stages but the last return the columns of docs, whatever their names.

Null and empty texts are in no group, hold no passages and have no bytes to remove, so they stay; so do rows without an id,
in every stage. Of rows that share an id, equal or similar ones are reduced to one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm import bpe_codec, decontamination, ngram_join, suffix_dedup, toxicity
from strataq.llm.queries import table, vocabulary
from strataq.session import shared_dir


def _packed(docs: DataFrame) -> DataFrame:
    """All columns as one more, so that their names can't clash with an operator's."""
    return docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classifier = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(_packed(docs), classifier, keep=["__row"])
    return scored.where("predicted = 0").select("__row.*")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an id are in no group and stay. Rows that share an id are compared like any others."""
    own = docs.where("doc_id IS NOT NULL")
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        found = ngram_join.jaccard_components(own)
        kept = own.join(found.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    else:
        # Rows are known by id and place among those of the id, in the order of their texts.
        place = F.row_number().over(W.partitionBy("doc_id").orderBy("text", F.xxhash64("__row")))
        keyed = _packed(own).select("doc_id", "text", "__row").withColumn("__place", place).withColumn("__key", F.xxhash64("doc_id", "__place"))
        found = ngram_join.jaccard_components(keyed.select("__key", "text"), "__key")
        least = keyed.select("__key", "doc_id", "__place").join(found, "__key").groupBy("component_id").agg(F.min(F.struct("doc_id", "__place", "__key")).alias("first"))
        kept = keyed.join(least.select(F.col("first.__key").alias("__key")), "__key", "left_semi").select("__row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_packed(docs), keep=["__row"])
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("__row.n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_packed(docs), table(spark, sf_dir, "benchmark"), keep=["__row"])
    return found.where("n_hit = 0").select("__row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_join", ngram_join_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe_codec", bpe_stage),
]

#: SQL can't express a trained classifier or the tokenizer; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    import uuid

    where = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
