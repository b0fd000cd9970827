"""Graphs as node-link JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, target, key, data): nodes and links as JSON with sorted keys, numbered where two nodes have several links.

    Sorted by its first four columns, the data are the same text for the same graph, in whatever order it was made.
    """
    node = F.to_json(F.struct(F.col("node_id").alias("id"), "label", "type"))
    first = nodes.select(F.lit("nodes").alias("part"), F.col("node_id").alias("id"), F.lit("").alias("target"), F.lit(0).alias("key"), node.alias("data"))
    of = W.partitionBy("from_node", "to_node").orderBy("type")
    keyed = edges.withColumn("key", F.row_number().over(of) - 1)
    link = F.to_json(F.struct("key", F.col("from_node").alias("source"), F.col("to_node").alias("target"), "type"))
    return first.unionByName(keyed.select(F.lit("links").alias("part"), F.col("from_node").alias("id"), F.col("to_node").alias("target"), "key", link.alias("data")))


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON files; links may stand under `links` or, in older files, under `edges`."""
    link = "array<struct<source: string, target: string, type: string>>"
    read = spark.read.schema(f"nodes array<struct<id: string, label: string, type: string>>, links {link}, edges {link}").json(path, multiLine=True)
    nodes = read.select(F.explode("nodes").alias("n")).select(F.col("n.id").alias("node_id"), "n.type", "n.label")
    edges = read.select(F.explode(F.coalesce("links", "edges")).alias("e")).select(F.col("e.source").alias("from_node"), F.col("e.target").alias("to_node"), "e.type")
    return nodes, edges
