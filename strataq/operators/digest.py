"""Digests of graphs that depend on neither order nor partitions, can be kept up to date, and show where two graphs differ.

An edge is known by two 64-bit hashes. A digest of some edges is their number and the sums of their hashes, so digests of
parts add up and changes are added or taken off. Edges belong to leaves by the first hexadecimal digits of the hash of
their from_node; a tree holds the digest of each leaf and of each shorter beginning, up to that of the whole. Two trees
are compared from the root: only what is below a digest that differs is looked at, so one changed edge costs a row of
digests a level, and then the edges of one leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.session import small

#: Hexadecimal digits of a leaf: 16 ** DEPTH leaves, however many edges there are.
DEPTH = 4
TREE = "prefix string, n long, h1 decimal(38,0), h2 decimal(38,0)"


def leaf(node: Column) -> Column:
    """The leaf that a node's out-edges belong to."""
    return F.lower(F.lpad(F.hex(F.xxhash64(node)), 16, "0")).substr(1, DEPTH)


def _hashed(edges: DataFrame) -> DataFrame:
    """(prefix, n, h1, h2) of single edges, by all of their columns in the order of their names."""
    row = F.to_json(F.struct(*sorted(edges.columns)), {"ignoreNullFields": "false"})
    number = lambda h: h.cast("decimal(38,0)")
    return edges.select(leaf(F.col("from_node")).alias("prefix"), F.lit(1).cast("long").alias("n"), number(F.xxhash64(row)).alias("h1"), number(F.xxhash64(F.lit("2"), row)).alias("h2"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("prefix").agg(*[F.sum(c).alias(c) for c in ("n", "h1", "h2")]).where("n <> 0 OR h1 <> 0 OR h2 <> 0")


def _grown(leaves: DataFrame) -> DataFrame:
    """A tree from the digests of its leaves."""
    every = leaves.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.lit(DEPTH)), lambda k: F.substring("prefix", F.lit(1), k))))
    return _summed(every)


def tree(edges: DataFrame) -> DataFrame:
    """(prefix, n, h1, h2) of a graph; the digest of the whole has the empty prefix."""
    return _grown(_summed(_hashed(edges)))


def updated(before: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The tree after edges have come and gone, from these edges only."""
    less = _hashed(removed).select("prefix", *[(-F.col(c)).alias(c) for c in ("n", "h1", "h2")])
    leaves = before.where(F.length("prefix") == DEPTH)
    return _grown(_summed(leaves.unionByName(_hashed(added)).unionByName(less)))


def root(of: DataFrame) -> str:
    """One digest of a whole graph, in hexadecimal."""
    found = of.where("prefix = ''").select(F.sha2(F.concat_ws(":", "n", "h1", "h2"), 256).alias("d")).first()
    return found["d"] if found else ""


def changed(x: DataFrame, y: DataFrame) -> tuple[list[str], int]:
    """(leaves whose digests differ, how many digests were read) of two trees."""
    at, read = [""], 0
    for depth in range(DEPTH + 1):
        if depth:
            at = [p + d for p in at for d in "0123456789abcdef"]
        own = [t.where(F.col("prefix").isin(*at)) for t in (x, y)]
        # A digest that both have is in this union twice.
        pairs = own[0].withColumn("side", F.lit(0)).unionByName(own[1].withColumn("side", F.lit(1)))
        seen = pairs.groupBy("prefix", "n", "h1", "h2").agg(F.count("*").alias("k")).collect()
        read += sum(r["k"] for r in seen)
        at = sorted({r["prefix"] for r in seen if r["k"] == 1})
        if not at:
            break
    return at, read


def difference(x: DataFrame, y: DataFrame, leaves: list[str]) -> DataFrame:
    """The columns of the edges and op: edges of these leaves that only x has (removed) or only y has (added), as often as they are one's own."""
    spark = x.sparkSession
    wanted = small(spark.createDataFrame([(p,) for p in leaves], "leaf string"))
    own = [e.withColumn("leaf", leaf(F.col("from_node"))).join(wanted, "leaf", "left_semi").drop("leaf") for e in (x, y)]
    gone, come = own[0].exceptAll(own[1]), own[1].exceptAll(own[0])
    return gone.withColumn("op", F.lit("removed")).unionByName(come.withColumn("op", F.lit("added")))
