"""Graph traversal and matching over edge tables (from_node, to_node, type) and node tables (node_id, type, label).

Traversals move a frontier by joins: one join and one anti-join a hop, never a driver-side adjacency list. The edges are
written once and each hop's result too, to the shared folder, so plans stay short and lost executors cost one hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import checkpointed, forget

from . import traversal


def neighbors(edges: DataFrame, start: str, depth: int, edge_types: list[str] | None = None, exclude_edge_types: list[str] | None = None, stored: bool = False) -> DataFrame:
    """(node, depth): nodes reached over out-edges in at most depth (1 to 10) hops, with the least number of hops.

    Edges that are computed are written once, as each hop reads them; stored ones (a table's) are read where they are.
    """
    own = edges
    if edge_types:
        own = own.where(F.col("type").isin(*edge_types))
    if exclude_edge_types:
        own = own.where(~F.col("type").isin(*exclude_edge_types))
    own = own.select("from_node", "to_node") if stored else checkpointed(own.select("from_node", "to_node"))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    frontier = seen
    for hop in range(1, min(10, max(1, depth)) + 1):
        reached = own.join(frontier.select(F.col("node").alias("from_node")), "from_node").select(F.col("to_node").alias("node")).distinct()
        frontier = checkpointed(reached.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    if not stored:
        forget(own)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 8, stored: bool = False) -> list[str]:
    """Nodes of a shortest path over undirected edges; empty if there is none. Of equals, the one with least names."""
    return traversal.path(edges, source, target, max_depth, stored=stored)


def field_score(text: Column, tokens: list[str], query: str, exact: float, every: float, some: float) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    has = [F.contains(low, F.lit(t)) for t in tokens]
    all_of, any_of = has[0], has[0]
    for h in has[1:]:
        all_of, any_of = all_of & h, any_of | h
    return F.when(low == "", 0.0).when(low == query, exact).when(F.contains(low, F.lit(query)), (exact + every) / 2).when(all_of, every).when(any_of, some).otherwise(0.0)


def match_nodes(nodes: DataFrame, tokens: list[str], query: str, k: int) -> DataFrame:
    """(node_id, score): the best of a label match and a type match; rows that can't match are dropped first."""
    low_type = F.lower("type")
    by_type = F.when(low_type.rlike("|".join(tokens)), 0.5).otherwise(0.0)
    score = F.greatest(field_score(F.col("label"), tokens, query, 1.0, 0.9, 0.6), by_type)
    candidates = nodes.where(F.lower(F.concat_ws(" ", "label", "type")).rlike("|".join(tokens)))
    return candidates.select("node_id", "label", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "label", "node_id").limit(k).drop("label")


def match_relationships(nodes: DataFrame, edges: DataFrame, tokens: list[str], query: str) -> DataFrame:
    """(from_node, to_node, type, title, score) of edges that match by type, or by a label of an end."""
    label = nodes.select("node_id", "label")
    named = edges.join(label.toDF("from_node", "from_label"), "from_node", "left").join(label.toDF("to_node", "to_label"), "to_node", "left")
    ends = [F.coalesce(f"{end}_label", f"{end}_node") for end in ("from", "to")]
    kind = F.coalesce("type", F.lit("related"))
    score = F.greatest(field_score(kind, tokens, query, 0.65, 0.55, 0.45), *[field_score(e, tokens, query, 0.5, 0.4, 0.3) for e in ends])
    title = F.concat(ends[0], F.lit(" —"), kind, F.lit("→ "), ends[1])
    return named.select("from_node", "to_node", kind.alias("type"), title.alias("title"), F.round(score, 3).alias("score")).where("score > 0")


def search(nodes: DataFrame, edges: DataFrame, tokens: list[str], query: str, k: int) -> DataFrame:
    """(rank, kind, key, title, score): the best nodes, by score and title; relationships fill what is left of k."""
    found = match_nodes(nodes, tokens, query, k).join(nodes.select("node_id", "label"), "node_id").dropDuplicates(["node_id"])
    rows = found.select(F.lit(0).alias("part"), F.lit("node").alias("kind"), F.col("node_id").alias("key"), F.col("label").alias("title"), "score")
    links = match_relationships(nodes, edges, tokens, query).distinct().orderBy(F.desc("score"), "title", "from_node", "to_node", "type").limit(k)
    more = links.select(F.lit(1).alias("part"), F.lit("relationship").alias("kind"), F.concat_ws(" ", "from_node", "type", "to_node").alias("key"), "title", "score")
    order = ["part", F.desc("score"), "title", "key"]
    return rows.unionByName(more).orderBy(*order).limit(k).select(F.row_number().over(W.orderBy(*order)).alias("rank"), "kind", "key", "title", "score")


#: Ranks of edges as facts (others have OTHER), what an outside object adds and an indexed one takes off.
EDGE_RANKS = {"imports": 0, "calls": 0, "references": 1, "similar_to": 2, "links_to": 2, "mentions": 9}
OTHER, OUTSIDE, INSIDE = 5, 3, 1


def fact_rank(edge_type: Column, object_type: Column, inside: tuple[str, ...] = ("document", "file", "markdown_note")) -> Column:
    rank = F.coalesce(*[F.when(edge_type == t, r) for t, r in EDGE_RANKS.items()], F.lit(OTHER))
    return rank + F.when(object_type == "external_reference", OUTSIDE).when(object_type.isin(*inside), -INSIDE).otherwise(0)


def facts(nodes: DataFrame, edges: DataFrame, cited: list[str], limit: int = 12, per_subject: int = 3, weak: int = 3) -> DataFrame:
    """(subject, edge_type, object, rank): facts about cited nodes, one of each node in turn, the strongest first.

    The choice among candidates is greedy, so it is made on one row; of each node as many candidates as limit count.
    """
    spark = edges.sparkSession
    order = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(cited))], "from_node string, turn int")
    own = edges.join(F.broadcast(order), "from_node").where(F.col("type") != "contains").select("from_node", "turn", "type", "to_node").distinct()
    ranked = own.join(nodes.select(F.col("node_id").alias("to_node"), F.col("type").alias("object_type")), "to_node").withColumn("rank", fact_rank(F.col("type"), F.col("object_type")))
    depth = F.row_number().over(W.partitionBy("from_node").orderBy("rank", "type", "to_node"))
    rows = ranked.withColumn("depth", depth).where(F.col("depth") <= limit * (per_subject + 1)).orderBy("depth", "turn").select("from_node", "type", "to_node", "rank").collect()
    chosen, used, count, spent = [], set(), {}, 0
    for r in rows:
        if len(chosen) == limit:
            break
        if r["to_node"] in used or count.get(r["from_node"], 0) >= per_subject or (r["rank"] >= 9 and spent >= weak):
            continue
        spent += r["rank"] >= 9
        used.add(r["to_node"])
        count[r["from_node"]] = count.get(r["from_node"], 0) + 1
        chosen.append(tuple(r))
    return spark.createDataFrame(chosen, "subject string, edge_type string, object string, rank int")


def fill_budget(items: DataFrame, group: str, order: str, size: str, key: str, budget: int) -> DataFrame:
    """(group, key, place) of the items that fit, each taken in order if what is left of the budget holds it."""
    listed = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).cast("string").alias("k"), F.col(size).cast("long").alias("s")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<string>").alias("taken"))
    taken = F.aggregate(
        "items", start,
        lambda acc, x: F.when(acc["spent"] + x["s"] <= budget, F.struct((acc["spent"] + x["s"]).alias("spent"), F.array_append(acc["taken"], x["k"]).alias("taken"))).otherwise(acc),
        lambda acc: acc["taken"],
    )
    return listed.select(group, F.posexplode(taken).alias("place", key))


def _shared(x: DataFrame, y: DataFrame, on: str) -> DataFrame:
    pairs = x.alias("x").join(y.alias("y"), F.expr(f"{on} AND x.node < y.node"))
    return pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("shared"))


def shared_terms(sized: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) for pairs of (node, n, term) that share two terms or more.

    Nodes meet by pairs of terms, so a term that very many nodes have joins none that share nothing else; who shares s
    terms meets s (s - 1) / 2 times.
    """
    two = sized.alias("x").join(sized.alias("y"), F.expr("x.node = y.node AND x.term < y.term")).select("x.node", "x.n", F.col("x.term").alias("first"), F.col("y.term").alias("second"))
    met = _shared(two, two, "x.first = y.first AND x.second = y.second")
    return met.withColumn("shared", F.round((1 + F.sqrt(1 + 8 * F.col("shared"))) / 2).cast("long"))


def similarity_edges(terms: DataFrame, least_shared: int = 2, least_jaccard: float = 0.25) -> DataFrame:
    """(a, b, shared, confidence) for pairs of (node, term) tables that share enough terms; nodes need two terms.

    One shared term is enough only for nodes of few terms: no others meet by single terms.
    """
    own = terms.distinct()
    sizes = own.groupBy("node").agg(F.count("*").alias("n")).where("n >= 2")
    kept = own.join(sizes, "node")
    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    if least_shared < 2:
        counted = _shared(kept, kept, "x.term = y.term")
    else:
        few = kept.where(F.lit(1) / (F.col("n") + 1) >= least_jaccard)
        by_one = _shared(few, few, f"x.term = y.term AND 1 / (x.n + y.n - 1) >= {least_jaccard!r}D").where("shared = 1")
        counted = shared_terms(kept).unionByName(by_one)
    return counted.where((F.col("shared") >= least_shared) | (jaccard >= least_jaccard)).select("a", "b", "shared", F.round(jaccard, 3).alias("confidence"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable by links (a, b). Rounds grow with the logarithm of diameters.

    A round takes the least label of a node's neighbours and then that label's own label; its table replaces the last.
    """
    edges = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = checkpointed(lower.join(jump, lower["new"] == jump["via"], "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        forget(labels)
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            forget(edges)
            return labels
