"""Neighbourhoods and paths in a graph of edges (from_node, to_node, type), by frontiers that move a hop at a time.

Each row of a frontier carries its path, so an answer needs no walk back. What a hop reaches is joined with the edges, the
first sighting of each node is kept, and the result is written, so plans stay short and a lost executor costs a hop. A
frontier of few nodes filters the edges by their names, which prunes the row groups of a table that is sorted by them; a
larger one is broadcast if its counted size allows, and shuffled otherwise. Edges that are computed are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import checkpointed, forget, small

#: Edges that are followed first at each node, and the most hops of a neighbourhood.
HIERARCHY, MOST_HOPS = ("contains",), 10
#: Nodes of a frontier whose names filter the edges.
NAMED = 200


def _out_of(edges: DataFrame, frontier: DataFrame, end: str, count: int) -> DataFrame:
    """Edges with an end in the frontier, with its columns."""
    if count <= NAMED:
        names = [r["node"] for r in frontier.select("node").collect()]
        return edges.where(F.col(end).isin(*names)).join(F.broadcast(frontier), F.col(end) == F.col("node"))
    return edges.join(small(frontier), F.col(end) == F.col("node"))


def neighbourhood(
    edges: DataFrame, start: str, depth: int = 1, edge_types: list[str] | None = None, exclude_edge_types: list[str] | None = None,
    nodes: DataFrame | None = None, exclude_node_types: list[str] | None = None, max_nodes: int | None = None, stored: bool = False,
) -> DataFrame:
    """(node, depth, path, edge_types): nodes over out-edges, each where breadth-first search sees it first; start is none of them.

    A node's edges are followed in the order of hierarchy first, then of names. Nodes of excluded types (by nodes: node_id,
    type) are neither returned nor walked through. With max_nodes the search ends at the first so many.
    """
    own = edges.where(F.col("type").isin(*edge_types)) if edge_types else edges
    own = own.where(~F.coalesce(F.col("type"), F.lit("")).isin(*exclude_edge_types)) if exclude_edge_types else own
    own = own.select("from_node", "to_node", "type")
    own = own if stored else checkpointed(own)
    step = "array<struct<h:int,n:string>>"
    frontier = edges.sparkSession.createDataFrame([(start, [])], f"node string, steps {step}")
    seen, found, have, count = frontier.select("node"), [], 0, 1
    for hop in range(1, max(1, min(int(depth or 1), MOST_HOPS)) + 1):
        if not count or (max_nodes is not None and have >= max_nodes):
            break
        kind = F.when(F.col("type").isin(*HIERARCHY), 0).otherwise(1)
        pairs = _out_of(own, frontier, "from_node", count).groupBy("from_node", "to_node").agg(F.min(kind).alias("h"), F.first("steps").alias("steps"), F.sort_array(F.collect_set("type")).alias("edge_types"))
        mine = F.concat("steps", F.array(F.struct("h", F.col("to_node").alias("n"))))
        reached = pairs.select(F.col("to_node").alias("node"), mine.alias("steps"), "edge_types").groupBy("node").agg(F.min_by("edge_types", "steps").alias("edge_types"), F.min("steps").alias("steps"))
        fresh = reached.join(seen, "node", "left_anti")
        if nodes is not None and exclude_node_types:
            hidden = nodes.where(F.col("type").isin(*exclude_node_types)).select(F.col("node_id").alias("node"))
            fresh = fresh.join(hidden, "node", "left_anti")
        if max_nodes is not None:
            fresh = fresh.orderBy("steps").limit(max_nodes - have)
        frontier = checkpointed(fresh.select("node", "steps", "edge_types", F.lit(hop).alias("depth")))
        count = frontier.count()
        have += count
        found.append(frontier)
        seen = seen.unionByName(frontier.select("node"))
        frontier = frontier.select("node", "steps")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    out = checkpointed(every.select("node", "depth", F.concat(F.array(F.lit(start)), F.transform("steps", lambda s: s["n"])).alias("path"), "edge_types", "steps"))
    forget(every)
    if not stored:
        forget(own)
    return out.drop("steps") if max_nodes is None else _placed(out)


def _placed(found: DataFrame) -> DataFrame:
    """With places from 1 in the order of the search; there are no more rows than the search was asked for."""
    return found.select(F.row_number().over(W.orderBy("depth", "steps")).alias("place"), "node", "depth", "path", "edge_types")


def part_of(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, limit: int = 100, edge_types: list[str] | None = None, stored: bool = False, **wanted) -> tuple[DataFrame, DataFrame, bool]:
    """((node_id, depth, ...) of start and at most limit neighbours, the edges among them, whether there are more)."""
    near = neighbourhood(edges, start, depth, edge_types, nodes=nodes, max_nodes=limit + 1, stored=stored, **wanted)
    kept = near.where(F.col("place") <= limit).select("node", "depth").unionByName(near.sparkSession.createDataFrame([(start, 0)], "node string, depth int"))
    kept = F.broadcast(kept)  # limit + 1 rows
    own = edges.where(F.col("type").isin(*edge_types)) if edge_types else edges
    ends = kept.select("node")
    links = own.join(ends.withColumnRenamed("node", "from_node"), "from_node", "left_semi").join(ends.withColumnRenamed("node", "to_node"), "to_node", "left_semi")
    return nodes.join(kept, F.col("node_id") == F.col("node")).drop("node"), links.select("from_node", "to_node", "type"), near.count() > limit


def path(edges: DataFrame, source: str, target: str, max_depth: int = 8, max_visited: int | None = None, stored: bool = False) -> list[str]:
    """Nodes of a shortest path over edges in either direction, of equal ones the first by names; empty if there is none.

    Two searches come towards each other, and the one with the smaller frontier moves; where a hop of one meets the last
    hop of the other, each shortest path passes through one of these nodes. max_visited ends a search without an answer.
    """
    if source == target:
        return [source]
    own = edges.select("from_node", "to_node")
    own = own if stored else checkpointed(own.where("from_node <> to_node"))
    make = lambda node: edges.sparkSession.createDataFrame([(node, [node])], "node string, path array<string>")
    front = {"out": make(source), "back": make(target)}
    seen = {side: rows.select("node") for side, rows in front.items()}
    size, written, visited, answer = {"out": 1, "back": 1}, [], 2, []
    for _ in range(max_depth):
        if not size["out"] or not size["back"] or (max_visited is not None and visited > max_visited):
            break
        side, other = ("out", "back") if size["out"] <= size["back"] else ("back", "out")
        both = [_out_of(own, front[side], a, size[side]).select(F.col(b).alias("next"), "path") for a, b in (("from_node", "to_node"), ("to_node", "from_node"))]
        longer: Column = F.concat("path", F.array("next")) if side == "out" else F.concat(F.array("next"), "path")
        reached = both[0].unionByName(both[1]).select(F.col("next").alias("node"), longer.alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        front[side] = checkpointed(reached.join(small(seen[side]), "node", "left_anti"))
        written.append(front[side])
        size[side] = front[side].count()
        visited += size[side]
        seen[side] = seen[side].unionByName(front[side].select("node"))
        there = front[other].select("node", F.col("path").alias("rest"))
        met = front[side].join(small(there), "node")
        head, tail = ("path", "rest") if side == "out" else ("rest", "path")
        best = met.agg(F.min(F.concat(head, F.slice(tail, F.lit(2), F.lit(max_depth + 1)))).alias("p")).first()["p"]
        if best is not None:
            answer = list(best)
            break
    for rows in written:
        forget(rows)
    if not stored:
        forget(own)
    return answer
