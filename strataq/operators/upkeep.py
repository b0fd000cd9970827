"""Keeping a base right: what needs repair, what a new configuration asks for, sidecars, and an index of nodes' names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import MemoryPolicy, admits

#: Endings of sidecars, of which the first that is there stands for a file's text.
SIDECARS = (".caption.txt", ".transcript.txt", ".extract.txt")
#: Candidates of a search for nodes; what a preference takes off a prior, and the least that is left.
CANDIDATES, PREFERENCE, LEAST_PRIOR = 2000, 0.35, 0.25


def needs_repair(listed: DataFrame, state: DataFrame, nodes: DataFrame) -> DataFrame:
    """(artifact_id, reason): artifacts that a sync has left half done.

    listed(artifact_id, sha256, expected) is what there should be, expected being the number of chunks;
    state(artifact_id, sha256, status, n_chunks) and nodes(node_id) are what there is. The first reason is told.
    """
    have = state.select("artifact_id", F.col("sha256").alias("__sha"), "status", "n_chunks", F.lit(True).alias("__has"))
    known = nodes.select(F.col("node_id").alias("artifact_id"), F.lit(True).alias("__node")).distinct()
    joined = listed.join(have, "artifact_id", "left").join(known, "artifact_id", "left")
    reason = F.when(F.col("__has").isNull(), "no state").when(~F.col("__sha").eqNullSafe(F.col("sha256")), "other content").when(F.col("__node").isNull(), "no node")
    reason = reason.when(F.coalesce("status", F.lit("")) != "indexed", "not indexed").when(F.coalesce("n_chunks", F.lit(0)) < F.col("expected"), "chunks missing")
    return joined.select("artifact_id", reason.alias("reason")).where("reason IS NOT NULL")


def embedding_change(before: Column, now: Column) -> Column:
    """What a new fingerprint of the embedding configuration asks for: none, disabled, introduced or invalidated.

    Introduced: chunks have no vectors yet. Invalidated: the old vectors can't be compared with new ones, and go first.
    """
    return F.when(before.eqNullSafe(now), "none").when(now == "disabled", "disabled").when(before.isNull() | (before == "disabled"), "introduced").otherwise("invalidated")


def with_sidecars(files: DataFrame) -> DataFrame:
    """(path, text): files (path, text), with the text of their first sidecar where there is one; sidecars aren't files."""
    ending = "(" + "|".join(s.replace(".", "\\.") for s in SIDECARS) + ")$"
    found = F.regexp_extract("path", ending, 1)
    beside = files.where(found != "").select(F.regexp_replace("path", ending, "").alias("path"), F.array_position(F.array(*[F.lit(s) for s in SIDECARS]), found).alias("n"), F.col("text").alias("beside"))
    best = beside.groupBy("path").agg(F.min_by("beside", "n").alias("beside"))
    return files.where(found == "").join(best, "path", "left").select("path", F.coalesce("beside", "text").alias("text"))


def node_terms(nodes: DataFrame) -> DataFrame:
    """(term, node_id): words of nodes' labels and types, each once; an index when it is written sorted by term."""
    words = F.split(F.lower(F.concat_ws(" ", "label", "type")), r"[^\p{L}\p{N}_]+")
    return nodes.select("node_id", F.explode(F.array_distinct(words)).alias("term")).where("term <> ''").select("term", "node_id")


def write_node_index(nodes: DataFrame, where: str, files: int = 32) -> None:
    """Node terms as Parquet in ranges of terms, so that a search reads the row groups of its beginnings."""
    node_terms(nodes).repartitionByRange(files, "term", "node_id").sortWithinPartitions("term", "node_id").write.parquet(where)


def node_candidates(terms: DataFrame, tokens: list[str], most: int = CANDIDATES) -> DataFrame:
    """node_id of at most `most` nodes with a word that begins as one of the tokens does; tokens of one letter are left out."""
    starts = [F.col("term").startswith(t.lower()) for t in tokens if len(t) > 1]
    if not starts:
        return terms.select("node_id").where("false")
    return terms.where(reduce(lambda a, b: a | b, starts)).select("node_id").distinct().orderBy("node_id").limit(most)


def preferred(prior: Column, path: Column, preferences: list[str]) -> Column:
    """A structural prior, less for each preference that the path holds."""
    low = F.lower(F.coalesce(path, F.lit("")))
    matches = reduce(lambda a, b: a + b, [F.contains(low, F.lit(p.lower())).cast("int") for p in preferences], F.lit(0))
    return F.greatest(F.lit(LEAST_PRIOR), prior - PREFERENCE * matches)


def may_filter(records: DataFrame, wanted: MemoryPolicy, now: str) -> bool:
    """Whether a policy hides any record; a search that no policy touches needn't look for more hits than it shows."""
    return not records.where(~admits(wanted, now)).isEmpty()


def chosen_records(arms: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, kind, title, arm): of arms with records (key, kind, title), the first arm's, but a graph's node only if no other has the key."""
    each = None
    for at, (name, rows) in enumerate(arms):
        late = F.when((F.lit(name) == "graph") & (F.col("kind") == "node"), len(arms)).otherwise(0)
        part = rows.select("key", "kind", "title", F.lit(name).alias("arm"), (F.lit(at) + late).alias("n"))
        each = part if each is None else each.unionByName(part)
    best = each.groupBy("key").agg(F.min_by(F.struct("kind", "title", "arm"), F.struct("n", "title", "kind")).alias("r"))
    return best.select("key", "r.*")
