"""From hits to evidence: merged arms, files, neighbours in the graph, documents within a budget, and a plain answer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.session import ship_package, small

#: Share of a passage's score that a neighbour has, and neighbours of a passage.
NEIGHBOUR_SHARE, PER_NODE = 0.4, 4
#: Fixed values of documents: characters of a text, of code and of all; bytes beyond which a text is cut to its matches.
TEXT_CHARS, CODE_CHARS, ALL_CHARS, LARGE_BYTES = 6_000, 24_000, 60_000, 40_000
#: Fixed value: what stands for chunks that are left out.
OMITTED = "--- … {} chunk(s) omitted … ---"
#: Endings of files that are read whole.
CODE = (
    "py pyi js jsx ts tsx java go rs rb cs cpp cc c h hpp swift kt scala php sh bash ps1 sql r m lua pl "
    "yaml yml toml json ini cfg env tf dockerfile gradle proto graphql"
).split()


def merged(hits: DataFrame) -> DataFrame:
    """(rank, key, score, modes): hits (key, mode, score) of several questions and arms; the best score of a key counts."""
    each = hits.groupBy("key").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("mode")), "+").alias("modes"))
    return each.select(F.row_number().over(W.orderBy(F.desc("score"), "key")).alias("rank"), "key", "score", "modes")


def relevant_files(hits: DataFrame, k: int = 8) -> DataFrame:
    """(rank, path, key, score): files of ranked hits (rank, key, path, score), each where it comes first."""
    best = W.partitionBy("path").orderBy("rank", "key")
    first = hits.where("path <> ''").withColumn("n", F.row_number().over(best)).where("n = 1").orderBy("rank", "key").limit(k)
    return first.select(F.row_number().over(W.orderBy("rank", "key")).alias("rank"), "path", "key", "score")


def expanded(passages: DataFrame, edges: DataFrame, nodes: DataFrame, types: list[str], per_node: int = PER_NODE) -> DataFrame:
    """(node, via, score): nodes of some types next to passages (rank, node, score), at most per_node of each passage.

    Passages are a search's ranked list. They choose in their order, and no node is taken twice; neighbours come by id.
    Of n passages, all others can take no more than n * per_node neighbours of one, so it offers that many and its own;
    the choice among these, n * n * per_node short rows at most, is made in one task.
    """
    ship_package(passages.sparkSession)
    own = passages.where("node IS NOT NULL").groupBy("node").agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"))
    n, few = own.count(), small(own)
    to = nodes.where(F.col("type").isin(*types)).select(F.col("node_id").alias("to_node")).distinct()
    near = edges.join(few, F.col("from_node") == F.col("node")).select("rank", F.col("node").alias("via"), "score", "to_node").distinct()
    fresh = near.join(to, "to_node", "left_semi").join(own.select(F.col("node").alias("to_node")), "to_node", "left_anti")
    offered = fresh.withColumn("n", F.row_number().over(W.partitionBy("via").orderBy("to_node"))).where(F.col("n") <= per_node * max(n, 1))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, of = set(), {}
        for batch in batches:
            keep = []
            for via, node in zip(batch["via"], batch["node"]):
                ok = node not in taken and of.get(via, 0) < per_node
                if ok:
                    taken.add(node)
                    of[via] = of.get(via, 0) + 1
                keep.append(ok)
            yield batch[["node", "via", "score"]][keep]

    lined = offered.select(F.col("to_node").alias("node"), "via", (F.col("score") * NEIGHBOUR_SHARE).cast("double").alias("score"), "rank").coalesce(1).sortWithinPartitions("rank", "node")
    kinds = dict(lined.dtypes)
    return lined.mapInPandas(choose, f"node {kinds['node']}, via {kinds['via']}, score double")


def choose_chunks(sizes: list[int], anchors: list[int], allowance: int, focused: bool) -> list[int]:
    """Places of the chunks of one document that are read, in order; sizes include what joins them.

    All of them if they fit. Else the opening, what the search found, what is around it, then the rest, each if it still
    fits; a focused document has its opening, its matches and their neighbours only. Nothing fits: the opening, cut.
    """
    n = len(sizes)
    if not focused and sum(sizes) <= allowance:
        return list(range(n))
    if focused:
        order = sorted({0, *(a + d for a in anchors for d in (-1, 0, 1) if 0 <= a + d < n)})
    else:
        around = [a + d for a in anchors for d in (1, -1, 2, -2) if 0 <= a + d < n]
        order = list(dict.fromkeys([0, *anchors, *around, *range(n)]))
    chosen, left = [], allowance
    for place in order:
        if sizes[place] <= left:
            chosen.append(place)
            left -= sizes[place]
    return sorted(chosen) or [0]


def documents(cited: DataFrame, artifacts: DataFrame, chunks: DataFrame, anchors: DataFrame, budget: int = ALL_CHARS) -> DataFrame:
    """(place, artifact_id, n_chunks, included, text): cited documents put together again, within a budget of characters.

    cited(place, artifact_id) is a search's list, of which each place is funded in turn; artifacts(id, relative_path,
    size_bytes); chunks(artifact_id, id, chunk_index, label, text), label being what stands above a chunk or empty;
    anchors(chunk_id). What is left out is marked. Texts stay where they are: the choice is made in one task over
    lengths (8 bytes a chunk of the cited documents), and only chosen chunks, as many as the budget holds, are gathered.
    """
    ship_package(cited.sparkSession)
    first = cited.groupBy("artifact_id").agg(F.min("place").alias("place"))
    ending = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    known = small(first).join(artifacts.select(F.col("id").alias("artifact_id"), "relative_path", "size_bytes"), "artifact_id")
    about = known.select("artifact_id", "place", ending.isin(*CODE).alias("code"), (F.coalesce("size_bytes", F.lit(0)) > LARGE_BYTES).alias("large"))
    block = F.concat(F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit("--- "), "label", F.lit(" ---\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    hit = small(anchors.select(F.col("chunk_id").alias("id"), F.lit(True).alias("hit")).distinct())
    blocks = chunks.join(small(about), "artifact_id").join(hit, "id", "left").select("artifact_id", "place", "code", "large", "chunk_index", block.alias("block"), F.coalesce("hit", F.lit(False)).alias("hit"))
    sizes = blocks.groupBy("artifact_id", "place", "code", "large").agg(F.sort_array(F.collect_list(F.struct("chunk_index", F.length("block").alias("n"), "hit"))).alias("c"))
    lined = sizes.select("artifact_id", "place", "code", "large", F.col("c.chunk_index").alias("at"), F.col("c.n").alias("n"), F.col("c.hit").alias("hit"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = 0
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if spent >= budget:
                    break
                allowance = min(CODE_CHARS if row.code else TEXT_CHARS, budget - spent)
                lengths = [int(x) for x in row.n]
                taken = choose_chunks([x + 2 for x in lengths], [i for i, h in enumerate(row.hit) if h], allowance, bool(row.large and not row.code))
                cut = allowance if len(taken) == 1 and lengths[taken[0]] + 2 > allowance else None
                before, size = -1, -2
                for i, place in enumerate(taken):
                    gap = place - before - 1
                    after = len(lengths) - 1 - place if i == len(taken) - 1 and cut is None else 0
                    out.append((row.artifact_id, row.place, int(row.at[place]), len(lengths), cut, gap if before >= 0 else 0, after))
                    marks = [m for m in (out[-1][5], after) if m > 0]
                    size += (cut or lengths[place]) + 2 + sum(len(OMITTED.format(m)) + 2 for m in marks)
                    before = place
                spent += size
            yield pd.DataFrame(out, columns=["artifact_id", "place", "chunk_index", "n_chunks", "cut", "gap", "after"]).astype({"cut": "Int64"})

    plan = lined.repartition(1).sortWithinPartitions("place", "artifact_id").mapInPandas(choose, f"artifact_id {dict(lined.dtypes)['artifact_id']}, place int, chunk_index long, n_chunks int, cut int, gap int, after int")

    def omitted(n: str) -> Column:
        return F.when(F.col(n) > 0, F.replace(F.lit(OMITTED), F.lit("{}"), F.col(n).cast("string")))

    shown = F.when(F.col("cut").isNotNull(), F.substring("block", F.lit(1), F.col("cut"))).otherwise(F.col("block"))
    part = F.concat_ws("\n\n", omitted("gap"), shown, omitted("after"))
    text = blocks.select("artifact_id", "chunk_index", "block").join(F.broadcast(plan), ["artifact_id", "chunk_index"])
    whole = text.groupBy("place", "artifact_id", "n_chunks").agg(F.count("*").cast("int").alias("included"), F.sort_array(F.collect_list(F.struct("chunk_index", part.alias("part")))).alias("parts"))
    return whole.select("place", "artifact_id", "n_chunks", "included", F.array_join("parts.part", "\n\n").alias("text"))


def extract(text: Column, most: int = 400) -> Column:
    """A snippet on one line, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("…"))).otherwise(line)


def plain_answer(citations: DataFrame, k: int = 3) -> DataFrame:
    """(place, line): the first citations (place, text), quoted; the answer where no model writes one."""
    return citations.orderBy("place").limit(k).select("place", F.concat(F.lit("- "), extract(F.col("text")), F.lit(" ["), "place", F.lit("]")).alias("line"))


def annotated(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits (key, ...) with what is known of those that are memory records (record_id, scope, kind, tier, ...)."""
    about = records.select(F.col("record_id").alias("key"), F.struct("scope", "subject", "kind", "tier", "valid_from", "valid_until").alias("memory"))
    return hits.join(about, "key", "left")


def count_uses(records: DataFrame, surfaced: DataFrame, at: str) -> DataFrame:
    """Records with one use more, and the time of it, for each of them that was surfaced (key)."""
    seen = surfaced.select(F.col("key").alias("record_id"), F.lit(1).alias("__used")).distinct()
    joined = records.join(seen, "record_id", "left")
    used = F.col("__used").isNotNull()
    return joined.withColumn("uses", F.coalesce("uses", F.lit(0)) + used.cast("int")).withColumn("last_used_at", F.when(used, at).otherwise(F.col("last_used_at"))).drop("__used")
