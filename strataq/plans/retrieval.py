"""Queries of the operators in strataq.operators, each with the same result as SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.corpus import duck_sql, raw, run_sql, view
from strataq.operators import ann, chunking, enrichment, evaluate, fulltext, fusion, graph, incremental, memory, policy, search_index, setjoin, traversal, vectors
from strataq.session import shared_dir
from strataq.streaming import events as streams
from strataq.streaming import tasks

NOW = "2024-12-31T00:00:00Z"
QUERY_TERMS = ["content", "tion", "the", "und"]

# Fragments of SQL that several statements share.
_FOLD = f"translate(lower(coalesce(%s, '')), '{fulltext.FOLD_FROM}', '{fulltext.FOLD_TO}')"
_TOKENS = r"trim(regexp_replace(" + _FOLD + r", '[^\p{L}\p{N}]+', ' ', 'g'))"
_PRIOR = "(1.0 + 0.05 * (length(path) - length(replace(path, '/', ''))) + CASE WHEN lower(path) LIKE '%/tests/%' OR lower(path) LIKE 'tests/%' OR lower(path) LIKE '%/test_%' OR lower(path) LIKE 'test_%' OR lower(path) LIKE '%_test.%' THEN 0.6 ELSE 0 END + CASE WHEN lower(path) LIKE '%/samples/%' OR lower(path) LIKE 'samples/%' OR lower(path) LIKE '%/examples/%' OR lower(path) LIKE 'examples/%' THEN 0.3 ELSE 0 END)"


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md")))
    return raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".md")).alias("title"), path.alias("path"), F.col("lang").alias("heading"), F.col("text").alias("body"))


_SEARCHABLE = "SELECT doc_id AS id, 'doc_' || doc_id || '.md' AS title, lang || '/' || source || '/doc_' || doc_id || '.md' AS path, lang AS heading, text AS body FROM documents"


def bm25_sql(terms: list[str], k: int) -> str:
    joined = ", ".join(f"{_TOKENS % c} AS t_{c}" for c in fulltext.WEIGHTS)

    def tf(column: str, term: str) -> str:
        wide = f"(' ' || replace(t_{column}, ' ', '  ') || ' ')"
        return f"(length({wide}) - length(replace({wide}, ' {term} ', ''))) / {len(term) + 2}"

    size = " + ".join(f"CASE WHEN t_{c} = '' THEN 0 ELSE length(t_{c}) - length(replace(t_{c}, ' ', '')) + 1 END" for c in fulltext.WEIGHTS)
    freq = ", ".join(" + ".join(f"{w} * {tf(c, t)}" for c, w in fulltext.WEIGHTS.items()) + f" AS f{i}" for i, t in enumerate(terms))
    counts = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(terms)))
    parts = " + ".join(f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH d AS ({_SEARCHABLE}), j AS (SELECT id, path, {joined} FROM d), c AS (SELECT id, path, {size} AS dl, {freq} FROM j),
        s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {counts} FROM c), r AS (SELECT id, path, round(-({parts}) / {_PRIOR}, 6) AS score FROM c CROSS JOIN s WHERE {some})
        SELECT CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank, id, path, score FROM r ORDER BY score, id LIMIT {k}"""


def tx4_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.bm25(searchable(spark, sf_dir), QUERY_TERMS, 10)


def tx4_bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index, which is built here."""
    where = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    fulltext.build_index(searchable(spark, sf_dir), where)
    return fulltext.search_index(spark, where, QUERY_TERMS, 10)


def tx4_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for the text of every turn of users, from one index."""
    docs = searchable(spark, sf_dir).select(F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), F.lit("").alias("artifact_id"), F.lit("").alias("source"), F.lit(None).cast("string").alias("acl"), "title", "path", "heading", "body")
    asked = raw(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("question"), "text")
    return search_index.answer(docs, asked, 5).select("question", "rank", F.col("id").cast("long").alias("id"), "score")


def _questions_sql() -> str:
    """Every question joined with all postings of its terms."""
    stop = ", ".join(f"'{w}'" for w in sorted(fulltext.STOPWORDS))
    tokens = " UNION ALL ".join(f"SELECT id, path, {w} AS w, unnest(list_filter(string_split({_TOKENS % c}, ' '), lambda t: t <> '')) AS term FROM d" for c, w in fulltext.WEIGHTS.items())
    return rf"""WITH d AS ({_SEARCHABLE}), t AS MATERIALIZED ({tokens}), l AS (SELECT id, path, count(*) AS dl FROM t GROUP BY id, path),
        p AS MATERIALIZED (SELECT term, id, CAST(sum(w) AS DOUBLE) AS f FROM t GROUP BY term, id), n AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM t) / CAST((SELECT count(*) FROM d) AS DOUBLE) AS avgdl),
        w AS (SELECT conv_id || '-' || turn AS question, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+')) AS word FROM conversations WHERE role = 'user'),
        q AS (SELECT DISTINCT question, lower(unnest(list_concat([word], list_filter(string_split(regexp_replace(word, '([a-z0-9])([A-Z])', ' ', 'g'), ' '), lambda x: length(x) > 1)))) AS term FROM w),
        c AS (SELECT question, term FROM q WHERE term NOT IN ({stop}) UNION ALL SELECT question, term FROM q WHERE question NOT IN (SELECT question FROM q WHERE term NOT IN ({stop}))),
        r AS (SELECT question, p.id, path, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part FROM c JOIN p USING (term) JOIN n USING (term) JOIN l ON l.id = p.id CROSS JOIN s),
        g AS (SELECT question, id, round(-sum(part / {_PRIOR}), 6) AS score FROM r GROUP BY question, id),
        k AS (SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY score, id) AS INTEGER) AS rank, id, score FROM g) SELECT question, rank, id, score FROM k WHERE rank <= 5"""


def tx3_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fulltext.wide_text(fulltext.tokens_text(F.col("text")))
    return raw(spark, sf_dir, "documents").select("doc_id", fulltext.occurrences(text, "of_the").alias("n")).where("n > 0")


def tx2_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(fulltext.tokens_text(F.col("text")), " "))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df >= 5")


def tx1_query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in fulltext.query_tokens("How does sync_engine call parseConfig in the HTTPServer?")], "token string")


def vx3_cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "embeddings")
    query = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    return vectors.cosine_top_k(rows, query, 10)


def vx10_filtered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "embeddings")
    query = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    return vectors.cosine_top_k(rows, query, 10, where=F.col("label") == 1)


def _cosine_sql(where: str) -> str:
    return f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), d AS (
        SELECT vec_id, round(list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e, lambda x: CAST(x AS DOUBLE)))
            / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS cosine FROM embeddings CROSS JOIN q WHERE {where})
        SELECT CAST(row_number() OVER (ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank, vec_id, cosine, round(greatest(0.0, least(1.0, (cosine + 1) / 2)), 6) AS score FROM d ORDER BY cosine DESC, vec_id LIMIT 10"""


def vx4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an inverted file finds for every 50th vector, held against exact search: rank, and whether it is among the exact ten."""
    rows = raw(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    where = f"{shared_dir(spark).rstrip('/')}/ann-{uuid.uuid4().hex}"
    ann.build(rows, where)
    wanted = ann.exact(rows, asked).select("query_id", "id", F.lit(True).alias("right"))
    return ann.search(spark, where, asked).join(wanted, ["query_id", "id"], "left").select("query_id", "rank", F.col("id").alias("vec_id"), "cosine", F.coalesce("right", F.lit(False)).alias("right"))


def vx4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every 50th."""
    rows = raw(spark, sf_dir, "embeddings")
    return ann.exact(rows, rows.where("vec_id % 50 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


def tm22_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the ten nearest vectors of every 50th tell its label: right are those of the same one, stale those of the label before."""
    rows = raw(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), F.col("label").alias("own"))
    found = ann.exact(rows, rows.where("vec_id % 50 = 0")).select(F.col("query_id").alias("question"), "rank", "id")
    return evaluate.figures(evaluate.by_label(asked, found, rows.select(F.col("vec_id").alias("id"), "label"), 10), 10)


def vx6_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "embeddings").select("vec_id", "label")
    return vectors.upsert(rows, rows.where("vec_id % 4 = 0").withColumn("label", F.lit(99)), "vec_id")


def vx7_embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors.embed(vectors.missing(docs, raw(spark, sf_dir, "embeddings"), "vec_id"), "vec_id", "text", 64)


def ag23_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(raw(spark, sf_dir, "embeddings"), "label")


def _arm(df: DataFrame, key: str, order: list) -> DataFrame:
    from pyspark.sql import Window as W

    top = df.orderBy(*order).limit(50)
    return top.select(F.col(key).alias("key"), F.col(key).alias("node"), F.row_number().over(W.orderBy(*order)).alias("rank"))


def rf1_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and vector arms of one question, fused, with vectors standing for the documents of the same id."""
    text = fulltext.bm25(searchable(spark, sf_dir), ["the"], 50).select(F.col("id").alias("key"), F.col("id").alias("node"), "rank")
    rows = raw(spark, sf_dir, "embeddings")
    query = [float(x) for x in rows.where("vec_id = 0").first()["embedding"]]
    vector = vectors.cosine_top_k(rows, query, 50).select(F.col("vec_id").alias("key"), F.col("vec_id").alias("node"), "rank")
    return fusion.reciprocal_rank([("text", text), ("vector", vector)], 20)


def _hybrid_sql() -> str:
    return f"""WITH t AS (SELECT id AS k, rank AS r, 'text' AS arm FROM ({bm25_sql(["the"], 50)}) x), v AS (SELECT vec_id AS k, rank AS r, 'vector' AS arm FROM ({_cosine_sql("true").replace("LIMIT 10", "LIMIT 50")}) y),
        f AS (SELECT k AS key, k AS node, round(sum(CAST(1 AS DOUBLE) / (60 + r)), 6) AS score, min(r) AS best_rank, string_agg(arm, '+' ORDER BY arm) AS retrieved_by FROM (SELECT * FROM t UNION ALL SELECT * FROM v) u GROUP BY k)
        SELECT CAST(row_number() OVER (ORDER BY score DESC, best_rank, key) AS INTEGER) AS rank, * FROM f ORDER BY score DESC, best_rank, key LIMIT 20"""


def rf4_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _arm(raw(spark, sf_dir, "documents"), "doc_id", [F.desc("n_chars"), "doc_id"])
    return fusion.promoted(hits, F.col("key") % 3 == 0, 10).select("key", "rank")


def fp6_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = raw(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), F.lit("chunk").alias("type"), F.when(F.col("lang") != "es", F.col("lang")).alias("source_type"), (F.col("n_chars") / 1000.0).alias("score"))
    return hits.where(fusion.criteria(exclude_sources=["src0"], node_types=["chunk"], min_score=1.0, exclude_source_types=["fr"])).select("doc_id")


def fp7_memory_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "memory_records")
    modes = {"auto": policy.MemoryPolicy(), "only": policy.MemoryPolicy(mode="only", scopes=("org", "user"), subject="topic 1"), "past": policy.MemoryPolicy(as_of="2024-05-01T00:00:00Z"), "off": policy.MemoryPolicy(mode="off"), "rules": policy.MemoryPolicy(include_rules=True, current_only=False)}
    return rows.select("record_id", *[policy.admits(p, NOW).alias(m) for m, p in modes.items()])


_HOT = "coalesce(nullif(tier, ''), 'hot')"
_VALID = "(coalesce(valid_from, '') = '' OR valid_from <= '{0}') AND (coalesce(valid_until, '') = '' OR valid_until > '{0}')"
_POLICY_SQL = f"""SELECT record_id,
    {_HOT} = 'hot' AND kind NOT IN ('alias', 'preference', 'exclusion') AND {_VALID.format(NOW)} AS auto,
    {_HOT} = 'hot' AND kind NOT IN ('alias', 'preference', 'exclusion') AND scope IN ('org', 'user') AND position('topic 1' IN lower(coalesce(subject, ''))) > 0 AND {_VALID.format(NOW)} AS only,
    {_HOT} IN ('hot', 'cold') AND kind NOT IN ('alias', 'preference', 'exclusion') AND {_VALID.format("2024-05-01T00:00:00Z")} AS past,
    false AS off, {_HOT} IN ('hot', 'cold') AS rules FROM memory_records"""


def fp10_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "artifacts")
    return rows.select("doc_id", policy.visible(["user:ana"], False).alias("ana"), policy.visible(None, False).alias("anonymous"), policy.visible(None, True).alias("anonymous_public"))


_ACL_SQL = """SELECT doc_id, doc_id % 5 IN (0, 1, 3, 4) AS ana, doc_id % 5 = 0 AS anonymous, doc_id % 5 IN (0, 3, 4) AS anonymous_public FROM documents"""


def gr2_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(view(spark, sf_dir, "graph_edges"), "region:1", 3)


def gr4_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "graph_edges")
    near = graph.neighbors(edges, "nation:3", 1).select("node")
    return edges.join(near.withColumnRenamed("node", "from_node"), "from_node", "left_semi").join(near.withColumnRenamed("node", "to_node"), "to_node", "left_semi").select("from_node", "to_node", "type")


def gr5_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = graph.shortest_path(view(spark, sf_dir, "graph_edges"), "customer:1", "supplier:1")
    return spark.createDataFrame([(len(path) - 1,)], "hops int")


_PATH_SQL = """WITH RECURSIVE both_ways AS (SELECT from_node AS a, to_node AS b FROM graph_edges UNION SELECT to_node, from_node FROM graph_edges),
    walk(node, hops) AS (SELECT 'customer:1', 0 UNION SELECT b, hops + 1 FROM walk JOIN both_ways ON a = node WHERE hops < 5)
    SELECT CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE node = 'supplier:1'"""


def gr5_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the first of the shortest paths between two nodes, over edges in either direction."""
    path = traversal.path(view(spark, sf_dir, "graph_edges"), "customer:1", "supplier:2")
    return spark.createDataFrame(list(enumerate(path)), "place int, node string")


def _levels_sql(start: str, levels: int) -> str:
    """Breadth-first search by a statement a level; of the paths to a node the first by names."""
    out = ["e AS MATERIALIZED (SELECT from_node AS a, to_node AS b FROM graph_edges UNION SELECT to_node, from_node FROM graph_edges)", f"l0 AS (SELECT '{start}' AS node, ['{start}'] AS path)"]
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(i))
        out.append(f"l{i} AS MATERIALIZED (SELECT e.b AS node, min(list_append(path, e.b)) AS path FROM l{i - 1} JOIN e ON e.a = node WHERE e.b NOT IN ({seen}) GROUP BY e.b)")
    found = " UNION ALL ".join(f"SELECT * FROM l{i} WHERE node = 'supplier:2'" for i in range(levels + 1))
    return f"WITH {', '.join(out)} SELECT CAST(i - 1 AS INTEGER) AS place, path[i] AS node FROM ({found}) f, generate_series(1, 9) g(i) WHERE i <= len(path)"


def gr2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 nodes around a region, hierarchy first, without customers and what is behind them only."""
    found = traversal.neighbourhood(view(spark, sf_dir, "graph_edges"), "region:1", 3, nodes=view(spark, sf_dir, "graph_nodes"), exclude_node_types=["customer"], max_nodes=200)
    return found.select("place", "node", "depth", F.array_join("path", ">").alias("path"), F.array_join("edge_types", ",").alias("edge_types"))


def _near_sql(start: str, depth: int, most: int) -> str:
    out = ["e AS MATERIALIZED (SELECT from_node, to_node, min(CASE WHEN type = 'contains' THEN '0' ELSE '1' END) || to_node AS step, list_sort(list(DISTINCT type)) AS types FROM graph_edges WHERE to_node NOT LIKE 'customer:%' GROUP BY from_node, to_node)", f"l0 AS (SELECT '{start}' AS node, CAST([] AS VARCHAR[]) AS steps, CAST([] AS VARCHAR[]) AS types, 0 AS depth)"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{j}" for j in range(i))
        out.append(f"l{i} AS MATERIALIZED (SELECT to_node AS node, min(list_append(steps, step)) AS steps, arg_min(e.types, list_append(steps, step)) AS types, {i} AS depth FROM l{i - 1} JOIN e ON from_node = node WHERE to_node NOT IN ({seen}) GROUP BY to_node)")
    every = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, depth + 1))
    return f"WITH {', '.join(out)} SELECT CAST(row_number() OVER (ORDER BY depth, steps) AS INTEGER) AS place, node, depth, '{start}>' || array_to_string(list_transform(steps, lambda s: s[2:]), '>') AS path, array_to_string(types, ',') AS edge_types FROM ({every}) x ORDER BY depth, steps LIMIT {most}"


def gr7_match_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.match_nodes(view(spark, sf_dir, "graph_nodes"), ["america", "region"], "america", 30)


_MATCH_SQL = """SELECT node_id, score FROM (SELECT node_id, label, greatest(CASE WHEN lower(label) = 'america' THEN 1.0 WHEN position('america' IN lower(label)) > 0 THEN 0.95
    WHEN position('america' IN lower(label)) > 0 AND position('region' IN lower(label)) > 0 THEN 0.9 WHEN position('america' IN lower(label)) > 0 OR position('region' IN lower(label)) > 0 THEN 0.6 ELSE 0.0 END,
    CASE WHEN regexp_matches(type, '(america|region)') THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM graph_nodes) t WHERE score > 0 ORDER BY score DESC, label, node_id LIMIT 30"""


def gr10_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("term"))
    return graph.similarity_edges(terms)


def j10_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("term"), F.lit(1).alias("n"))
    return graph.shared_terms(terms.distinct()).select("a", "b", "shared")


_SIMILAR_SQL = """WITH t AS (SELECT DISTINCT l_orderkey AS node, l_suppkey AS term FROM lineitem), n AS (SELECT node, count(*) AS n FROM t GROUP BY node HAVING count(*) >= 2), k AS (SELECT t.*, n.n FROM t JOIN n ON n.node = t.node),
    p AS (SELECT x.node AS a, y.node AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM k x JOIN k y ON x.term = y.term AND x.node < y.node GROUP BY x.node, y.node, x.n, y.n)
    SELECT a, b, shared, round(CAST(shared AS DOUBLE) / (na + nb - shared), 3) AS confidence FROM p WHERE shared >= 2 OR CAST(shared AS DOUBLE) / (na + nb - shared) >= 0.25"""


def gr20_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "memory_records")
    return graph.components(rows.where("supersedes IS NOT NULL").select(F.col("record_id").alias("a"), F.col("supersedes").alias("b")))


_COMPONENTS_SQL = """WITH RECURSIVE l AS (SELECT record_id AS a, supersedes AS b FROM memory_records WHERE supersedes IS NOT NULL), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    walk(node, seen) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.seen) SELECT node, min(seen) AS label FROM walk GROUP BY node"""


def tm1_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.effective_end(view(spark, sf_dir, "memory_records")).select("record_id", "ends")


_ENDS_SQL = """SELECT m.record_id, least(nullif(m.valid_until, ''), s.at) AS ends FROM memory_records m LEFT JOIN (SELECT supersedes, min(asserted_at) AS at FROM memory_records WHERE supersedes IS NOT NULL GROUP BY supersedes) s ON s.supersedes = m.record_id"""
_AGE = f"(epoch(TIMESTAMP '{NOW[:10]} 00:00:00') - epoch(CAST(replace(replace(greatest(asserted_at, coalesce(last_used_at, ''), coalesce(last_seen, '')), 'T', ' '), 'Z', '') AS TIMESTAMP))) / 86400.0"
_SALIENCE = f"round(pow(0.5, greatest(0.0, {_AGE}) / 90.0) * (1 + 0.5 * ln(1 + uses) + 0.5 * ln(1 + observations)) * CASE scope WHEN 'org' THEN 1.25 WHEN 'session' THEN 0.6 ELSE 1.0 END, 6)"


def tm6_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "memory_records").select("record_id", memory.salience(NOW).alias("salience"))


def tm5_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.consolidate(view(spark, sf_dir, "memory_records"), NOW, {"session": 90, "user": 300}, 30)


_CONSOLIDATE_SQL = """WITH s AS (SELECT supersedes AS record_id, min(asserted_at) AS first_at FROM memory_records WHERE supersedes IS NOT NULL GROUP BY supersedes),
    r AS (SELECT m.record_id, s.first_at, epoch(CAST(replace(replace(asserted_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) + 86400 * CASE scope WHEN 'session' THEN 90 WHEN 'user' THEN 300 END AS deadline, epoch(CAST(replace(replace(s.first_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS sup, epoch(TIMESTAMP '2024-12-31 00:00:00') AS now FROM memory_records m LEFT JOIN s ON s.record_id = m.record_id)
    SELECT record_id, CASE WHEN first_at IS NOT NULL THEN 'superseded' ELSE 'expired' END AS reason FROM r WHERE floor((now - CASE WHEN first_at IS NOT NULL THEN sup WHEN now >= deadline THEN deadline END) / 86400) >= 30"""


def tm7_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.prune(view(spark, sf_dir, "memory_records"), NOW, 60, 8, 100)


_PRUNE_SQL = f"""WITH s AS (SELECT record_id, scope, subject, {_SALIENCE} AS s FROM memory_records WHERE kind NOT IN ('alias', 'preference', 'exclusion')),
    r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY s DESC, record_id) AS r1, CASE WHEN subject <> '' THEN row_number() OVER (PARTITION BY subject ORDER BY s DESC, record_id) END AS r2 FROM s),
    k AS (SELECT record_id FROM r WHERE r1 <= 60 AND coalesce(r2, 0) <= 8 ORDER BY s DESC, record_id LIMIT 100) SELECT record_id FROM s WHERE record_id NOT IN (SELECT record_id FROM k)"""


def tm13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.clusters(view(spark, sf_dir, "memory_records"), 0.05)


def tm13_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.similar_pairs(view(spark, sf_dir, "memory_records"), 0.05)


_PAIRS_SQL = """WITH t AS (SELECT DISTINCT record_id, bucket, token FROM (SELECT record_id, scope || '|' || coalesce(subject, '') || '|' || kind || '|' || CASE WHEN scope = 'org' THEN '' ELSE written_by END AS bucket, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM memory_records) x WHERE length(token) > 1),
    n AS (SELECT record_id, count(*) AS n FROM t GROUP BY record_id), k AS (SELECT t.*, n.n FROM t JOIN n ON n.record_id = t.record_id),
    p AS (SELECT x.record_id AS a, y.record_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM k x JOIN k y ON x.bucket = y.bucket AND x.token = y.token AND x.record_id < y.record_id GROUP BY x.record_id, y.record_id, x.n, y.n)
    SELECT a, b, round(CAST(k AS DOUBLE) / (na + nb - k), 6) AS jaccard FROM p WHERE round(CAST(k AS DOUBLE) / (na + nb - k), 6) >= 0.05"""


_CLUSTERS_SQL = f"""WITH RECURSIVE pairs AS MATERIALIZED (SELECT * FROM ({_PAIRS_SQL}) p), e AS MATERIALIZED (SELECT a, b, jaccard FROM pairs UNION ALL SELECT b, a, jaccard FROM pairs),
    walk(node, seen) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.seen), l AS (SELECT node, min(seen) AS label FROM walk GROUP BY node),
    s AS (SELECT a AS node, round(sum(jaccard), 6) AS sim FROM e GROUP BY a), m AS (SELECT l.node, label, sim, observations FROM l JOIN s ON s.node = l.node JOIN memory_records r ON r.record_id = l.node)
    SELECT node AS record_id, first_value(node) OVER (PARTITION BY label ORDER BY sim DESC, node) AS canonical, CAST(sum(observations) OVER (PARTITION BY label) + count(*) OVER (PARTITION BY label) AS BIGINT) AS absorbed FROM m"""


def ag22_mean_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean similarity of all pairs of conversations by their words; the SQL is that of the gallery."""
    words = run_sql(spark, sf_dir, "SELECT DISTINCT conv_id AS id, w AS token FROM (SELECT conv_id, @UNNEST(@SPLIT(lower(text), ' ')) AS w FROM conversations) x WHERE length(w) > 1")
    return setjoin.mean_jaccard(words)


def tg1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(raw(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "start_line", "text_hash")


_CHUNK_SQL = """WITH RECURSIVE w(doc_id, text, s, e) AS (
        SELECT doc_id, text, CAST(0 AS BIGINT), CASE WHEN length(text) <= 4000 THEN length(text) WHEN nl > 2000 THEN nl ELSE 4000 END FROM (SELECT doc_id, text, 4000 - position(chr(10) IN reverse(substr(text, 1, 4000))) + CASE WHEN position(chr(10) IN reverse(substr(text, 1, 4000))) = 0 THEN -9999 ELSE 0 END AS nl FROM documents WHERE length(text) > 0) a
        UNION ALL SELECT doc_id, text, s2, CASE WHEN length(text) <= s2 + 4000 THEN length(text) WHEN nl > s2 + 2000 THEN nl ELSE s2 + 4000 END FROM (
            SELECT doc_id, text, s2, CASE WHEN position(chr(10) IN reverse(substr(text, s2 + 1, 4000))) = 0 THEN -1 ELSE s2 + 4000 - position(chr(10) IN reverse(substr(text, s2 + 1, 4000))) END AS nl
            FROM (SELECT doc_id, text, greatest(e - 400, s + 1) AS s2 FROM w WHERE e < length(text)) b) c),
    c AS (SELECT doc_id, s, trim(substr(text, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1 AS start_line FROM w)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, start_line, sha256(body) AS text_hash FROM c WHERE body <> ''"""


def tg3_as_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return chunking.as_of_join(rows.where("role <> 'user'"), rows.where("role = 'user'").withColumn("mark", F.concat(F.lit("q"), F.col("turn"))), "conv_id", "turn", "mark")


_AS_OF_SQL = """SELECT p.conv_id, p.turn, (SELECT 'q' || max(m.turn) FROM conversations m WHERE m.role = 'user' AND m.conv_id = p.conv_id AND m.turn <= p.turn) AS mark FROM conversations p WHERE p.role <> 'user'"""


def tg9_gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_linenumber") + F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") < 5, -1).otherwise(0)).cast("long").alias("ordinal"))
    rows = rows.groupBy("series", "line").agg(F.max("ordinal").alias("ordinal"))
    return chunking.gap_audit(rows)


_GAP_SQL = """WITH o AS (SELECT l_orderkey AS series, CAST(l_linenumber AS BIGINT) AS line, max(CAST(l_linenumber + CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity < 5 THEN -1 ELSE 0 END AS BIGINT)) AS ordinal FROM lineitem GROUP BY l_orderkey, l_linenumber),
    b AS (SELECT *, max(ordinal) OVER (PARTITION BY series ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
    SELECT series, line, CASE WHEN ordinal = before THEN 'duplicate' WHEN ordinal < before THEN 'out_of_order' ELSE 'gap' END AS issue, CASE WHEN ordinal > before + 1 THEN array_to_string(generate_series(before + 1, ordinal - 1), ',') END AS missing FROM b WHERE before IS NOT NULL AND ordinal <> before + 1"""


def fp15_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "artifacts").select("relative_path", "sha256", "doc_id")
    now = rows.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x"), "sha256")).otherwise(F.col("sha256")))
    return incremental.changes(rows.where("doc_id % 3 <> 0"), now, "relative_path", "sha256")


_CHANGES_SQL = """SELECT relative_path, CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM artifacts WHERE doc_id % 3 <> 0 OR doc_id % 7 <> 0"""


def st7_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.element_at(F.array(*[F.lit(x) for x in ("publish", "claim", "heartbeat", "nack", "ack")]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = raw(spark, sf_dir, "events").select(F.concat(F.lit("idx-"), F.col("user_id")).alias("id"), ops.alias("op"), F.col("ts").alias("at"))
    return incremental.queue_state(rows, "2024-01-30 12:00:00")


def st1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a stream, in batches that end after a quiet day or three days; those that are due."""
    rows = streams.source(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.lit("x").alias("op"))
    found = streams.drain(tasks.streamed(rows, tasks.Debounce(86400, 3 * 86400), streams.WATERMARK), "append")
    return found.select(F.col("key").cast("long").alias("user_id"), F.col("since").alias("first_us"), F.col("at").alias("due_us"), "n")


_BATCHES_SQL = """WITH RECURSIVE u AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS until FROM events), e AS MATERIALIZED (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS r FROM events, u WHERE epoch_us(ts) <= until),
    w AS (SELECT user_id, r, us AS first, us AS last, CAST(1 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS first_us, CAST(NULL AS BIGINT) AS due_us, CAST(NULL AS BIGINT) AS closed FROM e WHERE r = 1
        UNION ALL SELECT user_id, r, CASE WHEN us >= due THEN us ELSE first END, us, CASE WHEN us >= due THEN 1 ELSE n + 1 END, CASE WHEN us >= due THEN first END, CASE WHEN us >= due THEN due END, CASE WHEN us >= due THEN n END
            FROM (SELECT w.user_id, e.r, e.us, w.first, w.n, least(w.last + 86400000000, w.first + 3 * 86400000000) AS due FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1) s),
    z AS (SELECT user_id, first, least(last + 86400000000, first + 3 * 86400000000) AS due, n FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1)
    SELECT user_id, first_us, due_us, closed AS n FROM w WHERE due_us IS NOT NULL UNION ALL SELECT user_id, first, due, n FROM z, u WHERE due <= until"""


def st7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue as a stream: what each user's task has come to, by the last of its changes that the watermark has passed."""
    rows = streams.source(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), _queue_op().alias("op"))
    found = streams.drain(tasks.streamed(rows, tasks.Queue(visibility=86400, retry=3600), streams.WATERMARK), "append")
    return found.groupBy("key").agg(F.count("*").alias("changes"), F.count_if(F.col("what") == "inflight").alias("claims"), F.max("at").alias("at"))


def _queue_op():
    return F.element_at(F.array(*[F.lit(x) for x in ("publish", "claim", "heartbeat", "nack", "ack")]), (F.col("event_id") % 5 + 1).cast("int"))


_QUEUE_SQL = """WITH e AS (SELECT 'idx-' || user_id AS id, (['publish', 'claim', 'heartbeat', 'nack', 'ack'])[event_id % 5 + 1] AS op, event_id % 5 AS o, ts FROM events),
    l AS (SELECT id, arg_max(op, epoch_us(ts) * 8 + o) AS op, max(ts) AS seen, max(ts) FILTER (WHERE op = 'ack') AS acked, max(ts) FILTER (WHERE op = 'publish') AS published FROM e GROUP BY id),
    c AS (SELECT l.*, (SELECT count(*) FROM e WHERE e.id = l.id AND e.op = 'claim' AND (l.acked IS NULL OR e.ts > l.acked)) AS attempts FROM l)
    SELECT id, CASE WHEN acked IS NOT NULL AND published <= acked AND attempts = 0 THEN 'done' WHEN op IN ('claim', 'heartbeat') AND epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(seen)) <= 300 THEN 'running' WHEN attempts >= 3 THEN 'dead' ELSE 'pending' END AS status, attempts FROM c"""


def w14_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(raw(spark, sf_dir, "events"), "user_id", "ts", 86400.0).select("user_id", "session", "n")


_SESSIONS_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 86400 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n FROM s GROUP BY user_id, session"""


def st_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.tumbling(streams.source(spark, sf_dir).withWatermark("ts", streams.WATERMARK)))


def st_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.sliding(streams.source(spark, sf_dir).withWatermark("ts", streams.WATERMARK)))


def st_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drain(streams.user_sessions(streams.source(spark, sf_dir).withWatermark("ts", streams.WATERMARK)))


def st15_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice and leaves once."""
    twice = streams.source(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return streams.drain(streams.deduplicated(twice.withWatermark("ts", streams.WATERMARK)), "append")


def st14_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.source(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used_at"))
    return streams.drain(events)


def tg12_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.python_symbols(enrichment.synthetic_modules(raw(spark, sf_dir, "nation")))


def tm8_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.normalized(view(spark, sf_dir, "memory_records"), "record_id", "text")


def ml2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.minhash(raw(spark, sf_dir, "documents"), "source", "text")


def ml1_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.kmeans(raw(spark, sf_dir, "embeddings"), 8)


def dx8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.html_text(raw(spark, sf_dir, "pages"), "page_id", "html")


SQL = {
    "tx4_bm25": bm25_sql(QUERY_TERMS, 10),
    "tx4_bm25_index": bm25_sql(QUERY_TERMS, 10),
    "tx4_questions": _questions_sql(),
    "tx3_phrase": rf"WITH t AS (SELECT doc_id, ' ' || replace({_TOKENS % 'text'}, ' ', '  ') || ' ' AS w FROM documents) SELECT doc_id, CAST((length(w) - length(replace(w, ' of  the ', ''))) / 9 AS BIGINT) AS n FROM t WHERE w LIKE '% of  the %'",
    "tx2_tokenize": f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(string_split({_TOKENS % 'text'}, ' '))) AS token FROM documents) t GROUP BY token HAVING count(*) >= 5",
    "tx1_query_tokens": "SELECT unnest(['call', 'config', 'engine', 'httpserver', 'parse', 'parseconfig', 'sync', 'sync_engine']) AS token",
    "vx3_cosine_top_k": _cosine_sql("true"),
    "vx10_filtered_top_k": _cosine_sql("label = 1"),
    "vx4_exact": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS s FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, round(s, 6) AS cosine FROM r WHERE rank <= 10""",
    "tm22_figures": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), r AS (SELECT q.vec_id AS question, q.label AS own, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS rank FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        j AS (SELECT question, count(*) FILTER (WHERE own = label) AS wanted, count(*) FILTER (WHERE rank <= 10) AS shown, count(*) FILTER (WHERE rank <= 10 AND own = label) AS hits, min(rank) FILTER (WHERE rank <= 10 AND own = label) AS first, count(*) FILTER (WHERE rank <= 10 AND own = label + 1) AS leaks FROM r GROUP BY question)
        SELECT count(*) AS questions, round(avg(hits / CAST(least(wanted, 10) AS DOUBLE)), 6) AS recall, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END), 6) AS complete, round(avg(hits / CAST(shown AS DOUBLE)), 6) AS "precision", round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, CAST(NULL AS DOUBLE) AS abstention, round(avg(CASE WHEN leaks > 0 THEN 1.0 ELSE 0.0 END), 6) AS leak_rate FROM j WHERE wanted > 0""",
    "vx6_upsert": "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 99 ELSE label END AS label FROM embeddings",
    "ag23_centroids": "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(var_pop(CAST(x AS DOUBLE)), 6) AS variance, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) t GROUP BY label, i",
    "rf1_hybrid": _hybrid_sql(),
    "rf4_prefer": "WITH a AS (SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) x), m AS (SELECT *, CASE WHEN key % 3 = 0 THEN row_number() OVER (PARTITION BY key % 3 = 0 ORDER BY r) END AS mr FROM a) SELECT key, CAST(row_number() OVER (ORDER BY coalesce(mr <= 5, false) DESC, r) AS INTEGER) AS rank FROM m",
    "fp6_criteria": "SELECT doc_id FROM documents WHERE source <> 'src0' AND n_chars / 1000.0 >= 1.0 AND lang <> 'fr'",
    "fp7_memory_policy": duck_sql(_POLICY_SQL),
    "fp10_acl": _ACL_SQL,
    "gr2_neighbors": duck_sql("WITH RECURSIVE walk(node, depth) AS (SELECT 'region:1', 0 UNION SELECT e.to_node, w.depth + 1 FROM walk w JOIN graph_edges e ON e.from_node = w.node WHERE w.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node"),
    "gr4_slice": duck_sql("WITH near AS (SELECT 'nation:3' AS n UNION SELECT to_node FROM graph_edges WHERE from_node = 'nation:3') SELECT from_node, to_node, type FROM graph_edges WHERE from_node IN (SELECT n FROM near) AND to_node IN (SELECT n FROM near)"),
    "gr5_shortest_path": duck_sql(_PATH_SQL),
    "gr5_path": duck_sql(_levels_sql("customer:1", 6)),
    "gr2_hierarchy": duck_sql(_near_sql("region:1", 3, 200)),
    "gr7_match_nodes": duck_sql(_MATCH_SQL),
    "gr10_similarity": _SIMILAR_SQL,
    "j10_shared_terms": "WITH t AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT a.o AS a, b.o AS b, count(*) AS shared FROM t a JOIN t b ON a.s = b.s AND a.o < b.o GROUP BY a.o, b.o HAVING count(*) >= 2",
    "gr20_components": duck_sql(_COMPONENTS_SQL),
    "tm1_ends": duck_sql(_ENDS_SQL),
    "tm6_salience": duck_sql(f"SELECT record_id, {_SALIENCE} AS salience FROM memory_records"),
    "tm5_consolidate": duck_sql(_CONSOLIDATE_SQL),
    "tm7_prune": duck_sql(_PRUNE_SQL),
    "tm13_pairs": duck_sql(_PAIRS_SQL),
    "tm13_clusters": duck_sql(_CLUSTERS_SQL),
    "tg1_chunks": _CHUNK_SQL,
    "tg3_as_of_label": _AS_OF_SQL,
    "tg9_gap_audit": _GAP_SQL,
    "fp15_changes": duck_sql(_CHANGES_SQL),
    "w14_sessions": _SESSIONS_SQL,
    "st1_batches": _BATCHES_SQL,
    "st7_queue": _QUEUE_SQL,
    "st_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY date_trunc('hour', ts), event_type",
    "st_sliding": "SELECT window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL (15 * i) MINUTES AS window_start FROM events CROSS JOIN generate_series(0, 3) g(i)) t GROUP BY window_start",
    "st_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""",
    "st15_dedup": "SELECT event_id, event_type FROM events",
    "st14_counters": "SELECT user_id, count(*) AS uses, max(ts) AS last_used_at FROM events GROUP BY user_id",
}

_NAMES = tuple(n for n in list(globals()) if n[:2] in ("tx", "vx", "ag", "rf", "fp", "gr", "tm", "tg", "st", "ml", "dx") or n.startswith(("w14", "j10")))
QUERIES = {n: globals()[n] for n in _NAMES if callable(globals()[n]) and n not in ("streams",)}
