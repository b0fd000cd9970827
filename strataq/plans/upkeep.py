"""Queries of upkeep, names and node-link graphs, with SQL that is written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.corpus import duck_sql, raw, view
from strataq.functions import words
from strataq.operators import digest, enrichment, paths, upkeep
from strataq.session import checkpointed
from strataq.sources import graphs


def fp16_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents").select(F.concat(F.lit("file:"), "doc_id").alias("artifact_id"), "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"))
    m = F.col("doc_id") % 7
    state = docs.where("doc_id % 7 > 0").select("artifact_id", F.when(m == 1, "other").otherwise(F.col("sha256")).alias("sha256"), F.when(m == 3, "failed").otherwise("indexed").alias("status"), F.when(m != 4, 2).alias("n_chunks"))
    return upkeep.needs_repair(docs.withColumn("expected", F.lit(2)), state, docs.where("doc_id % 7 <> 2").select(F.col("artifact_id").alias("node_id")))


def vx11_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two of the regions' configurations, one after the other."""
    kind = F.when(F.col("r_regionkey") == 1, "disabled").when(F.col("r_regionkey") > 1, F.concat(F.lit("m"), "r_regionkey"))
    rows = raw(spark, sf_dir, "region").select("r_regionkey", kind.alias("c"))
    pairs = rows.toDF("a", "before").join(rows.where("r_regionkey > 0").toDF("b", "now"))
    return pairs.select("a", "b", upkeep.embedding_change(F.col("before"), F.col("now")).alias("change"))


def sc26_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = raw(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("m/"), "p_partkey", F.lit(".png")).alias("path"), F.lit("").alias("text"))
    texts = [parts.where(f"p_partkey % {n} = 0").select("p_partkey", F.concat("path", F.lit(ending)).alias("path"), F.concat(F.lit(f"{n}: "), "p_partkey").alias("text")) for n, ending in ((2, ".extract.txt"), (3, ".caption.txt"), (5, ".transcript.txt"))]
    return upkeep.with_sidecars(parts.unionByName(texts[0]).unionByName(texts[1]).unionByName(texts[2]).drop("p_partkey"))


def tx14_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with a word that begins with `nation` or `supplier`, the first 2,000 of them."""
    return upkeep.node_candidates(upkeep.node_terms(view(spark, sf_dir, "graph_nodes")), ["Nation", "supplier", "x"])


def tx7_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("path"))
    return rows.select("doc_id", F.round(upkeep.preferred(F.lit(1.2), F.col("path"), ["EN/", "src1", "src"]), 6).alias("prior"))


def rf3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    arm = lambda n, kind, where: docs.where(where).select("key", F.lit(kind).alias("kind"), F.concat(F.lit(n), "key").alias("title"))
    found = arm("g", "relationship", "key % 5 = 0").unionByName(arm("n", "node", "key % 5 = 1 OR key % 5 = 2"))
    return upkeep.chosen_records([("graph", found), ("text", arm("t", "chunk", "key % 2 = 0")), ("vector", arm("v", "chunk", "key % 3 = 0"))])


def gr15_node_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and parts; suppliers have a second link to each nation."""
    nodes = view(spark, sf_dir, "graph_nodes").where("type IN ('region', 'nation')")
    edges = view(spark, sf_dir, "graph_edges").where("from_node LIKE 'region:%'")
    return graphs.canonical_rows(nodes, edges.unionByName(edges.withColumn("type", F.lit("also"))))


def gr15_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the graph and one with a changed supplier, found by their digests."""
    now = view(spark, sf_dir, "graph_edges")
    fresh = spark.createDataFrame([("supplier:1", "part:fresh", "imports")], "from_node string, to_node string, type string")
    then = now.where("from_node <> 'supplier:1' OR to_node LIKE '%7'").unionByName(fresh)
    trees = [checkpointed(digest.tree(e)) for e in (now, then)]
    return digest.difference(now, then, digest.changed(*trees)[0])


def gr11_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the links of suppliers' notes to parts' files."""
    files = raw(spark, sf_dir, "part").select(F.concat(F.lit("docs/p"), "p_partkey", F.lit(".md")).alias("path"))
    texts = raw(spark, sf_dir, "supplier").select(F.concat(F.lit("notes/s"), "s_suppkey", F.lit(".md")).alias("source"), F.concat(F.lit("See [a](docs/p"), "s_suppkey", F.lit(".md#x), [[docs/p"), F.col("s_suppkey") + 1, F.lit("]] and [a](./docs/p"), "s_suppkey", F.lit(".md), https://e.org/p1.md")).alias("text"))
    links = texts.select("source", F.explode(enrichment.link_targets(F.col("text"))).alias("target"))
    return paths.resolve_links(links.select(F.struct("source", "target").alias("ref"), "target"), files).select(F.col("ref.source").alias("from_node"), F.col("path").alias("to_node"), F.lit("references").alias("type")).distinct()


def fn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("getPart"), "p_size", F.lit("_HTTPName-")).alias("name"), F.concat(F.lit("## `Part` ["), "p_partkey", F.lit("](x.md) ")).alias("line"))
    return rows.select("p_partkey", words.term(F.col("name")).alias("term"), words.slug(F.col("name")).alias("slug"), words.without_markup(F.col("line")).alias("line"))


SQL = {
    "fp16_repairs": "SELECT 'file:' || doc_id AS artifact_id, (['no state', 'other content', 'no node', 'not indexed', 'chunks missing'])[doc_id % 7 + 1] AS reason FROM documents WHERE doc_id % 7 < 5",
    "vx11_changes": "SELECT a.r_regionkey AS a, b.r_regionkey AS b, CASE WHEN a.r_regionkey = b.r_regionkey THEN 'none' WHEN b.r_regionkey = 1 THEN 'disabled' WHEN a.r_regionkey < 2 THEN 'introduced' ELSE 'invalidated' END AS change FROM region a JOIN region b ON b.r_regionkey > 0",
    "sc26_files": "SELECT 'm/' || p_partkey || '.png' AS path, CASE WHEN p_partkey % 3 = 0 THEN '3: ' || p_partkey WHEN p_partkey % 5 = 0 THEN '5: ' || p_partkey WHEN p_partkey % 2 = 0 THEN '2: ' || p_partkey ELSE '' END AS text FROM part",
    "tx14_candidates": r"SELECT DISTINCT node_id FROM graph_nodes WHERE regexp_matches(' ' || regexp_replace(lower(concat_ws(' ', label, type)), '[^\p{L}\p{N}_]+', ' ', 'g'), ' (nation|supplier)') ORDER BY node_id LIMIT 2000",
    "tx7_preferred": "SELECT doc_id, round(greatest(CAST(0.25 AS DOUBLE), 1.2 - 0.35 * (CAST(contains(p, 'en/') AS INT) + CAST(contains(p, 'src1') AS INT) + CAST(contains(p, 'src') AS INT))), 6) AS prior FROM (SELECT doc_id, lower(concat_ws('/', lang, source)) AS p FROM documents) d",
    "rf3_records": """SELECT doc_id AS key, CASE WHEN m = 0 THEN 'relationship' WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'chunk' ELSE 'node' END AS kind, CASE WHEN m = 0 THEN 'g' WHEN doc_id % 2 = 0 THEN 't' WHEN doc_id % 3 = 0 THEN 'v' ELSE 'n' END || doc_id AS title,
        CASE WHEN m = 0 THEN 'graph' WHEN doc_id % 2 = 0 THEN 'text' WHEN doc_id % 3 = 0 THEN 'vector' ELSE 'graph' END AS arm FROM (SELECT doc_id, doc_id % 5 AS m FROM documents) d WHERE m < 3 OR doc_id % 2 = 0 OR doc_id % 3 = 0""",
    "gr15_node_link": """SELECT 'nodes' AS part, 'region:' || r_regionkey AS id, '' AS target, 0 AS "key", '{"id":"region:' || r_regionkey || '","label":"' || r_name || '","type":"region"}' AS data FROM region
        UNION ALL SELECT 'nodes', 'nation:' || n_nationkey, '', 0, '{"id":"nation:' || n_nationkey || '","label":"' || n_name || '","type":"nation"}' FROM nation
        UNION ALL SELECT 'links', 'region:' || n_regionkey, 'nation:' || n_nationkey, k, '{"key":' || k || ',"source":"region:' || n_regionkey || '","target":"nation:' || n_nationkey || '","type":"' || t || '"}' FROM nation CROSS JOIN (VALUES (0, 'also'), (1, 'contains')) v(k, t)""",
    "gr15_difference": """SELECT from_node, to_node, type, 'removed' AS op FROM graph_edges WHERE from_node = 'supplier:1' AND to_node NOT LIKE '%7'
        UNION ALL SELECT 'supplier:1', 'part:fresh', 'imports', 'added'""",
    "gr11_references": "SELECT 'notes/s' || s_suppkey || '.md' AS from_node, 'docs/p' || p_partkey || '.md' AS to_node, 'references' AS type FROM supplier JOIN part ON p_partkey IN (s_suppkey, s_suppkey + 1)",
    "fn_words": "SELECT p_partkey, 'get part' || p_size || ' httpname item' AS term, 'getpart' || p_size || '_httpname' AS slug, 'Part ' || p_partkey AS line FROM part",
}
SQL = {name: duck_sql(sql) for name, sql in SQL.items()}

QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
