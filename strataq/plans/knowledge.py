"""Queries of path, steering, memory and graph-search operators, with SQL that is written apart from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.corpus import duck_sql, raw, view
from strataq.operators import chunking, enrichment, graph, paths, policy, steering
from strataq.sources import report

_ODD = ("/.env", "/keys/id_rsa.pub", "/node_modules/x/index.js", "/src/app.PY", "/docs/guide.md", "/media/a.b.PNG", "/build", "/.md")


def odd_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path): paths of documents, with endings of many kinds."""
    ending = F.element_at(F.array(*[F.lit(x) for x in _ODD]), (F.col("doc_id") % len(_ODD) + 1).cast("int"))
    return raw(spark, sf_dir, "documents").select("doc_id", F.concat("source", ending).alias("path"))


_ODD_SQL = "SELECT doc_id, source || (['" + "', '".join(_ODD) + f"'])[CAST(doc_id % {len(_ODD)} AS INT) + 1] AS path FROM documents"


def fp1_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "artifacts").select("doc_id", "relative_path")
    return rows.where(paths.selected(F.col("relative_path"), ["en/**", "*/src[1-3]/doc_?.md"], ["**/src7/**", "*_1*.md"])).select("doc_id")


def fp3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_paths(spark, sf_dir).where(paths.matches_any(F.col("path"), [*paths.NOISE, *paths.SECRETS])).select("doc_id")


def sc2_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return odd_paths(spark, sf_dir).select(folder.alias("dir")).distinct().where(paths.prunable(F.col("dir"), [*paths.NOISE, "src1*/**"]))


def fp17_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = paths.kind_of(F.col("path"), F.when(F.col("doc_id") % 10 == 9, "memory"))
    return odd_paths(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").select(F.concat(F.lit("lib/p"), F.col("p_size"), F.lit("/m"), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "/__init__.py").when(F.col("p_partkey") % 3 == 1, ".py").otherwise(".md")).alias("path"))


_FILES_SQL = "SELECT 'lib/p' || p_size || '/m' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '/__init__.py' WHEN 1 THEN '.py' ELSE '.md' END AS path FROM part"


def j12_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"), F.concat(F.lit("./m"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, ".py").otherwise(".md")).alias("target"))
    return paths.resolve_references(refs, _files(spark, sf_dir))


def j13_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.concat(F.lit("p"), F.col("p_size"), F.lit(".m"), F.col("p_partkey")).alias("target"))
    return paths.resolve_imports(refs, _files(spark, sf_dir))


def j14_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat(F.when(F.col("p_partkey") % 2 == 0, "../lib/p").otherwise("p"), F.col("p_size"), F.lit("/m"), F.col("p_partkey"))
    refs = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.concat(place, F.when(F.col("p_partkey") % 5 == 0, "?x#y").when(F.col("p_partkey") % 5 == 1, ".md#top").otherwise("#top")).alias("target"))
    return paths.resolve_links(refs, _files(spark, sf_dir))


def tm17_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("alias", "preference", "exclusion", "fact")]), (F.col("turn") % 4 + 1).cast("int"))
    texts = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("`Svc"), "conv_id", F.lit("` => a; B,\"b\"\nmore -> x"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("When: q1, Q2 -> prefer: docs/"), "conv_id")).otherwise(F.concat(F.lit("so never: tmp/"), "conv_id", F.lit(", TMP ;")))
    rows = raw(spark, sf_dir, "conversations").select("conv_id", "turn", kinds.alias("kind"), texts.alias("text"))
    rule = F.col("rule")
    return steering.parse_rules(rows).where("rule IS NOT NULL").select("conv_id", "turn", rule["type"].alias("type"), F.array_join(rule["triggers"], "|").alias("triggers"), F.array_join(rule["values"], "|").alias("values"))


def tm15_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steering.merge_candidates(view(spark, sf_dir, "memory_records").withColumn("subject", F.when(F.col("conv_id") % 7 > 0, F.concat_ws("-", "conv_id", "written_by"))))


def tm10_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.folded(view(spark, sf_dir, "memory_records"))


def tm4_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [None, "OFF ", "nonsense", {"mode": "only", "scopes": "org", "tiers": ["cold"]}, {"as_of": "2024-01-01T00:00:00Z", "current_only": False}, 7]
    parsed = [policy.MemoryPolicy.parse(x) for x in given]
    return spark.createDataFrame([(i, p.mode, "|".join(p.scopes), p.as_of, p.current_only, "|".join(p.allowed_tiers())) for i, p in enumerate(parsed)], "i int, mode string, scopes string, as_of string, current_only boolean, tiers string")


_PLAN = "opening words\n\n# Plan {n}\n\nPart IV\nGeneral Terms\nArticle 2: Scope\nbody of it.\n1. Aims\n1.1 Details\n(h) eighth\n(i) ninth\n(ii) second\n1.2 More\nFINAL RULES\n1. Not a title because it ends so."


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a document with headings of all families for each nation."""
    return raw(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.replace(F.lit(_PLAN), F.lit("{n}"), F.col("n_name")).alias("text"))


def tg4_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.headings(plans(spark, sf_dir))


def tg8_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.outline(plans(spark, sf_dir)).select("doc_id", "line", F.array_join(F.transform("ordinal", lambda x: x.cast("string")), ".").alias("ordinal"), "parent", "path")


def tg18_heading_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.heading_edges(chunking.outline(plans(spark, sf_dir)))


def tg2_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_chunks(plans(spark, sf_dir)).select("doc_id", "chunk_index", "start_line", F.length("chunk").alias("n"))


_NOTE = "See [guide](docs/a.md 'A') and [[Notes|n]], [x](https://e.org/p) or https://e.org/q?{n}. As in [@Knuth84], [knuth84] and [v1.2.3], [ab]; [Smith:2001](y)."


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "supplier").select("s_suppkey", F.replace(F.lit(_NOTE), F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("text"))


def tg14_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("s_suppkey", F.posexplode(enrichment.link_targets(F.col("text"))).alias("place", "target"))


def tg15_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("s_suppkey", F.explode(enrichment.citations(F.col("text"))).alias("citation"))


def tg13_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and citations of real texts and pages, by kind."""
    texts = raw(spark, sf_dir, "documents").select("text").unionByName(raw(spark, sf_dir, "pages").select(F.col("html").alias("text"))).unionByName(notes(spark, sf_dir).select("text"))
    found = texts.select(F.size(enrichment.link_targets(F.col("text"))).alias("links"), F.size(enrichment.citations(F.col("text"))).alias("cited"))
    return found.agg(F.count("*").alias("texts"), F.sum("links").alias("links"), F.sum("cited").alias("cited"))


def sk11_node_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded part of the graph with totals: links of the first 40 nodes, with whether there are more."""
    nodes = view(spark, sf_dir, "graph_nodes").where("type IN ('region', 'nation', 'customer')")
    _, links, totals = report.node_link(nodes, view(spark, sf_dir, "graph_edges"), 40, 20, exclude_types=["customer"])
    return links.crossJoin(F.broadcast(totals.select("truncated")))


def sk12_cytoscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cytoscape(view(spark, sf_dir, "graph_nodes"), view(spark, sf_dir, "graph_edges").distinct())


_OUTLINE = """(VALUES (3, 1, 'markdown', '', 'Plan', '', NULL, '*'), (5, 1, 'keyword', 'IV', 'General Terms', '4', NULL, 'General Terms'), (7, 3, 'keyword', '2', 'Scope', '2', 5, 'General Terms > Scope'),
    (9, 1, 'numbered', '1', 'Aims', '1', NULL, 'Aims'), (10, 2, 'numbered', '1.1', 'Details', '1.1', 9, 'Aims > Details'), (11, 6, 'lettered', 'h', 'eighth', '8', 10, 'Aims > Details > eighth'),
    (12, 6, 'lettered', 'i', 'ninth', '9', 10, 'Aims > Details > ninth'), (13, 6, 'lettered', 'ii', 'second', '2', 10, 'Aims > Details > second'), (14, 2, 'numbered', '1.2', 'More', '1.2', 9, 'Aims > More'),
    (15, 1, 'caps', '', 'FINAL RULES', '', NULL, 'FINAL RULES')) v(line, level, kind, number, title, ordinal, parent, path)"""
_TOKENS, _QUERY = ["asia", "contains"], "asia contains"


def gr8_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.match_relationships(view(spark, sf_dir, "graph_nodes"), view(spark, sf_dir, "graph_edges"), _TOKENS, _QUERY)
    return found.select("from_node", "to_node", "score", "title")


def gr9_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.search(view(spark, sf_dir, "graph_nodes"), view(spark, sf_dir, "graph_edges"), ["america", "asia"], "asia", 12)


def w8_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.facts(view(spark, sf_dir, "graph_nodes"), view(spark, sf_dir, "graph_edges"), ["supplier:1", "supplier:2", "supplier:1", "supplier:3"], 8)


def w11_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fill_budget(raw(spark, sf_dir, "documents").where("text IS NOT NULL"), "source", "doc_id", "n_chars", "doc_id", 20_000).select("source", F.col("doc_id").cast("long").alias("doc_id"), "place")


def _ladder(text: str, exact: float, every: float, some: float, query: str = _QUERY, other: str = "contains") -> str:
    low = f"lower(coalesce({text}, ''))"
    return f"CASE WHEN {low} = '' THEN 0 WHEN {low} = '{query}' THEN {exact} WHEN contains({low}, '{query}') THEN {(exact + every) / 2} WHEN contains({low}, 'asia') AND contains({low}, '{other}') THEN {every} WHEN contains({low}, 'asia') OR contains({low}, '{other}') THEN {some} ELSE 0 END"


def _relationships_sql(query: str, other: str) -> str:
    best = ", ".join(_ladder(c, *w, query, other) for c, w in (("e.type", (0.65, 0.55, 0.45)), ("a.label", (0.5, 0.4, 0.3)), ("b.label", (0.5, 0.4, 0.3))))
    return f"SELECT * FROM (SELECT from_node, to_node, e.type, round(CAST(greatest({best}) AS DOUBLE), 3) AS score, a.label || ' —' || e.type || '→ ' || b.label AS title FROM graph_edges e JOIN graph_nodes a ON a.node_id = e.from_node JOIN graph_nodes b ON b.node_id = e.to_node) r WHERE score > 0"


SQL = {
    "fp1_glob": duck_sql("SELECT doc_id FROM artifacts WHERE (relative_path LIKE 'en/%' OR regexp_full_match(relative_path, '.*/src[1-3]/doc_.\\.md')) AND NOT contains('/' || relative_path, '/src7/') AND NOT regexp_full_match(relative_path, '.*_1.*\\.md')"),
    "fp3_secrets": f"SELECT doc_id FROM ({_ODD_SQL}) t WHERE doc_id % {len(_ODD)} IN (0, 1, 2)",
    "sc2_prunable": f"SELECT DISTINCT dir FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ({_ODD_SQL}) t) d WHERE contains(dir || '/', '/node_modules/') OR starts_with(dir, 'src1')",
    "fp17_kinds": "SELECT CASE WHEN doc_id % 10 = 9 THEN 'memory_record' WHEN doc_id % 8 = 4 THEN 'markdown_note' WHEN doc_id % 8 = 5 THEN 'image' ELSE 'file' END AS kind, count(*) AS n FROM documents GROUP BY 1",
    "j12_references": f"SELECT s_suppkey AS ref, path FROM supplier JOIN ({_FILES_SQL}) f ON ends_with(path, '/m' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.md' END)",
    "j13_imports": f"SELECT p_partkey AS ref, path FROM part JOIN ({_FILES_SQL}) f ON path IN ('lib/p' || p_size || '/m' || p_partkey || '.py', 'lib/p' || p_size || '/m' || p_partkey || '/__init__.py')",
    "j14_links": f"SELECT p_partkey AS ref, path FROM part JOIN ({_FILES_SQL}) f ON path = 'lib/p' || p_size || '/m' || p_partkey || '.md' WHERE p_partkey % 2 = 0 OR p_partkey % 5 = 1",
    "tm17_rules": """SELECT conv_id, turn, (['alias', 'preference', 'exclusion'])[turn % 4 + 1] AS type, CASE turn % 4 WHEN 0 THEN 'svc' || conv_id WHEN 1 THEN 'q1|q2' ELSE '' END AS triggers,
        CASE turn % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'docs/' || conv_id ELSE 'tmp/' || conv_id || '|tmp' END AS "values" FROM conversations WHERE turn % 4 < 3""",
    "tm4_policies": "SELECT * FROM (VALUES (0, 'auto', '', '', true, 'hot'), (1, 'off', '', '', true, 'hot'), (2, 'auto', '', '', true, 'hot'), (3, 'only', 'org', '', true, 'cold'), (4, 'auto', '', '2024-01-01T00:00:00Z', false, 'hot|cold'), (5, 'auto', '', '', true, 'hot')) t(i, mode, scopes, as_of, current_only, tiers)",
    "tg14_links": "SELECT s_suppkey, CAST(place AS INTEGER) AS place, replace(target, '{n}', CAST(s_suppkey AS STRING)) AS target FROM supplier CROSS JOIN (VALUES (0, 'docs/a.md'), (1, 'https://e.org/p'), (2, 'y'), (3, 'Notes'), (4, 'https://e.org/q?{n}.')) v(place, target)",
    "tg15_citations": "SELECT s_suppkey, citation FROM supplier CROSS JOIN (VALUES ('guide'), ('Knuth84'), ('Smith:2001')) v(citation)",
    "sk11_node_link": duck_sql("SELECT from_node, to_node, type, true AS truncated FROM (SELECT DISTINCT from_node, to_node, type FROM graph_edges WHERE from_node LIKE 'region:%' AND to_node LIKE 'nation:%') e ORDER BY from_node, to_node, type LIMIT 20"),
    "sk12_cytoscape": duck_sql("""SELECT 'nodes' AS "group", CAST(to_json(struct_pack(id := node_id, label := label, type := type)) AS VARCHAR) AS data FROM graph_nodes
        UNION ALL SELECT 'edges', CAST(to_json(struct_pack(id := from_node || '|' || type || '|' || to_node, source := from_node, target := to_node, type := type)) AS VARCHAR) FROM (SELECT DISTINCT from_node, to_node, type FROM graph_edges) e"""),
    "tg4_headings": f"SELECT n_nationkey AS doc_id, line, level, kind, number, title || CASE WHEN kind = 'markdown' THEN ' ' || n_name ELSE '' END AS title FROM nation CROSS JOIN {_OUTLINE}",
    "tg8_outline": f"SELECT n_nationkey AS doc_id, line, ordinal, parent, CASE WHEN path = '*' THEN 'Plan ' || n_name ELSE path END AS path FROM nation CROSS JOIN {_OUTLINE}",
    "tg18_heading_edges": f"SELECT CASE WHEN parent IS NULL THEN 'file:' || n_nationkey ELSE 'heading:' || n_nationkey || ':' || parent END AS from_node, 'heading:' || n_nationkey || ':' || line AS to_node, CASE WHEN parent IS NULL THEN 'has_heading' ELSE 'contains' END AS type FROM nation CROSS JOIN {_OUTLINE}",
    "tg2_section_chunks": "SELECT n_nationkey AS doc_id, i AS chunk_index, line AS start_line, n + CASE WHEN i = 1 THEN length(n_name) ELSE 0 END AS n FROM nation CROSS JOIN (VALUES (0, 1, 13), (1, 3, 7), (2, 5, 21), (3, 7, 28), (4, 9, 7), (5, 10, 11), (6, 11, 10), (7, 12, 9), (8, 13, 11), (9, 14, 8), (10, 15, 46)) v(i, line, n)",
    "tm15_candidates": duck_sql(r"""WITH r AS (SELECT record_id, scope, CASE WHEN conv_id % 7 > 0 THEN conv_id || '-' || written_by END AS subject, kind, CASE WHEN scope = 'org' THEN '*' ELSE coalesce(written_by, '') END AS acl, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')) AS words
            FROM memory_records WHERE kind NOT IN ('alias', 'preference', 'exclusion') AND coalesce(tier, '') IN ('', 'hot') AND conv_id % 7 > 0),
        s AS (SELECT scope, subject, kind, acl, count(*) AS size FROM r GROUP BY ALL HAVING count(*) >= 3),
        m AS (SELECT x.scope, x.subject, x.kind, x.acl, avg(CASE WHEN len(x.words) + len(y.words) = 0 THEN 1.0 ELSE len(list_intersect(x.words, y.words)) / CAST(len(list_distinct(list_concat(x.words, y.words))) AS DOUBLE) END) AS j
            FROM r x JOIN r y ON x.scope = y.scope AND x.subject = y.subject AND x.kind = y.kind AND x.acl = y.acl AND x.record_id < y.record_id GROUP BY ALL)
        SELECT s.*, round(j, 6) AS mean_jaccard FROM s JOIN m ON m.scope = s.scope AND m.subject = s.subject AND m.kind = s.kind AND m.acl = s.acl WHERE round(j, 6) <= 0.55"""),
    "gr8_relationships": duck_sql(f"SELECT from_node, to_node, score, title FROM ({_relationships_sql(_QUERY, 'contains')}) t"),
    "gr9_graph_search": duck_sql(f"""WITH n AS (SELECT node_id, label, CAST(greatest({_ladder('label', 1.0, 0.9, 0.6, 'asia', 'america')}, CASE WHEN regexp_matches(lower(type), 'america|asia') THEN 0.5 ELSE 0 END) AS DOUBLE) AS score FROM graph_nodes),
        b AS (SELECT DISTINCT * FROM (SELECT * FROM n WHERE score > 0 ORDER BY score DESC, label, node_id LIMIT 12) x), r AS (SELECT DISTINCT * FROM ({_relationships_sql('asia', 'america')}) y ORDER BY score DESC, title, from_node, to_node, type LIMIT 12),
        u AS (SELECT 0 AS part, 'node' AS kind, node_id AS key, label AS title, score FROM b UNION ALL SELECT 1, 'relationship', from_node || ' ' || type || ' ' || to_node, title, score FROM r)
        SELECT CAST(row_number() OVER (ORDER BY part, score DESC, title, key) AS INTEGER) AS rank, kind, key, title, score FROM u ORDER BY part, score DESC, title, key LIMIT 12"""),
    "w8_facts": duck_sql("""WITH RECURSIVE c AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY o) AS d, o FROM (SELECT DISTINCT l_suppkey AS s, 'part:' || CAST(l_partkey AS STRING) AS o FROM lineitem WHERE l_suppkey IN (1, 2, 3)) x),
        g AS (SELECT *, row_number() OVER (ORDER BY d, s) AS n FROM c WHERE d <= 32),
        w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRING[]) AS used, CAST([] AS BIGINT[]) AS by_s, CAST(NULL AS STRING) AS o, CAST(NULL AS BIGINT) AS s
            UNION ALL SELECT g.n, CASE WHEN ok THEN list_append(used, g.o) ELSE used END, CASE WHEN ok THEN list_append(by_s, g.s) ELSE by_s END, CASE WHEN ok THEN g.o END, CASE WHEN ok THEN g.s END
            FROM w JOIN g ON g.n = w.n + 1, LATERAL (SELECT NOT list_contains(used, g.o) AND len(list_filter(by_s, lambda x: x = g.s)) < 3 AND len(used) < 8 AS ok) k)
        SELECT 'supplier:' || CAST(s AS STRING) AS subject, 'references' AS edge_type, o AS object, 1 AS rank FROM w WHERE o IS NOT NULL"""),
    "w11_budget": """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL),
        w AS (SELECT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS spent, CAST(-1 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS doc_id FROM d WHERE n = 1
            UNION ALL SELECT d.source, d.n, CASE WHEN spent + n_chars <= 20000 THEN spent + n_chars ELSE spent END, CASE WHEN spent + n_chars <= 20000 THEN place + 1 ELSE place END, CASE WHEN spent + n_chars <= 20000 THEN d.doc_id END
            FROM w JOIN d ON d.source = w.source AND d.n = w.n + 1)
        SELECT source, doc_id, CAST(place AS INTEGER) AS place FROM w WHERE doc_id IS NOT NULL""",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.split("_")[0][-1:].isdigit() and callable(f)}
