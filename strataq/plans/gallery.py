"""Queries that are one statement for both engines: scans, predicates, joins, aggregates, windows, sets, SQL surface."""

from __future__ import annotations

#: name -> statement. Names begin with the operator's id in the inventory.
STATEMENTS: dict[str, str] = {
    # Scans and sources
    "sc2_prune_directories": "SELECT relative_path FROM artifacts WHERE NOT (relative_path || '/' LIKE 'fr/%' OR relative_path LIKE '%/src1/%')",
    "sc3_walk_budget": "SELECT relative_path, size_bytes FROM (SELECT relative_path, size_bytes, sum(size_bytes) OVER (PARTITION BY lang ORDER BY relative_path ROWS UNBOUNDED PRECEDING) AS total FROM artifacts) t WHERE total <= 200000",
    "sc4_scan_top_subtrees": "SELECT split_part(relative_path, '/', 1) AS top_dir, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM artifacts GROUP BY split_part(relative_path, '/', 1) ORDER BY bytes DESC, top_dir LIMIT 20",
    "sc4_scan_depths": "SELECT length(relative_path) - length(replace(relative_path, '/', '')) AS depth, count(*) AS files FROM artifacts GROUP BY length(relative_path) - length(replace(relative_path, '/', ''))",
    "sc6_web_collection": "SELECT page_id, url, @SHA(html) AS etag, CAST(strlen(html) AS BIGINT) AS size_bytes FROM pages WHERE url LIKE 'http://%' OR url LIKE 'https://%'",
    "sc7_api_items": "SELECT event_id AS item_id, @JSON(props, '$.k') AS content, @SHA(props) AS sha256 FROM events WHERE props IS NOT NULL",
    "sc10_channel_history": "SELECT conv_id, @AGG(role || ': ' || text; '\n'; turn) AS transcript FROM conversations WHERE role <> 'system' GROUP BY conv_id",
    "sc17_parquet_views": "SELECT count(*) AS n, count(DISTINCT source) AS sources FROM documents",
    "sc19_keyset_page": "SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50",
    "sc20_graph_rows": "SELECT node_id, type, '{\"label\":\"' || label || '\"}' AS attributes FROM graph_nodes",
    "sc22_memory_scan": "SELECT record_id, scope, kind, asserted_at, text FROM memory_records WHERE record_id LIKE 'mem-%'",
    "sc23_event_log": "SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM events ORDER BY ts, event_id",
    "sc25_group_directory": "SELECT 'user:' || CAST(c_custkey AS STRING) AS principal, @AGG(grp; ','; grp) AS groups FROM (SELECT DISTINCT c_custkey, 'group:' || c_mktsegment AS grp FROM customer UNION SELECT o_custkey, 'group:' || o_orderpriority FROM orders) m GROUP BY c_custkey",
    "sc26_sidecars": "SELECT d.doc_id, coalesce(b.text, d.text) AS content FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id",
    "sc27_resolve_target": "SELECT page_id, CASE WHEN url LIKE '%.git' THEN 'git' WHEN url LIKE 's3://%' THEN 's3' WHEN url LIKE 'http%' THEN 'web_collection' ELSE 'path' END AS kind FROM pages",
    # Document decoders that plain functions express
    "dx8_html_text": "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g')) AS text FROM pages",
    "dx9_tidy": "SELECT page_id, regexp_replace(regexp_replace(replace(html, chr(13), ''), '[ \t]+', ' ', 'g'), '\n\n\n+', '\n\n', 'g') AS text FROM pages",
    # Sinks as relations
    "sk1_export_counts": "SELECT 'artifacts' AS table_name, count(*) AS n FROM artifacts UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'memory_records', count(*) FROM memory_records UNION ALL SELECT 'graph_nodes', count(*) FROM graph_nodes UNION ALL SELECT 'graph_edges', count(*) FROM graph_edges",
    "sk6_artifact_upsert": "WITH fresh AS (SELECT id, 'new' || sha256 AS sha256 FROM artifacts WHERE doc_id % 10 = 0) SELECT a.id, a.sha256 FROM artifacts a WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.id = a.id) UNION ALL SELECT id, sha256 FROM fresh",
    "sk7_terms_first_wins": "SELECT node_id, term FROM (SELECT lang AS node_id, lower(source) AS term, row_number() OVER (PARTITION BY lang, lower(source) ORDER BY doc_id) AS r FROM documents) t WHERE r = 1",
    "sk8_projection_rebuild": "SELECT n.record_id, n.scope, coalesce(o.uses, 0) AS uses, coalesce(o.observations, 1) AS observations FROM memory_records n LEFT JOIN (SELECT * FROM memory_records WHERE turn % 2 = 0) o ON n.record_id = o.record_id",
    "sk9_cascade_delete": "SELECT c.id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.id = c.artifact_id AND a.source_id = 'source:kb:src0')",
    "sk10_snapshot_retention": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r, sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders) t WHERE total <= 1000000 OR r = 1",
    "sk17_migration_verify": "SELECT a.n AS source_rows, b.n AS target_rows, a.n = b.n AS verified FROM (SELECT count(*) AS n FROM documents) a CROSS JOIN (SELECT count(*) AS n FROM chunks) b",
    "sk19_events_newest": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40",
    # Row generators
    "tg4_markdown_headings": "SELECT doc_id, pos, regexp_extract(line, '^(#+) +(.*)$', 2) AS title, length(regexp_extract(line, '^(#+) +(.*)$', 1)) AS level FROM (SELECT doc_id, CAST(i AS BIGINT) AS pos, @SPLIT(text, chr(10))[CAST(i AS INT) @BASE] AS line FROM (SELECT doc_id, text, @UNNEST(@SEQ(1, @SIZE(@SPLIT(text, chr(10))))) AS i FROM documents) s) t WHERE line LIKE '#%'",
    "tg11_frontmatter": "SELECT doc_id, CAST(length(regexp_replace('---' || chr(10) || 'id: 1' || chr(10) || '---' || chr(10) || text, '^---\n[^\n]*\n---\n', '')) AS BIGINT) AS n FROM documents",
    "tg13_urls": "SELECT page_id, count(*) AS n_links FROM (SELECT page_id, @UNNEST(@DISTINCT(@FIND(html, 'https?://[^ )>\"<]+', 0))) AS link FROM pages) t GROUP BY page_id",
    "tg16_entities": "SELECT entity, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, @UNNEST(@DISTINCT(@FIND(text, '[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3}', 0))) AS entity FROM documents) t GROUP BY entity",
    "tg17_directory_chain": "SELECT DISTINCT d, length(d) - length(replace(d, '/', '')) AS depth FROM (SELECT lang AS d FROM documents UNION ALL SELECT lang || '/' || source FROM documents) t",
    "tg19_artifact_edges": "SELECT source_id AS from_node, id AS to_node, 'contains' AS type FROM artifacts UNION ALL SELECT artifact_id, id, 'has_chunk' FROM chunks",
    # Predicates
    "fp1_glob_include": "SELECT relative_path FROM artifacts WHERE regexp_matches(relative_path, '^en/.*[.]md$') AND NOT regexp_matches(relative_path, '^.*/src2/.*$')",
    "fp2_max_depth": "SELECT relative_path FROM artifacts WHERE length(relative_path) - length(replace(relative_path, '/', '')) <= 2",
    "fp3_secret_excludes": "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '([.]env|id_rsa|[.]pem|[.]key|/[.]git/)')",
    "fp4_source_filter": "SELECT id FROM chunks WHERE source_id = 'source:kb:src1'",
    "fp5_section_filter": "SELECT id FROM chunks WHERE position('f' IN lower(coalesce(heading_path, ''))) > 0",
    "fp9_may_filter": "SELECT max(CASE WHEN valid_until <> '' OR tier = 'cold' OR kind IN ('alias', 'preference') THEN 1 ELSE 0 END) AS may_filter FROM memory_records",
    "fp11_acl_normalize": "SELECT doc_id, CASE WHEN acl IS NULL OR acl = '' THEN NULL WHEN @JSON(acl, '$.public') = 'true' THEN 'public' ELSE 'restricted' END AS acl_class FROM artifacts",
    "fp13_steering_exclusion": "SELECT relative_path FROM artifacts WHERE NOT position('src3/' IN lower(relative_path)) > 0",
    "fp14_fast_reject": "SELECT node_id FROM graph_nodes WHERE regexp_matches(lower(label), '(steel|brass|asia)')",
    "fp15_cdc_skip": "WITH before AS (SELECT relative_path, sha256 FROM artifacts WHERE doc_id % 3 <> 0), now AS (SELECT relative_path, CASE WHEN doc_id % 4 = 0 THEN 'x' || sha256 ELSE sha256 END AS sha256 FROM artifacts) SELECT n.relative_path FROM now n WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.relative_path = n.relative_path AND b.sha256 = n.sha256)",
    "fp16_needs_repair": "WITH have AS (SELECT artifact_id, count(*) AS n FROM chunks WHERE doc_id % 6 <> 0 GROUP BY artifact_id) SELECT a.id, CASE WHEN h.n IS NULL THEN 'missing_chunks' WHEN a.size_bytes > 20000 AND h.n < 2 THEN 'too_few_chunks' ELSE 'ok' END AS state FROM artifacts a LEFT JOIN have h ON h.artifact_id = a.id",
    "fp17_classify": "SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'document' WHEN url LIKE '%.png' OR url LIKE '%.jpg' THEN 'image' WHEN url LIKE '%.mp3' THEN 'audio' ELSE 'file' END AS artifact_type FROM pages",
    "fp18_fetchable": "SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) IN ('http', 'https') AS fetchable FROM pages",
    "fp20_vocabulary_filter": "SELECT w, count(*) AS n FROM (SELECT @UNNEST(@SPLIT(lower(text), ' ')) AS w FROM documents) t WHERE length(w) > 3 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ('this', 'that', 'with', 'from') GROUP BY w HAVING count(*) > 20",
    # Joins
    "j1_chunks_artifacts": "SELECT c.id, a.relative_path, s.name FROM chunks c JOIN artifacts a ON a.id = c.artifact_id JOIN sources s ON s.id = c.source_id",
    "j2_left_memory": "SELECT c.id, m.record_id FROM chunks c LEFT JOIN memory_records m ON m.conv_id = c.doc_id AND m.turn = 0 WHERE m.record_id IS NULL OR m.tier <> 'cold'",
    "j3_terms_match": "SELECT q.term, count(DISTINCT t.doc_id) AS df FROM (SELECT 'the' AS term UNION ALL SELECT 'der' UNION ALL SELECT 'zzzz') q LEFT JOIN (SELECT doc_id, @UNNEST(@SPLIT(lower(text), ' ')) AS w FROM documents) t ON t.w = q.term GROUP BY q.term",
    "j4_cross_one_row": "SELECT r_name, x.n FROM region CROSS JOIN (SELECT count(*) AS n FROM nation) x",
    "j5_chunk_counts": "SELECT a.id, count(c.id) AS n FROM artifacts a LEFT JOIN (SELECT * FROM chunks WHERE doc_id % 2 = 0) c ON c.artifact_id = a.id GROUP BY a.id",
    "j6_source_rollup": "SELECT k.kb, count(s.id) AS sources, CAST(sum(s.n_files) AS BIGINT) AS files FROM (SELECT 'kb' AS kb UNION ALL SELECT 'empty') k LEFT JOIN sources s ON s.knowledge_base_id = k.kb GROUP BY k.kb",
    "j7_rule_texts": "SELECT subject, @AGG(text; ' '; record_id) AS rules FROM memory_records WHERE kind <> 'fact' GROUP BY subject",
    "j8_vector_hits": "SELECT e.vec_id, c.id FROM embeddings e JOIN chunks c ON c.doc_id = e.vec_id JOIN artifacts a ON a.id = c.artifact_id",
    "j9_correlated_concat": "SELECT n.n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers, (SELECT max(s.s_name) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS last_supplier FROM nation n",
    "j12_suffix_match": "WITH targets AS (SELECT id, relative_path FROM artifacts), suffixes AS (SELECT id, relative_path AS suffix FROM targets UNION ALL SELECT id, split_part(relative_path, '/', 2) || '/' || split_part(relative_path, '/', 3) FROM targets UNION ALL SELECT id, split_part(relative_path, '/', 3) FROM targets), refs AS (SELECT doc_id, 'doc_' || CAST(doc_id + 1 AS STRING) || '.md' AS ref FROM documents) SELECT r.doc_id, s.id FROM refs r JOIN suffixes s ON s.suffix = r.ref",
    "j13_import_resolution": "WITH modules AS (SELECT 'pkg/' || lang || '/' || source || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path FROM documents), wanted AS (SELECT DISTINCT lang, source, 'pkg/' || lang || '/' || source AS base FROM documents) SELECT lang, source, path FROM (SELECT w.lang, w.source, m.path, row_number() OVER (PARTITION BY w.lang, w.source ORDER BY CASE WHEN m.path = w.base || '.py' THEN 0 ELSE 1 END) AS r FROM wanted w JOIN modules m ON m.path = w.base || '.py' OR m.path = w.base || '/__init__.py') t WHERE r = 1",
    "j14_link_resolution": "WITH links AS (SELECT page_id, regexp_replace(regexp_replace(url, '[#?].*$', ''), '^https?://', '') AS target FROM pages) SELECT l.page_id, p.page_id AS resolved FROM links l JOIN (SELECT page_id, regexp_replace(regexp_replace(url, '[#?].*$', ''), '^https?://', '') AS own FROM pages) p ON p.own = l.target",
    "j16_supersedes": "SELECT n.record_id AS newer, o.record_id AS older FROM memory_records n JOIN memory_records o ON n.supersedes = o.record_id",
    "j17_hit_resolution": "SELECT h.vec_id, coalesce(a.record_id, b.record_id) AS record_id FROM embeddings h LEFT JOIN (SELECT * FROM memory_records WHERE turn = 0) a ON a.conv_id = h.vec_id LEFT JOIN (SELECT * FROM memory_records WHERE turn = 1) b ON b.conv_id = h.vec_id",
    "j18_endpoint_labels": "SELECT coalesce(f.label, e.from_node) AS from_label, coalesce(t.label, e.to_node) AS to_label, e.type FROM graph_edges e LEFT JOIN graph_nodes f ON f.node_id = e.from_node LEFT JOIN graph_nodes t ON t.node_id = e.to_node WHERE e.type = 'contains'",
    "j19_both_endpoints": "SELECT e.from_node, e.to_node FROM graph_edges e WHERE e.from_node IN (SELECT node_id FROM graph_nodes WHERE type = 'nation') AND e.to_node IN (SELECT node_id FROM graph_nodes WHERE type = 'supplier')",
    "j20_stale_vectors": "SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.doc_id % 3 <> 0)",
    "j21_embed_missing": "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)",
    "j22_orphan_nodes": "SELECT n.node_id FROM graph_nodes n LEFT JOIN (SELECT DISTINCT node FROM (SELECT from_node AS node FROM graph_edges UNION ALL SELECT to_node AS node FROM graph_edges) b) e ON e.node = n.node_id WHERE e.node IS NULL",
    "j22_uncontained": "SELECT n.node_id FROM graph_nodes n LEFT JOIN (SELECT DISTINCT to_node FROM graph_edges WHERE type = 'contains') e ON e.to_node = n.node_id WHERE e.to_node IS NULL",
    "j23_dangling_keys": "SELECT count(*) AS dangling FROM chunks WHERE artifact_id NOT IN (SELECT id FROM artifacts)",
    "j24_cross_type_matrix": "SELECT f.type AS from_type, t.type AS to_type, count(*) AS n FROM graph_edges e JOIN graph_nodes f ON f.node_id = e.from_node JOIN graph_nodes t ON t.node_id = e.to_node WHERE f.type IS DISTINCT FROM t.type GROUP BY f.type, t.type",
    "j25_as_of_validity": "SELECT i.at, count(*) AS valid FROM (SELECT '2024-03-01T00:00:00Z' AS at UNION ALL SELECT '2024-06-01T00:00:00Z' UNION ALL SELECT '2024-12-01T00:00:00Z') i JOIN memory_records m ON (coalesce(m.valid_from, '') = '' OR m.valid_from <= i.at) AND (coalesce(m.valid_until, '') = '' OR m.valid_until > i.at) GROUP BY i.at",
    "j26_audit_four_way": "SELECT n.record_id, n.scope, o.scope AS old_scope, a.relative_path FROM memory_records n JOIN memory_records o ON n.supersedes = o.record_id JOIN chunks c ON c.doc_id = n.conv_id JOIN artifacts a ON a.id = c.artifact_id",
    "j27_source_types": "SELECT c.id, s.type FROM chunks c LEFT JOIN sources s ON s.id = c.source_id",
    "j28_acl_lookup": "SELECT e.vec_id, a.acl FROM embeddings e LEFT JOIN artifacts a ON a.doc_id = e.vec_id",
    # Aggregations
    "ag1_files_per_source": "SELECT source_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM artifacts GROUP BY source_id",
    "ag2_files_per_directory": "SELECT coalesce(nullif(regexp_extract(relative_path, '^([^/]+)/', 1), ''), '.') AS dir, count(*) AS n FROM artifacts GROUP BY coalesce(nullif(regexp_extract(relative_path, '^([^/]+)/', 1), ''), '.')",
    "ag3_duplicate_content": "SELECT sha256, count(*) AS n, @AGG(relative_path; ', '; relative_path) AS paths FROM artifacts GROUP BY sha256 HAVING count(*) > 1",
    "ag4_tokens_per_file": "SELECT a.relative_path, count(*) AS chunks, CAST(sum(c.token_estimate) AS BIGINT) AS tokens FROM artifacts a JOIN chunks c ON c.artifact_id = a.id GROUP BY a.relative_path",
    "ag5_edge_types": "SELECT type, count(*) AS n FROM graph_edges GROUP BY type",
    "ag6_in_degree": "SELECT n.label, count(*) AS in_degree FROM graph_edges e JOIN graph_nodes n ON n.node_id = e.to_node WHERE e.type = 'references' GROUP BY n.label",
    "ag7_by_language": "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source",
    "ag8_json_group": "SELECT @JSON(props, '$.k') AS k, count(*) AS n FROM events GROUP BY @JSON(props, '$.k')",
    "ag9_live_memory": "SELECT scope, kind, count(*) AS n, CAST(sum(CASE WHEN valid_until IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS live FROM memory_records GROUP BY scope, kind",
    "ag10_sync_history": "SELECT source_id, status, count(*) AS n, max(started_at) AS last_at FROM sync_events GROUP BY source_id, status",
    "ag11_scope_tier": "SELECT scope, coalesce(nullif(tier, ''), 'hot') AS tier, count(*) AS n FROM memory_records GROUP BY scope, coalesce(nullif(tier, ''), 'hot')",
    "ag12_distinct_top": "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 20",
    "ag13_ordered_concat": "SELECT conv_id, @AGG(text; ' '; turn) AS doc FROM conversations GROUP BY conv_id",
    "ag14_line_span": "SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(*) AS n FROM lineitem GROUP BY l_orderkey",
    "ag15_first_symbols": "SELECT o_custkey, @AGG(p; ','; r) AS first_orders FROM (SELECT o_custkey, CAST(o_orderkey AS STRING) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) t WHERE r <= 8 GROUP BY o_custkey",
    "ag16_document_frequency": "SELECT w, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, @UNNEST(@SPLIT(lower(text), ' ')) AS w FROM documents) t GROUP BY w HAVING count(DISTINCT doc_id) >= 10",
    "ag17_corpus_size": "SELECT count(*) AS n FROM chunks",
    "ag18_total_degree": "SELECT node, count(*) AS degree FROM (SELECT from_node AS node FROM graph_edges UNION ALL SELECT to_node FROM graph_edges) t GROUP BY node",
    "ag19_node_types": "SELECT type, count(*) AS n FROM graph_nodes GROUP BY type",
    "ag20_watermark": "SELECT count(*) AS artifacts, coalesce(CAST(sum(size_bytes) AS BIGINT), 0) AS bytes FROM artifacts",
    "ag21_content_digest": "SELECT source_id, @SHA(joined) AS digest FROM (SELECT source_id, @AGG(relative_path || ':' || sha256; '|'; relative_path) AS joined FROM artifacts GROUP BY source_id) t",
    "ag22_mean_jaccard": "WITH t AS (SELECT DISTINCT conv_id, w FROM (SELECT conv_id, @UNNEST(@SPLIT(lower(text), ' ')) AS w FROM conversations) x WHERE length(w) > 1), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), s AS (SELECT a.conv_id AS a, b.conv_id AS b, count(*) AS k FROM t a JOIN t b ON a.w = b.w AND a.conv_id < b.conv_id GROUP BY a.conv_id, b.conv_id) SELECT round(sum(coalesce(1e0 * s.k / (x.n + y.n - s.k), 0)) / count(*), 4) AS mean_jaccard FROM n x JOIN n y ON x.conv_id < y.conv_id LEFT JOIN s ON s.a = x.conv_id AND s.b = y.conv_id",
    "ag24_percentile": "SELECT event_type, round(max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) THEN value END), 4) AS p50, round(max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN value END), 4) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) t GROUP BY event_type",
    "ag25_ratios": "SELECT scope, round(1e0 * sum(CASE WHEN supersedes IS NOT NULL THEN 1 ELSE 0 END) / count(*), 4) AS contradiction_rate, round(1e0 * sum(strlen(text)) / count(*), 4) AS bytes_per_record FROM memory_records GROUP BY scope",
    "ag26_histogram": "SELECT le, CAST(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS BIGINT) AS cumulative FROM events CROSS JOIN (SELECT 0.5 AS le UNION ALL SELECT 5.0 UNION ALL SELECT 50.0 UNION ALL SELECT 500.0) b GROUP BY le",
    "ag27_queue_depth": "SELECT s.status, count(e.id) AS n FROM (SELECT 'ok' AS status UNION ALL SELECT 'failed' UNION ALL SELECT 'dead') s LEFT JOIN sync_events e ON e.status = s.status GROUP BY s.status",
    "ag28_job_rollup": "SELECT user_id % 50 AS job, round(sum(value), 2) AS current, CASE WHEN count(*) = count(nullif(value, 0)) THEN count(*) ELSE NULL END AS total FROM events GROUP BY user_id % 50",
    "ag29_bytes_by_depth": "SELECT lang, source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang, source ORDER BY bytes DESC, lang, source LIMIT 20",
    "ag30_principals": "SELECT count(DISTINCT c_custkey) AS principals, count(DISTINCT c_mktsegment) AS groups FROM customer",
    "ag31_set_change": "SELECT count(*) AS changed FROM ((SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM documents WHERE doc_id % 9 <> 0) UNION ALL (SELECT doc_id FROM documents WHERE doc_id < 0 EXCEPT SELECT doc_id FROM documents)) t",
    "ag32_supersession": "SELECT supersedes, min(asserted_at) AS superseded_at FROM memory_records WHERE supersedes IS NOT NULL GROUP BY supersedes",
    # Windows and ranking
    "w5_top_per_scope": "SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY scope ORDER BY uses DESC, record_id) AS r FROM memory_records) t WHERE r > 20",
    "w6_top_per_subject": "SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY subject ORDER BY uses DESC, record_id) AS r FROM memory_records WHERE subject <> '') t WHERE r > 5",
    "w7_global_top": "SELECT record_id, uses FROM memory_records ORDER BY uses DESC, record_id LIMIT 25",
    "w9_lead_lag": "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS last_role FROM conversations",
    "w10_neighbours": "SELECT DISTINCT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id, turn FROM conversations WHERE turn % 5 = 2) a ON c.conv_id = a.conv_id AND c.turn BETWEEN a.turn - 1 AND a.turn + 1",
    "w12_running_retention": "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM documents) t WHERE total <= 50000",
    "w13_throughput": "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING) AS samples, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING) AS oldest FROM events",
    "w14_debounce": "SELECT user_id, batch, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM (SELECT user_id, ts, event_id, @EPOCH(ts) - lag(@EPOCH(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) g) t GROUP BY user_id, batch",
    "w16_duplicate_ordinal": "SELECT doc_id, row_number() OVER (PARTITION BY @SHA(text) ORDER BY doc_id) AS ordinal FROM documents",
    # Sort, limit, pages
    "sl1_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10",
    "sl5_offset_page": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30",
    "sl6_limit_wrapper": "SELECT * FROM (SELECT n_name FROM nation ORDER BY n_name) q ORDER BY n_name LIMIT 5",
    "sl10_capacity": "SELECT source, count(*) AS files, round(33e-1 * count(*) / 1000, 4) AS index_seconds, round(4e0 * sum(strlen(text)) / 1048576, 4) AS state_mb FROM documents GROUP BY source",
    # Set operations
    "so1_union_distinct": "SELECT lang AS v FROM documents UNION SELECT role FROM conversations",
    "so2_jaccard_sets": "SELECT a.n_nationkey AS a, b.n_nationkey AS b, count(*) AS shared FROM (SELECT DISTINCT c_nationkey AS n_nationkey, c_mktsegment AS t FROM customer) a JOIN (SELECT DISTINCT c_nationkey AS n_nationkey, c_mktsegment AS t FROM customer) b ON a.t = b.t AND a.n_nationkey < b.n_nationkey GROUP BY a.n_nationkey, b.n_nationkey",
    "so3_difference": "SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents WHERE doc_id % 2 = 0",
    "so4_added_dropped": "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM (SELECT doc_id AS k FROM documents WHERE doc_id % 2 = 0) a FULL OUTER JOIN (SELECT doc_id AS k FROM documents WHERE doc_id % 3 = 0) b ON a.k = b.k",
    "so6_best_score": "SELECT k, max(score) AS score FROM (SELECT l_orderkey AS k, l_discount AS score FROM lineitem UNION ALL SELECT o_orderkey, 0.05 FROM orders) t GROUP BY k",
    "so7_schema_union": "SELECT doc_id AS id, lang, CAST(NULL AS STRING) AS url FROM documents UNION ALL SELECT page_id, CAST(NULL AS STRING), url FROM pages",
    # Full-text helpers, graph, memory and statistics that are plain relations
    "tx5_title": "SELECT id, regexp_extract(relative_path, '([^/]*)$', 1) AS title FROM artifacts",
    "tx6_structural_prior": "SELECT id, round(1.0 + 0.05 * (length(relative_path) - length(replace(relative_path, '/', ''))) + CASE WHEN lower(relative_path) LIKE '%/tests/%' OR lower(relative_path) LIKE 'test_%' THEN 0.6 ELSE 0.0 END + CASE WHEN lower(relative_path) LIKE '%/samples/%' THEN 0.3 ELSE 0.0 END, 4) AS prior FROM artifacts",
    "tx7_preference_bonus": "SELECT id, round(greatest(0.25, 1.1 - 0.35 * CASE WHEN relative_path LIKE 'fr/%' THEN 1 ELSE 0 END), 4) AS prior FROM artifacts",
    "tx8_score_squash": "SELECT event_id, round(CASE WHEN -value < 0 THEN value / (1 + value) ELSE 1.0 END, 6) AS score FROM events",
    "tx9_like_fallback": "SELECT doc_id FROM documents WHERE position('tion' IN lower(text)) > 0 OR position('tion' IN lower(source)) > 0",
    "tx11_idf": "SELECT w, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, @UNNEST(@SPLIT(lower(text), ' ')) AS w FROM documents) t GROUP BY w) x CROSS JOIN (SELECT count(*) AS n FROM documents) c WHERE df > 20",
    "tx12_vocabulary_top": "SELECT w, df FROM (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, @UNNEST(@SPLIT(lower(text), ' ')) AS w FROM documents) t WHERE length(w) > 3 GROUP BY w) x ORDER BY df DESC, w LIMIT 64",
    "tx13_result_rows": "SELECT id, substr(text, 1, 240) AS summary, substr(text, 1, 500) AS text_preview FROM chunks",
    "vx8_prune_vectors": "SELECT e.vec_id FROM embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)",
    "vx11_config_change": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'none' WHEN n_nationkey % 4 = 1 THEN 'disabled' WHEN n_nationkey % 4 = 2 THEN 'introduced' ELSE 'invalidated' END AS change FROM nation",
    "gr1_upsert_nodes": "SELECT node_id, min(type) AS type, max(label) AS label, count(*) AS versions FROM (SELECT * FROM graph_nodes UNION ALL SELECT node_id, type, upper(label) FROM graph_nodes WHERE type = 'nation') t GROUP BY node_id",
    "gr6_hubs": "SELECT node, degree FROM (SELECT node, count(*) AS degree FROM (SELECT from_node AS node FROM graph_edges UNION ALL SELECT to_node FROM graph_edges) t GROUP BY node) d ORDER BY degree DESC, node LIMIT 10",
    "gr6_density": "SELECT n.n AS nodes, e.n AS edges, round(1e0 * e.n / n.n, 3) AS density FROM (SELECT count(*) AS n FROM graph_nodes) n CROSS JOIN (SELECT count(*) AS n FROM graph_edges) e",
    "gr12_remove_source": "SELECT e.from_node, e.to_node FROM graph_edges e WHERE e.from_node NOT LIKE 'supplier:%' AND e.to_node NOT LIKE 'supplier:%'",
    "gr13_search_blob": "SELECT node_id, lower(node_id || ' ' || type || ' ' || label) AS blob FROM graph_nodes",
    "gr14_index_delta": "SELECT coalesce(o.node_id, n.node_id) AS node_id, CASE WHEN o.node_id IS NULL THEN 'upsert' WHEN n.node_id IS NULL THEN 'remove' ELSE 'upsert' END AS op FROM (SELECT * FROM graph_nodes WHERE type <> 'part') o FULL OUTER JOIN (SELECT node_id, type, CASE WHEN type = 'region' THEN label || '!' ELSE label END AS label FROM graph_nodes WHERE type <> 'customer') n ON o.node_id = n.node_id WHERE o.label IS DISTINCT FROM n.label",
    "gr18_file_summary": "SELECT a.relative_path, a.size_bytes, c.token_estimate, substr(c.text, 1, 200) AS head FROM artifacts a JOIN chunks c ON c.artifact_id = a.id",
    "rf2_rrf": "WITH t AS (SELECT doc_id AS k, 'text' AS arm, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) x UNION ALL SELECT vec_id, 'vector', row_number() OVER (ORDER BY label, vec_id) FROM (SELECT * FROM embeddings ORDER BY label, vec_id LIMIT 50) y) SELECT k, round(sum(1e0 / (60 + r)), 6) AS score, min(r) AS best_rank, @AGG(arm; '+'; arm) AS retrieved_by FROM t GROUP BY k",
    "rf8_preview_delta": "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM (SELECT doc_id AS k FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30) a FULL OUTER JOIN (SELECT doc_id AS k FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 30) b ON a.k = b.k",
    "rf11_structure_profile": "SELECT 'language' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'type', type, count(*) FROM artifacts GROUP BY type",
    "rf12_citations": "SELECT conv_id, @UNNEST(@DISTINCT(@FIND(text || ' [1] see [12] and [1]', '@LB([0-9][0-9]?)@RB', 1))) AS cited FROM conversations",
    "rf14_intent": "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(how many|list|count)') THEN 'structure' WHEN regexp_matches(lower(text), '(who|relat|depend)') THEN 'relationship' ELSE 'lookup' END AS intent FROM conversations",
    "tm1_effective_end": "SELECT m.record_id, CASE WHEN coalesce(m.valid_until, '') = '' THEN s.at WHEN s.at IS NULL THEN m.valid_until ELSE least(m.valid_until, s.at) END AS ends FROM memory_records m LEFT JOIN (SELECT supersedes, min(asserted_at) AS at FROM memory_records WHERE supersedes IS NOT NULL GROUP BY supersedes) s ON s.supersedes = m.record_id",
    "tm2_projection": "SELECT record_id, scope, subject, kind, asserted_at, written_by FROM memory_records ORDER BY record_id",
    "tm10_write_folding": "SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY scope, subject, kind, lower(trim(text)) ORDER BY asserted_at, record_id) AS r FROM memory_records) t WHERE r = 1",
    "tm11_chain_walk": "WITH RECURSIVE chain(start, prior, hops) AS (SELECT record_id, supersedes, 1 FROM memory_records WHERE supersedes IS NOT NULL UNION ALL SELECT c.start, m.supersedes, c.hops + 1 FROM chain c JOIN memory_records m ON m.record_id = c.prior WHERE m.supersedes IS NOT NULL AND c.hops < 8) SELECT start, max(hops) AS hops FROM chain GROUP BY start",
    "tm12_reinforcement": "SELECT scope, subject, kind, count(*) AS observations, max(asserted_at) AS last_seen FROM memory_records GROUP BY scope, subject, kind",
    "tm14_subsume": "SELECT m.record_id, CASE WHEN s.record_id IS NULL THEN m.tier ELSE 'cold' END AS tier FROM memory_records m LEFT JOIN (SELECT DISTINCT supersedes AS record_id FROM memory_records WHERE supersedes IS NOT NULL) s ON s.record_id = m.record_id",
    "tm17_rule_parse": "SELECT record_id, kind, regexp_extract(text, '^([A-Za-z]+)', 1) AS head FROM memory_records WHERE kind IN ('alias', 'preference')",
    "tm20_coverage": "SELECT CASE WHEN d.doc_id IS NULL THEN 'unbridged' ELSE 'bridged' END AS state, count(*) AS n FROM memory_records m LEFT JOIN documents d ON d.doc_id = m.conv_id AND d.lang = 'en' GROUP BY CASE WHEN d.doc_id IS NULL THEN 'unbridged' ELSE 'bridged' END",
    "tm21_write_validation": "SELECT record_id, scope IN ('org', 'user', 'session') AND position(chr(10) IN subject) = 0 AND regexp_matches(asserted_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T.*Z$') AS valid FROM memory_records",
    "ml4_vocabulary_weights": "SELECT w, round(1e0 * df / max(df) OVER (), 6) AS weight FROM (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, @UNNEST(@SPLIT(lower(text), ' ')) AS w FROM documents) t GROUP BY w HAVING count(DISTINCT doc_id) >= 30) x",
    "ml5_checkpoint_interval": "SELECT n_nationkey, round(least(600.0, greatest(5.0, sqrt(2 * (1 + n_nationkey) * 3600.0))), 4) AS seconds FROM nation",
    "st9_config_fingerprint": "SELECT name, @SHA(config) AS fingerprint FROM (SELECT name, '{\"type\":\"' || type || '\",\"enabled\":' || CAST(enabled AS STRING) || '}' AS config FROM sources) t",
    # The SQL surface
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_grouping_sets": "SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY GROUPING SETS ((c_mktsegment, n_name), (c_mktsegment), ())",
    "sql_rollup": "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_filter_clause": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "sql_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "sql_exists_in_scalar": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 48) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "sql_full_right_join": "SELECT n.n_name, s.s_name FROM supplier s RIGHT JOIN nation n ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000",
    "sql_range_join": "SELECT p.p_partkey, b.band FROM part p JOIN (SELECT 1 AS band, 0.0 AS lo, 1000.0 AS hi UNION ALL SELECT 2, 1000.0, 1500.0 UNION ALL SELECT 3, 1500.0, 1000000.0) b ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi",
    "sql_range_frame": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "sql_ranking_windows": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q FROM part",
    "sql_recursive": "WITH RECURSIVE walk(node, depth) AS (SELECT 'region:0', 0 UNION ALL SELECT e.to_node, w.depth + 1 FROM walk w JOIN graph_edges e ON e.from_node = w.node WHERE e.type = 'contains' AND w.depth < 3) SELECT depth, count(*) AS n FROM walk GROUP BY depth",
    "sql_pivot_manual": "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM lineitem GROUP BY l_returnflag",
    "sql_array_lambda": "SELECT vec_id, @SIZE(@FILTER(embedding, @L(x) x > 0)) AS positives FROM embeddings",
    "sql_unpivot": "SELECT n_nationkey, k, v FROM (SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS region, CAST(length(n_name) AS BIGINT) AS letters FROM nation) s UNPIVOT (v FOR k IN (region, letters))",
    "sql_approximate": "SELECT lang, abs(approx_count_distinct(doc_id) - count(DISTINCT doc_id)) <= 15e-2 * count(DISTINCT doc_id) AS near FROM documents GROUP BY lang",
    "sql_json": "SELECT event_id, @JSON(props, '$.k') AS k FROM events",
}
