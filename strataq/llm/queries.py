"""Queries op1_ to op13_: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontamination, katz_lm, language_id, near_vectors, ngram_join, suffix_dedup, token_counts, topk_search, toxicity, url_filter, vector_codes, whitening


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk_search.exact_top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = language_id.remainder("doc_id", 5)
    found = language_id.predict(docs, language_id.fit(docs.where(fold != 0)))
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), language_id.remainder("doc_id", 3)
    classifier = toxicity.fit(docs.where(fold != 1), table(spark, sf_dir, "labels").where(fold != 1))
    found = toxicity.score(docs, classifier)
    return found.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = decontamination.items_digest().alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (found["n_hit"] > 0).alias("contaminated"))


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = katz_lm.score(table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2")
    held_out = language_id.remainder("doc_id", 7) == 2
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Vectors that take part in op12 and op13.
_COMPLETE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql() -> str:
    """Both rounds and the last assignment of op12, each over all distances of parts to entries; for vectors of one length."""

    def near(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
                SELECT r, p, min(d * 64 + k) % 64 AS k, min(d * 64 + k) // 64 AS d
                FROM (SELECT x.r, x.p, c.k, CAST(sum((x.x - c.c) * (x.x - c.c)) AS BIGINT) AS d FROM x JOIN book{k} c USING (p, j) GROUP BY x.r, x.p, c.k) GROUP BY r, p
            )"""

    def book(k: int) -> str:
        return f"""means{k} AS (SELECT p, j, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN near{k} USING (r, p) GROUP BY p, j, k),
            book{k + 1} AS MATERIALIZED (SELECT p, j, k, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM book{k} LEFT JOIN means{k} USING (p, j, k))"""

    return f"""
            WITH e AS MATERIALIZED (
                SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings WHERE {_COMPLETE}
            ),
            x AS MATERIALIZED (SELECT r, (i - 1) // (n // 16) AS p, (i - 1) % (n // 16) AS j, x FROM (SELECT r, len(v) AS n, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e)),
            book0 AS MATERIALIZED (SELECT p, j, r AS k, x AS c FROM x WHERE r < 64),
            {near(0)}, {book(0)}, {near(1)}, {book(1)}, {near(2)},
            sums AS (SELECT r, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r),
            digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM book2)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN sums USING (r), digest
        """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the operator."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op2_topk_search": """
            WITH e AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
                FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            ), r AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
        """,
        "op5_url_filter": f"""
            WITH u AS (
                SELECT page_id,
                    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
                FROM pages
            ), rules(h, p, v) AS (VALUES {rules}), best AS (
                SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
                FROM (SELECT DISTINCT host, path FROM u) d JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
                GROUP BY host, path
            )
            SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict
            FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
        """,
        "op12_vector_codes": _codes_sql(),
        "op13_near_vectors": f"""
            WITH RECURSIVE e AS MATERIALIZED (
                SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                WHERE label IS NOT NULL AND {_COMPLETE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), links AS MATERIALIZED (
                SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
                WHERE list_cosine_similarity(a.v, b.v) >= 0.93
            ), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
            found AS (SELECT a, min(b) AS least FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
            SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
            FROM embeddings LEFT JOIN found ON vec_id = found.a LEFT JOIN counted ON vec_id = counted.a
        """,
    }
