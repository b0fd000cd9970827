"""Empty tables, null and repeated ids, and texts over several slices, through all operators and the pipeline."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")

from strataq.llm import bpe_codec, decontamination, katz_lm, language_id, ngram_join, queries, suffix_dedup, token_counts, topk_search, toxicity, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `odd name` int"
LABELS = "doc_id long, quality int, toxic int"


def folder(spark, where, docs, labels, bench, vectors, pages):
    spark.createDataFrame(docs, DOCS).repartition(2).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return str(where)


def test_all_queries_over_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    where = folder(spark, tmp_path, [], [], [], [], [])
    for name, query in queries.queries().items():
        assert query(spark, where).collect() == [], name
    assert cp.run(spark, where).collect() == []


def test_all_queries_over_nulls_and_repeats(spark, tmp_path):
    """Rows stay as many as they were, but for a search's queries; the pipeline drops one of two equal rows."""
    import corpus_pipeline as cp

    text = "one two three four five six seven eight nine ten eleven"
    docs = [(None, text, None, None, None, None), (1, text, "en", "s", 1, 1), (1, text, "en", "s", 1, 1), (None, None, None, None, None, None), (2, None, "en", "s", 1, 1), (3, "", None, "s", 1, 1), (4, text + " other", "de", None, 1, 1)]
    labels = [(None, None, None), (1, 1, None), (1, 1, 0), (4, None, 1), (9, 1, 1)]
    where = folder(spark, tmp_path, docs, labels, [(None, None), (1, text), (1, text)], [(None, [1.0], None), (50, None, 1), (50, [None], 1), (100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1)], [(None, None, None), (1, "http://a.com/en/x", None), (1, None, None)])
    size = {"op2_topk_search": 1, "op5_url_filter": 3, "op11_embedding_whitening": 5, "op12_vector_codes": 3, "op13_near_vectors": 5}
    for name, query in queries.queries().items():
        assert len(query(spark, where).collect()) == size.get(name, len(docs)), name
    assert len(cp.run(spark, where).collect()) <= len(docs)


@pytest.fixture(scope="module")
def long_texts():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(9, 17))) for _ in range(4000)]
    long = " ".join(rnd.choice(words) for _ in range(160_000))  # over 2 MB, in three slices
    assert len(long.encode()) > 2 << 20
    return [long, " ".join(long.split(" ")[:200]), "w" * 1_100_000, long[:900_000] + " end", None]


def test_long_texts_are_counted_and_coded_whole(spark, long_texts):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(list(enumerate(long_texts[:2] + long_texts[3:])), "doc_id long, text string")
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json")).collect()}
    coded = {r["doc_id"]: r for r in bpe_codec.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        assert found[r["doc_id"]] == len(hf.encode(text, add_special_tokens=False).ids)
        assert coded[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_meet_whole(spark, long_texts):
    pairs = list(enumerate(long_texts))
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    joined = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert joined == ngram_join.plain_components(pairs)
    item = " ".join(long_texts[0].split(" ")[-30:])
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    hit = decontamination.contamination(docs, bench).withColumn("h", decontamination.items_digest())
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["h"]) for r in hit.collect()} == decontamination.plain_contamination(pairs, [("a", item)])
    scores = {r["doc_id"]: r for r in katz_lm.score(docs, "doc_id <> 3").collect()}
    for i, (n, known, total, base, score) in katz_lm.plain_score(pairs, {0, 1, 2, 4}).items():
        assert (scores[i]["n_tokens"], scores[i]["n_known"], scores[i]["train_tokens"]) == (n, known, total)
        assert scores[i]["base_score"] == pytest.approx(base) and scores[i]["score"] == pytest.approx(score)


def test_long_texts_are_judged_whole(spark, long_texts):
    """What tells a text's class or language stands at its very end, after several slices without it."""
    digits = "0 " * 1_200_000
    rows = [(i, ("kwik zwart hond " if i % 2 else "lorem ipsum dolor ") * 5, "ab"[i % 2]) for i in range(120)]
    docs = spark.createDataFrame([*rows, (990, digits + "zwart hond", None), (991, digits + "lorem dolor", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs.where("doc_id < 120"))).collect()}
    assert (found[990], found[991]) == ("b", "a")
    fitted = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, fitted).collect()}
    assert scores[990] > 0.7 > 0.3 > scores[991]
