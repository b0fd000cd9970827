"""The pipeline's rows against its stages' brute-force versions, on a small folder."""

import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp
    from strataq.llm import decontamination, ngram_join, suffix_dedup

    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(45))
    item = " ".join(rnd.choice(words) for _ in range(12))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 80))) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", texts[2] + " " + passage, texts[3][::-1] + " " + passage, texts[4][::-1] + " " + item, ""]
    rows = [(i, t + (" idiot" if i % 3 == 0 and i < 60 else ""), "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r["decoded_sha256"] for r in cp.run(spark, str(tmp_path)).collect()}
    kept = [(i, t) for i, t, *_ in rows if "idiot" not in t]
    groups = ngram_join.plain_components(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    cut = suffix_dedup.plain_dedup([t for _, t in kept])
    after = {i: digest for (i, _), (_, _, _, digest) in zip(kept, cut, strict=True)}
    dirty = decontamination.plain_contamination(kept, [("1", item)])
    assert found == {i: digest for i, digest in after.items() if not dirty[i][1]}
    assert hashlib.sha256(b"").hexdigest() in found.values()


def test_join_stage_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as cp

    words = [f"w{i}" for i in range(90)]
    first, second, third = (" ".join(words[i : i + 30]) for i in (0, 30, 60))
    rows = [(1, first), (2, first), (2, second), (2, second), (3, ""), (3, ""), (4, third), (4, third + " more"), (None, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((r["doc_id"] or 0, r["text"]) for r in cp.ngram_join_stage(spark, docs, "").collect()))
    assert found == [(0, first), (1, first), (2, second), (3, ""), (3, ""), (4, third)]


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as cp

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "mine", 5, "r"), (1, text + " x", "mine", 6, "r"), (2, "other", None, None, None)], "doc_id long, text string, __key string, __place int, __row string")
    found = cp.ngram_join_stage(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == [(1, text, "mine", 5, "r"), (2, "other", None, None, None)]


def test_a_repeated_id_does_not_enlarge_the_sample(spark, monkeypatch):
    """Two ids of a hundred rows each: the classifier is fitted on one text of each."""
    from strataq.llm import toxicity

    seen = []
    train = toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda rows, *a: seen.append(len(rows)) or train(rows, *a))
    docs = spark.createDataFrame([(i % 2, f"text {i} " + ("idiot" if i % 2 else "friend")) for i in range(200)], "doc_id long, text string").repartition(4)
    toxicity.fit(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"))
    assert seen == [2]
