import random

import numpy as np
import pytest

from strataq.llm import language_id, topk_search, toxicity, url_filter
from strataq.llm.queries import URL_RULES

R = random.Random(5)


def test_top_k(spark):
    rows = [(i, [R.choice([0.1, 0.5, -0.3, 0.25]) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 4), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in topk_search.exact_top_k(df, df.where("vec_id % 50 = 0"), 5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in rows[:300]}
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


@pytest.mark.parametrize("most", [100, 0])
def test_urls(spark, most):
    cases = [
        ("http://A.Example.com/en/7198?x#y", "example.com/en/7", "allow"), ("https://a.com/en/", "com/en/", "block"), ("http://example.net/de/81", "example.net/de/8", "block"),
        ("http://x.net/de/81", "net/de/", "allow"), ("ftp://q.org/es/#", "org/es/", "block"), ("http://org/en/", None, "allow"), (None, None, "allow"), ("nothing", None, "allow"), ("http://", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, "z") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, host string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, URL_RULES, most=most).collect()}
    assert [found[i] for i in range(len(cases))] == [(rule, verdict) for _, rule, verdict in cases]


def test_language(spark):
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["kwik", "zwart", "hond"]}
    rows = [(i, " ".join(R.choice(words[lang]) for _ in range(20)), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame([*rows, (100, None, "aa"), (101, "123 !", "bb"), (102, "", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_id.predict(df, language_id.fit(df.where("doc_id < 60"))).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [found[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in found.values())


def test_toxicity_and_identity_terms(spark):
    neutral = ["the day was fine", "we walked home", "lunch was good today", "rain fell in town"]
    rows = [(i, R.choice(neutral) + (" you idiot women" if i % 2 else " with friends"), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "lunch with women was good today"), (902, "such an idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels)
    assert fitted.pairs >= 200  # each text that names women, and two for each that names nobody
    with_swaps = {r["doc_id"]: r["score"] for r in toxicity.score(docs, fitted).collect()}
    without = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, terms=())).collect()}
    assert all((with_swaps[i] > 0.5) == (y == 1) for i, _, y in rows)
    assert with_swaps[902] > 0.5 and with_swaps[901] < without[901] and 0 <= with_swaps[900] <= 1


def test_toxicity_without_any_group_named(spark):
    """Where no labelled text names a group, terms are put in; a neutral mention then leaves the score where it was."""
    rows = [(i, f"fine day number {i % 7} in town" if i % 2 else f"day {i % 7} for an idiot blackguard whitewash") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int")
    fitted, without = toxicity.fit(docs, labels), toxicity.fit(docs, labels, terms=())
    assert fitted.pairs == 240 and without.pairs == 0

    def moved(classifier):
        plain = [t for i, t in rows if i % 2][:20]
        texts = [*plain, *(t.replace("in town", f"with a {w} in town") for t in plain for w in ("black", "white"))]
        scores = [r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), classifier).orderBy("doc_id").collect()]
        scores = [np.log(s / (1 - s)) for s in scores]
        return max(abs(s - scores[i // 2]) for i, s in enumerate(scores[20:]))

    # blackguard and whitewash lend their beginnings to black and white.
    assert moved(fitted) < 0.25 * moved(without) and moved(without) > 1


def test_toxicity_scores_by_plain_sums(spark):
    """Scores against a sum over a set of words and their beginnings, one string at a time."""
    import math
    import re

    from strataq.llm import _text as tx

    rows = [(i, "Fine day, friends" if i % 2 else "you IDIOT, éé idiot2") for i in range(40)]
    docs = spark.createDataFrame([*rows, (50, None), (51, ""), (52, "idiots " * 3000)], "doc_id long, text string")
    fitted = toxicity.fit(docs, spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int"))
    for r in docs.join(toxicity.score(docs, fitted), "doc_id").collect():
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (r["text"] or "").encode().lower())
        slots = {tx.string_hash(w) >> 44 for w in words} | {(tx.string_hash(w[:n]) ^ n) >> 44 for w in words for n in (4, 5, 6) if len(w) >= n}
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-fitted.bias - sum(float(fitted.weights[s]) for s in slots))))


def test_language_by_plain_sets(spark):
    """Predictions against popcounts over sets of n-grams, one text at a time, with the filter's false positives."""
    rows = [(i, " ".join(R.choice(["één", "lorem", "kwik", "zwart", "ipsum"][i % 2 :: 2]) for _ in range(9)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame([*rows, (90, "x" * 5000 + " lorem", "a"), (91, "abc", None)], "doc_id long, text string, lang string")
    fitted = language_id.fit(df)
    for r in df.join(language_id.predict(df, fitted), "doc_id").withColumnRenamed("score", "s").collect():
        raw = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 97 <= b < 123 else 32 for b in r["text"].encode())
        grams = [raw[i : i + 4] for i in range(len(raw) - 3) if raw[i + 1 : i + 3] != b"  "]
        counts = []
        for i, false in enumerate(fitted.false):
            hit = sum(all(int(fitted.masks[i // 64, int.from_bytes(g, "big") * int(h) % (1 << 64) >> 44]) >> i % 64 & 1 for h in language_id.HASHES) for g in grams)
            counts.append(max(0.0, (hit - len(grams) * false) / (1 - false)))
        if sum(counts):
            assert r["lang_pred"] == fitted.languages[counts.index(max(counts))] and r["s"] == pytest.approx(max(counts) / sum(counts))
        else:
            assert r["s"] == 0
