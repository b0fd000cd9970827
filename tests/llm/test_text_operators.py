"""Operators on texts against libraries or brute force, with nulls, empty and long texts, repeats and empty tables."""

import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from strataq.llm import bpe_codec, decontamination, katz_lm, ngram_join, suffix_dedup, token_counts  # noqa: E402

R = random.Random(11)
ODD = [None, "", " ", "\n\n", "x" * 3000, "é" * 500, "日本 don't  'll\t<|endoftext|> a", "a b c", "A B C", "same text here now ok", "same text here now ok"]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts(docs_of, hf):
    found = {r["doc_id"]: r for r in token_counts.token_counts(docs_of(ODD), P.path("byte_bpe_50k.json")).collect()}
    for i, text in enumerate(ODD):
        n = len(hf.encode(text or "", add_special_tokens=False).ids)
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((text or "").encode()), n > 512)


@given(st.text(alphabet="ab é\n\t's!1x", max_size=25))
@settings(max_examples=60, deadline=None)
def test_every_prefix(text):
    from tokenizers import Tokenizer

    hf = test_every_prefix.__dict__.setdefault("hf", Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    counts = token_counts.counter(P.path("byte_bpe_50k.json")).prefixes(text)
    assert counts.tolist() == [len(hf.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_codec(docs_of, tik):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    found = {r["doc_id"]: r for r in bpe_codec.round_trip(docs_of(ODD), path).collect()}
    for i, text in enumerate(ODD):
        ids = tik.encode_ordinary(text or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    own = bpe_codec.codec(path)
    assert all(own.decode(own.encode(t or ""), 1) == (t or "") for t in ODD)


def noisy(n, words=12):
    vocabulary = [f"w{i}" for i in range(25)]
    base = [[R.choice(vocabulary) for _ in range(R.randint(2, words * 4))] for _ in range(5)]
    out = []
    for _ in range(n):
        text = list(R.choice(base))
        for _ in range(R.choice([0, 1, 3])):
            text[R.randrange(len(text))] = R.choice(vocabulary)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("limits", [{}, {"very_long": 4, "block_rows": 3}])
def test_ngram_join(docs_of, limits):
    texts = [*ODD, *noisy(60)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs_of(texts), **limits).collect()}
    assert found == ngram_join.plain_components(list(enumerate(texts)))


def test_ngram_join_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (1, "other words of the same id here"), (2, text), (None, text), (None, None), (3, None)]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, -1 if r["n_links"] is None else r["n_links"]) for r in found)) == [
        (-1, 0, -1, -1), (-1, 3, -1, -1), (1, 3, 1, 0), (1, 3, 1, 2), (1, 3, 1, 2), (2, 3, 1, 2), (3, 0, 3, 0)]


def test_ngram_join_sends_only_sets_with_a_partner(docs_of, monkeypatch):
    """Texts that share a rare passage and no more are together in units; their shingles aren't sent, and near copies' are."""
    words = lambda n: [f"v{R.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        passage = words(60)
        texts += [" ".join([*words(30), *passage, *words(30)]) for _ in range(2)]
    copied = words(200)
    texts += [" ".join([*copied, *words(n)]) for n in (1, 10, 20)]
    sent, sets_of = [], ngram_join._sets_of

    def spy(members, rows):
        sent.append(members.select("set").distinct().count())
        return sets_of(members, rows)

    monkeypatch.setattr(ngram_join, "_sets_of", spy)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs_of(texts)).collect()}
    assert found == ngram_join.plain_components(list(enumerate(texts)))
    assert [found[i][1:] for i in (80, 81, 82)] == [(80, 2)] * 3
    assert 3 <= sent[0] <= 6


def test_sketches_keep_all_similar_sets():
    """Every similar pair is close by its sketches, across widths and at the threshold; few others are."""
    rng = np.random.default_rng(5)
    sets = []
    for n in [*range(1, 12), 57, 63, 64, 65, 72, 120, 127, 128, 129, 150, 1000, 1024, 1100]:
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets.append(base)
        sets += [np.concatenate([base[: n - k], rng.integers(0, 1 << 63, m, dtype=np.uint64)]) for k, m in ((0, n // 4), (n // 5, 0), (n // 9, n // 9), (n // 9 + 1, n // 9 + 1)) if n > k]
    sets.sort(key=len)
    sizes = np.array([len(x) for x in sets])
    data = ngram_join.sketches(np.concatenate(sets), sizes)
    close = {(a, b) for x, y in ngram_join.close_sketches(data, sizes) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    known = [set(x.tolist()) for x in sets]
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(known[a] & known[b]) >= 80 * len(known[a] | known[b])}
    assert len(similar) > 60 and similar <= close and len(close) < 2 * len(similar)
    assert ngram_join.sketches(np.zeros(0, np.uint64), np.array([0, 0])) == [b"", b""] and ngram_join.sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64)) == []


def test_postings_by_columns():
    rows = np.zeros(3, ngram_join.POSTING)
    rows["shingle"], rows["set"], rows["size"] = [1 << 63, 5 << 32 | 7, 0], [1, (1 << 64) - 1, 3], [1, 300, 70_000]
    data = ngram_join.posted(rows)
    back = ngram_join.read_posted(data)
    assert len(data) == 48 and back["shingle"].tolist() == [1 << 31, 5, 0] and (back[["set", "size"]] == rows[["set", "size"]]).all()
    assert len(ngram_join.read_posted(b"")) == 0


@pytest.mark.parametrize("common", [suffix_dedup.COMMON, 2])
def test_suffix_dedup(docs_of, common):
    passages = ["".join(R.choice("abcdé ") for _ in range(n)) for n in (199, 200, 260, 420)]
    texts = [*ODD, *("".join(R.choice("xyz ") for _ in range(R.randint(0, 200))) + R.choice(passages) + str(i) for i in range(25)), "ab" * 300]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs_of(texts), common=common).collect()}
    assert [found[i] for i in range(len(texts))] == suffix_dedup.plain_dedup(texts)


def test_suffix_dedup_partition_of_short_texts(spark):
    """One partition has short texts only, one a text longer than a slice that repeats itself across slices."""
    R.seed(3)
    long = "".join(R.choice("abcdefg ") for _ in range(1 << 19))
    texts = ["short", "", None, long + "x" + long[: 1 << 18] + long, long[100:900], "s" * 199]
    df = spark.createDataFrame([(i, t, i in (3, 4)) for i, t in enumerate(texts)], "doc_id long, text string, far boolean").repartitionByRange(2, "far")
    found = {r["doc_id"]: r for r in suffix_dedup.dedup(df).collect()}
    assert [(found[i]["n_removed"], found[i]["n_spans"]) for i in (0, 1, 2, 5)] == [(0, 0)] * 4
    assert found[3]["n_removed"] == len(texts[3]) - 1 and found[4]["n_removed"] == 800
    assert found[3]["kept_sha256"] == hashlib.sha256(b"x").hexdigest()


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, docs_of, block):
    items = [("1", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), ("2", "c"), ("10", None), ("11", "same text, here")]
    texts = [*ODD, "zz W1 w2 w3 w4 w5 w6 w7 w8 w9 w10 zz", "w1 w2 w3 w4 w5 w6 w7 w8 w9", "w2-w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.contamination(docs_of(texts), bench, block_bytes=block).withColumn("h", decontamination.items_digest())
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["h"]) for r in found.collect()} == decontamination.plain_contamination(list(enumerate(texts)), [(i, t or "") for i, t in items])


def test_katz(docs_of):
    texts = [*ODD, *noisy(60)]
    found = {r["doc_id"]: r for r in katz_lm.score(docs_of(texts), "crc32(cast(cast(doc_id AS string) AS binary)) % 7 <> 2").collect()}
    wanted = katz_lm.plain_score(list(enumerate(texts)), {i for i in range(len(texts)) if katz_lm.fold(i, 7) != 2})
    for i, (n, known, total, base, score) in wanted.items():
        assert (found[i]["n_tokens"], found[i]["n_known"], found[i]["train_tokens"]) == (n, known, total)
        assert found[i]["base_score"] == pytest.approx(base) and found[i]["score"] == pytest.approx(score)


def test_katz_keeps_single_bigrams(docs_of):
    texts = ["a b", "a b", "b c", "c d d", "a b c"]
    found = {r["doc_id"]: r["score"] for r in katz_lm.score(docs_of(texts), "true").collect()}
    # By hand: counts of counts 5, 3, 2 give the discounts 1/2, 1 and 5/6. Single are start c (of 5), c d (of 3, with
    # 2 of "c end", scaled from 5/6 to 3/4), d d and d end (of 2).
    assert 10 ** found[3] == pytest.approx(0.5 / 5 * (0.9 * 0.5 / 3) * 0.5 / 2 * 0.5 / 2)


def test_empty_tables(spark, docs_of):
    none = docs_of(["a"]).where("doc_id < 0")
    bench = spark.createDataFrame([], "item_id string, text string")
    for found in (
        token_counts.token_counts(none, P.path("byte_bpe_50k.json")), bpe_codec.round_trip(none, P.path("byte_bpe_multi_50k.tiktoken")),
        ngram_join.jaccard_components(none), suffix_dedup.dedup(none), decontamination.contamination(none, bench), katz_lm.score(none, "true"),
    ):
        assert found.collect() == []
