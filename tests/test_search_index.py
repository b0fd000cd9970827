"""Answers from postings against a scan of all texts, and of a base's segments against an index made anew."""

import random

import pytest
from pyspark.sql import functions as F

from strataq.kb import KnowledgeBase
from strataq.operators import fulltext, search_index

R = random.Random(4)
COMMON, RARE = ["the", "of", "gateway", "sync"], ["deploy", "engine", "parse", "config", "http", "server", "état", "node", "edge"]


def text(n):
    return " ".join(R.choice(COMMON if R.random() < 0.7 else RARE) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i:03}", f"file:{i}", "s", None, f"{R.choice(RARE)}.md", f"{R.choice(['src', 'tests'])}/{i}.md", R.choice(["Guide", "", None]), text(R.randint(0, 40))) for i in range(160)]
    return spark.createDataFrame(rows, "id string, artifact_id string, source string, acl string, title string, path string, heading string, body string").repartition(4)


QUESTIONS = ["deploy the engine", "sync_engine", "gateway", "parseConfig of gateway", "nothing here xyzzy", "of_the_sync", "http server node edge deploy", "", "gateway sync deploy"]


def test_question_terms(spark):
    asked = [*QUESTIONS, "How does sync_engine call parseConfig in the HTTPServer?", "what is it", "a_b __x __", None, "a1B2c"]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", search_index.question_terms(F.col("q")).alias("t")).collect()
    assert [r["t"] for r in rows] == [fulltext.query_tokens(q or "") for q in asked]


@pytest.mark.parametrize("limits", [{}, {"LISTED": 2, "PAIRS": 3, "SHARD": 60}])
def test_answers_equal_a_scan(spark, docs, monkeypatch, limits):
    """With limits this low terms are joined, and questions and documents met in many tasks."""
    for name, value in limits.items():
        monkeypatch.setattr(search_index, name, value)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(QUESTIONS)], "question int, text string")
    found = {}
    for r in search_index.answer(docs, asked, 7).collect():
        found.setdefault(r["question"], []).append((r["rank"], r["id"], r["score"]))
    for i, q in enumerate(QUESTIONS):
        terms = fulltext.query_tokens(q)
        wanted = [(r["rank"], r["id"], r["score"]) for r in fulltext.bm25(docs, terms, 7).collect()] if terms else []
        assert sorted(found.get(i, [])) == pytest.approx(wanted, abs=2e-6) if not wanted else [x[:2] for x in sorted(found[i])] == [x[:2] for x in wanted]
        assert [x[2] for x in sorted(found.get(i, []))] == pytest.approx([x[2] for x in wanted], abs=2e-6)


def test_weak_terms_bring_no_candidates(spark, docs):
    """'the' is everywhere; with a rare term it only adds to scores."""
    of = search_index.postings(docs).cache()
    size = search_index.measure(docs)
    asked = spark.createDataFrame([(1, ["deploy", "the"])], "question int, terms array<string>")
    found = search_index.best(of, search_index.dictionary(of), size["n"], size["length"], asked, 5).orderBy("rank").collect()
    with_deploy = {r["id"] for r in of.where("term = 'deploy'").collect()}
    assert {r["id"] for r in found} <= with_deploy
    assert [r["id"] for r in found] == [r["id"] for r in fulltext.bm25(docs, ["deploy", "the"], 5).collect()]
    of.unpersist()


def test_segments_equal_an_index_made_anew(spark, tmp_path):
    """After changes and deletions, before and after compaction, scores and statistics are those of a new base."""
    state = {}
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    for step in range(4):
        for s in ("a", "b"):
            for i in R.sample(range(12), 5):
                state[s, i] = None if R.random() < 0.3 else f"# {R.choice(RARE)}\n\n{text(R.randint(3, 30))}"
        names = ["a", "b"] if step % 2 else ["a"]
        rows = [(s, f"{i}.md", t) for (s, i), t in state.items() if t is not None and s in names] or [("a", "0.md", "x")]
        base.ingest(spark.createDataFrame(rows, "source string, path string, text string"))
        if step == 2:
            assert base.compact()
    rows = [(s, f"{i}.md", t) for (s, i), t in state.items() if t is not None]
    base.ingest(spark.createDataFrame(rows, "source string, path string, text string"))
    fresh = KnowledgeBase(spark, str(tmp_path / "new"))
    fresh.ingest(spark.createDataFrame(rows, "source string, path string, text string"))
    asked = spark.createDataFrame([(str(i), fulltext.query_tokens(q)) for i, q in enumerate(QUESTIONS)], "question string, terms array<string>")
    ask = lambda b: sorted(tuple(r) for r in b.answers(asked, 6).collect())
    wanted = ask(fresh)
    assert len(wanted) > 20 and ask(base) == wanted
    words = lambda b: sorted(tuple(r) for r in b.store.read("dictionary").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect())
    assert words(base) == words(fresh)
    assert base.compact() and ask(base) == wanted and len(base.store.version().runs) == 1


def test_search_filters_before_it_ranks_and_writes_nothing(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    rows = [("a", "1.md", "# Term\n\nrare words", '{"allow": ["user:ana"]}'), ("a", "2.md", "# Other\n\nrare words and many more words", None), ("b", "3.md", "# Term\n\nwords", None)]
    base.ingest(spark.createDataFrame(rows, "source string, path string, text string, acl string"))
    score = lambda **limits: {r["path"]: r["score"] for r in base.search("rare words", **limits).collect()}
    import glob

    before = sorted(glob.glob(f"{base.folder}/**", recursive=True))
    every = score(identities=["user:ana"])
    assert set(every) == {"1.md", "2.md", "3.md"}
    # A score is the same for a caller who sees less, and the first k are of what they see.
    assert score(identities=["user:bob"]) == {p: s for p, s in every.items() if p != "1.md"}
    assert score(identities=["user:bob"], k=1).keys() == {"2.md"}
    assert score(identities=["user:ana"], sources=["b"]).keys() == {"3.md"} and score(identities=["user:ana"], section=" TERM ").keys() == {"1.md", "3.md"}
    assert sorted(glob.glob(f"{base.folder}/**", recursive=True)) == before
