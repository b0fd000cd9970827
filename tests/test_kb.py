import sys
import tempfile

import pytest
from pyspark import cloudpickle

from strataq.kb import KnowledgeBase

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests

TEXTS = [
    ("docs", "guide.md", "# Guide\n\nHow the gateway starts.\n\n## Deploy\n\nSee [notes](notes.md) about deploying the gateway.", None),
    ("docs", "notes.md", "# Notes\n\nNothing of it is secret.", '{"allow": ["user:ana"]}'),
    ("code", "src/gate.py", "def gateway():\n    return 1\n", None),
    ("docs", None, "lost", None),
]
SCHEMA = "source string, path string, text string, acl string"


@pytest.fixture(scope="module")
def base(spark):
    kb = KnowledgeBase(spark, tempfile.mkdtemp(prefix="kb-"))
    assert kb.artifacts().count() == 0 and kb.search("x").count() == 0 and kb.version() == 0
    assert kb.ingest(spark.createDataFrame(TEXTS, SCHEMA)).collect() == [("added", 3)]
    kb.build_graph()
    return kb


def test_search_and_context(base):
    hits = base.search("gateway").collect()
    assert {h["path"] for h in hits} == {"guide.md", "src/gate.py"} and [h["rank"] for h in hits] == list(range(1, len(hits) + 1))
    assert base.search("secret", identities=["user:bob"]).count() == 0 and base.search("secret", identities=["user:ana"]).count() == 1
    context = {r["artifact_id"]: r["text"] for r in base.context("deploying").collect()}
    assert list(context) == ["file:docs:guide.md"] and "How the gateway starts." in context["file:docs:guide.md"]
    assert base.sql("SELECT count(*) AS n FROM chunks WHERE heading_path LIKE :h", h="%Deploy").first()["n"] == 1


def test_graph(base):
    assert base.edges().where("type = 'links_to'").collect() == [("file:docs:guide.md", "file:docs:notes.md", "links_to")]
    assert {r["node"] for r in base.neighbors("source:docs").collect()} == {"source:docs", "file:docs:guide.md", "file:docs:notes.md"}
    assert base.path("heading:file:docs:guide.md:5", "file:docs:notes.md") == ["heading:file:docs:guide.md:5", "heading:file:docs:guide.md:1", "file:docs:guide.md", "file:docs:notes.md"]
    assert base.search_graph("Deploy").first()["title"] == "Deploy"


def test_only_changes_are_written(base, spark):
    chunks = base.chunks().count()
    assert base.ingest(spark.createDataFrame(TEXTS, SCHEMA)).collect() == [("unchanged", 3)] and base.version() == 1
    later = [("docs", "guide.md", "# Guide\n\nShort.", None), ("docs", "new.md", None, None), ("docs", "new.md", "twice", None)]
    assert sorted(base.ingest(spark.createDataFrame(later, SCHEMA)).collect()) == [("added", 1), ("changed", 1), ("deleted", 1)]
    assert {r["relative_path"] for r in base.artifacts().collect()} == {"guide.md", "new.md", "src/gate.py"} and base.version() == 2
    assert base.chunks().count() < chunks and base.headings().count() == 1
    assert base.ingest(spark.createDataFrame(TEXTS, SCHEMA).where("source = 'docs' AND path = 'notes.md'")).orderBy("change").collect() == [("added", 1), ("deleted", 2)]


def test_memory(base, spark):
    names = "record_id string, scope string, kind string, written_by string, text string, asserted_at string, supersedes string"
    assert base.memory_records().count() == 0
    base.remember(spark.createDataFrame([("a", "org", "fact", "x", "Build is green", "2024-01-01T00:00:00Z", None), ("b", "org", "fact", "y", "build is green.", "2024-02-01T00:00:00Z", None), (None, "org", "fact", "y", "lost", "2024", None)], names))
    base.remember(spark.createDataFrame([("c", "org", "fact", "y", "Build is red", "2024-03-01T00:00:00Z", "a")], names))
    assert {r["record_id"] for r in base.memory_records().collect()} == {"a", "c"}
    assert [r["record_id"] for r in base.recall("2024-04-01T00:00:00Z").collect()] == ["c"]
    assert [r["record_id"] for r in base.recall("2024-04-01T00:00:00Z", {"as_of": "2024-02-15T00:00:00Z"}).collect() if r["asserted_at"] < "2024-02"] == ["a"]


def vectors_of(texts):
    """By letters: texts of the same letters are near."""
    return [[float(t.lower().count(c)) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def test_hybrid_search(spark):
    base = KnowledgeBase(spark, tempfile.mkdtemp(prefix="kb-"))
    rows = [("docs", "deploy.md", "# Deploy\n\nzzz zzz", None), ("docs", "words.md", "how to deploy it, and deploy again", None), ("docs", "near.md", "yolped", None), ("hr", "secret.md", "deploy deploy", '{"allow": ["user:ana"]}')]
    base.ingest(spark.createDataFrame(rows, SCHEMA))
    found, missing = base.hybrid("deploy")
    assert missing == ["vector", "graph"] and {r["path"] for r in found.collect()} == {"deploy.md", "words.md", "secret.md"} - {"secret.md"}
    assert base.embed(vectors_of) == 4 and base.embed(vectors_of) == 0
    base.build_graph()
    found, missing = base.hybrid("deploy", embedder=vectors_of)
    by = {r["path"]: r for r in found.collect()}
    assert missing == [] and set(by) == {"deploy.md", "words.md", "near.md"} and by["deploy.md"]["retrieved_by"] in ("text+vector", "graph", "text")
    assert sorted(r["rank"] for r in by.values()) == [1, 2, 3] and by["near.md"]["retrieved_by"] == "vector"
    assert "secret.md" in {r["path"] for r in base.hybrid("deploy", embedder=vectors_of, identities=["user:ana"])[0].collect()}
    assert [r["path"] for r in base.hybrid("deploy", arms=("graph",), sources=["docs"])[0].collect()] == ["deploy.md"]
    # A changed text's vector is masked, and the next run gives it a new one.
    base.ingest(spark.createDataFrame([("docs", "near.md", "qqq", None)], SCHEMA))
    assert base.hybrid("yolped", arms=("vector",), embedder=vectors_of, sources=["docs"])[0].collect() == [] and base.embed(vectors_of) == 1
    assert base.compact() and base.hybrid("qqq", arms=("vector",), embedder=vectors_of, sources=["docs"])[0].first()["path"] == "near.md"
