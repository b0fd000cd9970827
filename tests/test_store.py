"""Versions, leases, retention and restore of a store, and ingests of a base that meet or are killed."""

import glob
import threading
import time

import pytest

from strataq.kb import KnowledgeBase
from strataq.store import Conflict, Run, Store, Version

DOCS = "source string, path string, text string"


def docs(spark, source, *texts):
    return spark.createDataFrame([(source, f"{i}.md", t) for i, t in enumerate(texts)], DOCS)


@pytest.fixture
def base(spark, tmp_path):
    return KnowledgeBase(spark, str(tmp_path / "kb"))


def texts(base):
    return sorted(r["text"] for r in base.chunks().collect())


def test_a_number_is_taken_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": "x int"})
    wins, ready = [], threading.Barrier(8)

    def take(i):
        ready.wait()
        if store._create("_versions/000000000001", {"number": 1, "runs": [], "facts": {"by": i}}):
            wins.append(i)

    threads = [threading.Thread(target=take, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(wins) == 1 and store.version().facts == {"by": wins[0]}


def test_commits_are_laid_on_top_or_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": "x int"})
    start = store.version()
    add = lambda name, keys: lambda head: Version(0, [*head.runs, Run(name, head.number, keys)], head.facts)
    assert store.commit(start, add("a", ["k1"]), ["k1"]).number == 1
    assert [r.name for r in store.commit(start, add("b", ["k2"]), ["k2"]).runs] == ["a", "b"]
    with pytest.raises(Conflict):
        store.commit(start, add("c", ["k1"]), ["k1"])
    with pytest.raises(Conflict):
        store.commit(start, add("c", []))
    assert store.version().number == 2 and store.version(1).runs[0].name == "a" and store.version(0).runs == []


def test_two_ingests_lose_nothing(base, spark):
    """The second begins and ends while the first is writing: another source, then the same one."""
    write, once = base.store.write, []

    def meanwhile(table, run, rows):
        if table == "postings" and not once:
            once.append(run)
            KnowledgeBase(spark, base.folder).ingest(docs(spark, "b", "from b"))
        if table == "postings" and len(once) == 1 and base.version() == 2:
            once.append(run)
            KnowledgeBase(spark, base.folder).ingest(docs(spark, "a", "newer", "second"))
        write(table, run, rows)

    base.store.write = meanwhile
    base.ingest(docs(spark, "a", "first"))
    assert texts(base) == ["first", "from b"] and base.version() == 2
    base.ingest(docs(spark, "a", "third"))
    base.store.write = write
    # The ingest of "third" was done again on top of "newer" and "second", which it replaces.
    assert texts(base) == ["from b", "third"] and len(once) == 2 and base.version() == 4
    assert base.search("second").count() == 0 and base.search("third").count() == 1


def test_two_writers_at_once(base, spark):
    done = []
    threads = [threading.Thread(target=lambda s=s: done.append(KnowledgeBase(spark, base.folder).ingest(docs(spark, s, f"of {s}")).collect())) for s in "xyz"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert done == [[("added", 1)]] * 3 and texts(base) == ["of x", "of y", "of z"] and base.version() == 3


def test_a_killed_ingest_leaves_no_trace(base, spark):
    base.ingest(docs(spark, "a", "one", "two"))
    before, commit = texts(base), base.store.commit

    def killed(*a, **b):
        raise KeyboardInterrupt

    base.store.commit, base.store.release = killed, lambda run: None
    with pytest.raises(KeyboardInterrupt):
        base.ingest(docs(spark, "a", "three"))
    base.store.commit = commit
    assert texts(base) == before and base.search("three").count() == 0
    assert base.store.vacuum() == []  # its lease holds
    assert len(glob.glob(f"{base.folder}/chunks/run=*")) == 2
    assert len(base.store.vacuum(now=time.time() + 10 * 3600)) == 1
    assert texts(base) == before and len(glob.glob(f"{base.folder}/*/run=*")) == 6
    assert base.ingest(docs(spark, "a", "three")).collect() == [("changed", 1), ("deleted", 1)]


def test_compaction_among_ingests(base, spark):
    base.ingest(docs(spark, "a", "alpha beta", "beta gamma"))
    base.ingest(docs(spark, "a", "alpha beta", "gamma delta"))
    base.ingest(docs(spark, "b", "beta"))
    base.build_graph()
    hits = base.search("alpha beta gamma").collect()
    write = base.store.write

    def meanwhile(table, run, rows):
        if table == "memory":
            base.store.write = write
            KnowledgeBase(spark, base.folder).ingest(docs(spark, "b", "epsilon"))
        write(table, run, rows)

    base.store.write = meanwhile
    assert base.compact() and base.version() == 4
    assert texts(base) == ["alpha beta", "epsilon", "gamma delta"] and base.edges().count() == 3
    assert base.search("beta").count() == 1 and base.search("epsilon").count() == 1
    assert [h["chunk_id"] for h in base.search("alpha beta gamma").collect()] == [h["chunk_id"] for h in hits if ":b:" not in h["chunk_id"]]
    gone = base.store.vacuum(keep=1)
    assert len(gone) == 3 and texts(base) == ["alpha beta", "epsilon", "gamma delta"]


def test_tags_keep_and_restore(base, spark):
    base.ingest(docs(spark, "a", "old text"))
    base.store.tag("before")
    with pytest.raises(ValueError):
        base.store.tag("before")
    base.ingest(docs(spark, "a", "new text"))
    base.compact()
    assert base.store.vacuum(keep=1) and texts(base) == ["new text"] and base.store.damaged("before") == []
    base.store.restore("before")
    assert texts(base) == ["old text"] and base.search("old").count() == 1 and base.search("new").count() == 0
    # A digest doesn't depend on files or order, and sees a changed row.
    run = base.store.version().runs[0].name
    again = spark.createDataFrame(base.store.read("chunks").drop("run").collect(), base.store.schemas["chunks"])
    base.store.write("chunks", run, again.repartition(3))
    assert base.store.damaged("before") == []
    base.store.write("chunks", run, again.selectExpr("artifact_id", "chunk_index", "start_line", "heading_path", "text || '!' AS text"))
    assert base.store.damaged("before") == ["chunks"]
    with pytest.raises(ValueError):
        base.store.restore("before")
    base.store.untag("before")
    assert base.store.tags() == {}
