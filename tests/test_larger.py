"""What shows on larger tables only, on small ones that have it too; rows are those of the SQL."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from strataq import corpus
from strataq.operators import telemetry, vectors
from strataq.plans import catalog

R = random.Random(4)


@pytest.fixture
def both(spark, tmp_path):
    """(rows of a query, rows of its SQL) over small tables."""

    def go(query, **tables):
        con = duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        found = catalog.queries()[query](spark, str(tmp_path))
        wanted = con.sql(catalog.oracle_sql()[query])
        place = [found.columns.index(c) for c in wanted.columns]
        return sorted((tuple(r[i] for i in place) for r in found.collect()), key=repr), sorted(wanted.fetchall(), key=repr)

    return go


def test_pauses_end_within_seconds(both):
    """a day and half a second is more than a day."""
    start = datetime(2024, 1, 1, 0, 0, 0, 250_000)
    at = [timedelta(0), timedelta(days=1, milliseconds=500), timedelta(days=2, milliseconds=500), timedelta(days=3, milliseconds=499)]
    found, wanted = both("w14_debounce", events=([(i, start + t, 7) for i, t in enumerate(at)], "event_id long, ts timestamp_ntz, user_id long"))
    assert found == wanted == [(7, 1, 1), (7, 2, 3)]


def test_end_of_who_is_past_the_total(spark, both):
    """F8: events whose ids are beyond half the total."""
    found, wanted = both("w13_rates", events=([(e, e % 2) for e in (5, 6, 7, 8, 600_000, 600_001, 600_002)], "event_id long, user_id long"))
    assert found == wanted and [r[2] for r in found] == [-100_002.0, -100_001.0]
    samples = spark.createDataFrame([("a", 1, 10, 15), ("a", 2, 20, 15)], "k string, at long, done long, total long")
    assert [telemetry.throughput(samples, "k", 2.0, o).first()["eta"] for o in (False, True)] == [0.0, -0.5]


def test_shards_without_a_most(spark, both, monkeypatch):
    """no shard is over where none has a most; where one has, it is."""
    sizes = spark.createDataFrame([("a", 1_000_000, 10_000_000), ("b", 1, 10)], "source string, files long, nodes long")
    assert [r["over"] for r in telemetry.shards(sizes, 2).orderBy("source").collect()] == [True, False]
    assert [r["over"] for r in telemetry.shards(sizes, 2, most=None).collect()] == [False, False]
    with pytest.raises(ValueError):
        telemetry.shards(sizes, most=None)
    monkeypatch.setattr(telemetry.shards, "__defaults__", (None, 30))  # what a shard holds by default, as if the tables were large
    found, wanted = both("sl9_shards", customer=([(i, i % 5) for i in range(40)], "c_custkey long, c_nationkey int"))
    assert found == wanted and len(found) == 5


@pytest.mark.parametrize("most", ["4", "1000000"])
def test_walks_of_more_rows_than_a_session_allows(spark, both, most):
    """a recursive table ends with all its rows, however few the session lets it have."""
    before = spark.conf.get(corpus.ROWS_OF_RECURSION)
    spark.conf.set(corpus.ROWS_OF_RECURSION, most)
    none = {"region": "r_regionkey int, r_name string", "part": "p_partkey long, p_name string", "customer": "c_custkey long, c_nationkey int", "supplier": "s_suppkey long, s_nationkey int", "orders": "o_orderkey long, o_custkey long", "lineitem": "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", "documents": "doc_id long, text string, lang string, source string"}
    tables = {name: ([], schema) for name, schema in none.items()} | {"nation": ([(i, 0) for i in range(9)], "n_nationkey int, n_regionkey int")}
    try:
        found, wanted = both("sql_recursive", **tables)
    finally:
        spark.conf.set(corpus.ROWS_OF_RECURSION, before)
    assert found == wanted == [(0, 1), (1, 9)]


def test_embedding_of_many_texts_is_that_of_each(spark, monkeypatch):
    """directions of words are made together and kept, few or many; the vectors are the same to the last bit."""
    seeds = [0, 1, 2**32 - 1, 2**32, 2**63 + 5, 2**64 - 1]
    states = [np.random.PCG64(s).state["state"] for s in seeds]
    assert [{"state": s, "inc": i} for s, i in vectors._states(np.array(seeds, np.uint64))] == states
    texts = [" ".join(f"w{R.randint(0, 40) ** 2}" for _ in range(R.randint(0, 90))) for _ in range(60)] + ["", "Ünter ß 9", "one"]
    wanted = [vectors.stub_embedding(t) for t in texts]
    for words, piece in ((100_000, 10_000), (30, 7), (1, 1), (5, 100)):
        monkeypatch.setattr(vectors, "WORDS", words)
        monkeypatch.setattr(vectors, "PIECE", piece)
        stub = vectors._Stub(64)
        assert list(stub.each(texts)) == wanted
        assert len(stub.rows) <= max(words, piece)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, t string").repartition(3)
    assert {r["id"]: r["embedding"] for r in vectors.embed(rows, "id", "t").collect()} == dict(enumerate([*wanted, [0.0] * 64]))


def test_a_word_is_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(vectors, "_directions", lambda words, dim, of=vectors._directions: made.extend(words) or of(words, dim))
    stub = vectors._Stub(64)
    assert len(list(stub.each(["red car, blue car"] * 5))) == 5
    assert made == ["red", "car", "blue"]
