import json

from pyspark.sql import functions as F

from strataq.functions import words
from strataq.operators import upkeep
from strataq.operators.policy import MemoryPolicy
from strataq.sources import graphs


def test_words_of_names(spark):
    found = spark.createDataFrame([("getHTTPName_v2",), ("--",), (None,)], "n string").select(words.term(F.col("n")).alias("t"), words.slug(F.col("n")).alias("s")).collect()
    assert [tuple(r) for r in found] == [("get httpname v2", "gethttpname_v2"), ("item item", "item"), (None, None)]


def test_node_index(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "file", "Deploy-Guide"), ("b", "file", "deployment"), ("c", "term", None)], "node_id string, type string, label string")
    upkeep.write_node_index(nodes, str(tmp_path / "index"), 2)
    terms = spark.read.parquet(str(tmp_path / "index"))
    assert [r["node_id"] for r in upkeep.node_candidates(terms, ["DEPLOY"]).collect()] == ["a", "b"]
    assert upkeep.node_candidates(terms, ["deploy", "term"], 1).count() == 1 and upkeep.node_candidates(terms, ["d"]).count() == 0


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "file", 'q"uote'), ("b", "file", None)], "node_id string, type string, label string")
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "b", "c")], "from_node string, to_node string, type string")
    rows = graphs.canonical_rows(nodes, edges).orderBy("part", "id", "target", "key").collect()
    text = {part: [json.loads(r["data"]) for r in rows if r["part"] == part] for part in ("nodes", "links")}
    assert [(e["key"], e["type"]) for e in text["links"]] == [(0, "c"), (1, "x")]
    for name, links in (("new", "links"), ("old", "edges")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"directed": True, "nodes": text["nodes"], links: text["links"]}, indent=1))
        n, e = graphs.read_node_link(spark, str(tmp_path / f"{name}.json"))
        assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect())) and sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.collect()))


def test_policies_that_hide_nothing(spark):
    record = spark.createDataFrame([("r", "fact", "org", "s", "hot", None, None)], "record_id string, kind string, scope string, subject string, tier string, valid_from string, valid_until string")
    assert not upkeep.may_filter(record, MemoryPolicy(), "2024") and upkeep.may_filter(record, MemoryPolicy(mode="off"), "2024")
