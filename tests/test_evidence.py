import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataq.functions import names
from strataq.operators import assembly, bridge, chunking, telemetry
from strataq.sources import connectors


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_names_in_texts(spark):
    text = "Call load_all or a.bc, then LoadAll 'The  Plan' and `x` for The Big House; NASA, load_ALL"
    found = spark.createDataFrame([(text,), (None,), ("",)], "text string").select(names.identifiers(F.col("text")).alias("i"), names.phrases(F.col("text")).alias("p"), names.entities(F.col("text")).alias("e")).collect()
    assert found[0]["i"] == ["load_all", "a.bc", "loadall"] and found[0]["p"] == ["the  plan"]
    assert found[0]["e"] == ["loadall", "nasa", "plan", "big house"]
    assert [list(r) for r in found[1:]] == [[[], [], []]] * 2


def test_first_signal_wins_and_targets_are_few(spark):
    records = spark.createDataFrame([("r1", "load_all of NASA"), ("r2", "about NASA"), ("r3", "nothing"), ("r4", None), (None, "NASA"), ("r5", "b_x a_x")], "record_id string, text string")
    references = spark.createDataFrame([("r1", "doc:1"), ("gone", "doc:2"), ("r2", None)], "record_id string, target string")
    symbols = spark.createDataFrame([("load_all", "s1"), *[("a_x", f"a{i}") for i in range(5)], *[("B_x", f"a{i}") for i in range(1, 3)], (None, "z")], "label string, target string")
    headings = spark.createDataFrame([], "label string, target string")
    entities = spark.createDataFrame([("the  Nasa", "e1"), ("NASA", "e1"), ("nasa", "e2")], "label string, target string")
    edges = bridge.about_edges(records, references, symbols, headings, entities)
    assert rows(edges.select("record_id", "target", "signal")) == [("r1", "doc:1", "reference"), ("r2", "e1", "entity"), ("r2", "e2", "entity"), ("r5", "a0", "symbol"), ("r5", "a1", "symbol"), ("r5", "a2", "symbol")]
    assert rows(bridge.coverage(records.where("record_id IS NOT NULL"), edges)) == [("entity", 1), ("reference", 1), ("symbol", 1), ("unbridged", 2)]
    pairs = spark.createDataFrame([("a", "b"), ("b", None), ("c", "x"), ("d", "")], "record_id string, other string")
    assert rows(bridge.succession(pairs, "other")) == [("a", "b")] and rows(bridge.succession(pairs, "other", False)) == [("b", "a")]


def test_neighbours_are_taken_once_and_in_turn(spark):
    passages = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.5), (3, "a", 0.1)], "rank int, node string, score double")
    edges = spark.createDataFrame([("a", f"n{i}") for i in range(3)] + [("b", f"n{i}") for i in range(5)] + [("a", "b"), ("a", "other")], "from_node string, to_node string")
    nodes = spark.createDataFrame([(f"n{i}", "file") for i in range(5)] + [("b", "file"), ("other", "term")], "node_id string, type string")
    assert rows(assembly.expanded(passages, edges, nodes, ["file"], 2)) == [("n0", "a", 0.4), ("n1", "a", 0.4), ("n2", "b", 0.2), ("n3", "b", 0.2)]
    assert assembly.expanded(passages.where("rank > 9"), edges, nodes, ["file"]).count() == 0


def test_chunks_of_a_document_are_chosen_by_value():
    assert assembly.choose_chunks([10] * 5, [], 50, False) == [0, 1, 2, 3, 4]
    assert assembly.choose_chunks([10] * 9, [6], 40, False) == [0, 5, 6, 7]
    assert assembly.choose_chunks([10] * 9, [6], 1000, True) == [0, 5, 6, 7]
    assert assembly.choose_chunks([10, 90, 10], [], 25, False) == [0, 2]
    assert assembly.choose_chunks([90, 10], [], 5, False) == [0]


def plain_documents(cited, artifacts, chunks, anchors, budget):
    """The same, one document after the other."""
    out, spent = [], 0
    for place, key in cited:
        own = sorted(c for c in chunks if c[0] == key)
        if not own or spent >= budget or place is None:
            continue
        path, size = artifacts[key]
        code = path.endswith(".py")
        allowance = min(24_000 if code else 6_000, budget - spent)
        blocks = [(f"--- {c[3]} ---\n" if c[3] else "") + c[4] for c in own]
        taken = assembly.choose_chunks([len(b) + 2 for b in blocks], [i for i, c in enumerate(own) if c[2] in anchors], allowance, size > 40_000 and not code)
        if len(taken) == 1 and len(blocks[0]) + 2 > allowance:
            text = blocks[0][:allowance]
        else:
            parts = []
            for before, at in zip([None, *taken], taken):
                if before is not None and at - before > 1:
                    parts.append(f"--- … {at - before - 1} chunk(s) omitted … ---")
                parts.append(blocks[at])
            if taken[-1] < len(blocks) - 1:
                parts.append(f"--- … {len(blocks) - 1 - taken[-1]} chunk(s) omitted … ---")
            text = "\n\n".join(parts)
        spent += len(text)
        out.append((place, key, len(blocks), len(taken), text))
    return sorted(out)


@pytest.mark.parametrize("budget", [60_000, 9_000, 700, 0])
def test_documents_equal_a_plain_version(spark, budget):
    cited = [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "none")]
    artifacts = {"a": ("x/a.md", 100), "b": ("b.py", 90_000), "c": ("c.md", 50_000), "d": ("d.txt", 10)}
    chunks = [(k, i, f"{k}{i}", f"l{i}" if i % 2 else "", k * (150 * (i % 4 + 1))) for k, n in (("a", 3), ("b", 30), ("c", 20), ("d", 40)) for i in range(n)]
    anchors = ["c7", "d20", "d21"]
    found = assembly.documents(
        spark.createDataFrame(cited, "place int, artifact_id string"), spark.createDataFrame([(k, *v) for k, v in artifacts.items()], "id string, relative_path string, size_bytes long"),
        spark.createDataFrame(chunks, "artifact_id string, chunk_index long, id string, label string, text string"), spark.createDataFrame([(a,) for a in anchors], "chunk_id string"), budget)
    assert sorted(map(tuple, found.collect())) == plain_documents(cited, artifacts, chunks, anchors, budget)


def test_pages_channels_and_wiki(spark):
    pages = spark.createDataFrame([("p", "T"), ("q", None)], "page_id string, title string")
    blocks = spark.createDataFrame([("1", "p", 2, "paragraph", "second", None, None), ("2", "p", 1, "toggle", "first", None, None), ("3", "2", 1, "code", "x", None, None), ("4", "3", 1, "quote", "deep", None, None), ("5", "4", 1, "quote", "too deep", None, None), ("6", "q", 1, "paragraph", None, None, None)],
        "block_id string, parent_id string, place int, type string, text string, checked boolean, language string")
    assert rows(connectors.page_markdown(pages, blocks)) == [("p", "# T\n\nfirst\n  ```\n  x\n  ```\n    > deep\nsecond\n"), ("q", "# untitled\n")]
    assert connectors.storage_text("<h2>A <b>b</b></h2><p>one</p><ul><li>x</li></ul><pre>c &amp; d</pre><p> </p>") == "## A b\n\none\n\n- x\n\n```\n\nc & d\n\n```"
    assert connectors.storage_text("just <b>text</b>") == "just text" and connectors.storage_text(None) == ""
    listed = spark.createDataFrame([("a", 10), ("b", None)], "p string, size_bytes long")
    assert connectors.within_budget(listed, 2, 10).count() == 2
    with pytest.raises(connectors.BudgetExceeded):
        connectors.within_budget(listed, max_files=1)
    connectors.register("two", lambda s, n: s.range(n))
    assert connectors.read_source(spark, "two", n=2).count() == 2


def test_versions_seen(spark):
    listing = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", None), ("d", "1")], "k string, v string")
    seen = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("gone", "7")], "k string, v string")
    assert rows(connectors.unread(listing, seen, "k", "v").select("k")) == [("a",), ("c",), ("d",)]
    assert rows(connectors.checkpoint(listing, seen, "k", "v")) == [("a", "2"), ("b", "1"), ("c", "1"), ("d", "1"), ("gone", "7")]


def test_labels_are_escaped_and_shards_balanced(spark):
    found = telemetry.histogram(spark.createDataFrame([('a"\n', 0.5), ('a"\n', None)], "l string, v double"), "v", ["l"], (0.1, 1.0))
    assert [r["line"] for r in telemetry.exposition(found, "m", ["l"], "About.", (0.1, 1.0)).collect()] == [
        "# HELP m About.", "# TYPE m histogram", 'm_bucket{l="a\\"\\n",le="0.1"} 0', 'm_bucket{l="a\\"\\n",le="1"} 1', 'm_bucket{l="a\\"\\n",le="+Inf"} 1', 'm_sum{l="a\\"\\n"} 0.5', 'm_count{l="a\\"\\n"} 1']
    sizes = spark.createDataFrame([("a", 5, 50), ("b", 4, 40), ("c", 3, 30), ("d", 0, 0)], "source string, files int, nodes int")
    assert rows(telemetry.shards(sizes, most=60)) == [("a", 5, 50, 1, False), ("b", 4, 40, 2, True), ("c", 3, 30, 2, True)]
    assert telemetry.shards(sizes.where("files < 0")).count() == 0


def test_lines_of_windows(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 50) for i in range(900))
    docs = pd.DataFrame({"doc_id": ["k"], "text": [text]})
    for r in chunking.chunk(spark.createDataFrame(docs), max_chars=500, overlap=60).collect():
        lines = text.split("\n")
        assert r["text"].split("\n")[-1] in lines[r["end_line"] - 1] and r["text"].split("\n")[0] in lines[r["start_line"] - 1] + "\n" + lines[r["start_line"]]
