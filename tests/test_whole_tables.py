"""Queries read whole tables: small tables whose ids lie where filters on ids once cut, against brute force."""

import itertools
import random

import pytest

from strataq.plans import catalog

R = random.Random(8)


@pytest.fixture
def run(spark, tmp_path):
    def go(query, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return catalog.queries()[query](spark, str(tmp_path)).collect()

    return go


@pytest.mark.parametrize("query", ["gr10_similarity", "j10_shared_terms"])
def test_shared_suppliers_of_all_orders(run, query):
    own = {o: {R.randint(1, 9) for _ in range(R.choice([1, 2, 2, 3, 6]))} | ({0} if o % 3 else set()) for o in range(1985, 3050, 18)}  # many have supplier 0
    found = run(query, lineitem=([(o, s) for o, terms in own.items() for s in [*terms, min(terms)]], "l_orderkey long, l_suppkey long"))
    wanted = set()
    for a, b in itertools.combinations(sorted(own), 2):
        shared, total = len(own[a] & own[b]), len(own[a] | own[b])
        if query[0] == "j" and shared >= 2:
            wanted.add((a, b, shared))
        elif query[0] == "g" and min(len(own[a]), len(own[b])) >= 2 and (shared >= 2 or shared / total >= 0.25):
            wanted.add((a, b, shared, round(shared / total, 3)))
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted and max(a for a, *_ in wanted) > 3000


@pytest.fixture
def conversations():
    words = ["red", "green", "blue", "one", "two"]
    rows = [(c, t, R.choice(["user", "assistant"]), " ".join(R.choices(words, k=R.randint(2, 6)))) for c in [*range(3, 9), *range(260, 500, 6)] for t in range(4)]
    return rows, "conv_id long, turn long, role string, text string"


def test_similar_records_of_all_conversations(spark, run, conversations, tmp_path):
    found = {(r["a"], r["b"]): r["jaccard"] for r in run("tm13_pairs", conversations=conversations)}
    clusters = {r["record_id"]: r["canonical"] for r in catalog.queries()["tm13_clusters"](spark, str(tmp_path)).collect()}
    records = []
    for c, t, role, text in conversations[0]:
        scope, subject = ("org", "user", "session")[c % 3], f"Topic {c % 20}" if c % 7 else ""
        kind = "preference" if (c + t) % 11 == 0 else "alias" if (c + t) % 13 == 0 else "fact"
        records.append((f"mem-{c}-{t}", (scope, subject, kind, "" if scope == "org" else role), set(text.split())))
    wanted = {}
    for (a, of_a, x), (b, of_b, y) in itertools.combinations(sorted(records), 2):
        if of_a == of_b and x & y:
            wanted[a, b] = round(len(x & y) / len(x | y), 6)
    assert found == pytest.approx(wanted) and clusters.keys() == {r for pair in wanted for r in pair}
    assert any(a > "mem-26" for a in clusters.values())


def test_mean_jaccard_of_all_conversations(run, conversations):
    words: dict = {}
    for c, _, _, text in conversations[0]:
        words.setdefault(c, set()).update(text.split())
    scores = [len(x & y) / len(x | y) for x, y in itertools.combinations(words.values(), 2)]
    [found] = run("ag22_mean_jaccard", conversations=conversations)
    assert found["mean_jaccard"] == pytest.approx(sum(scores) / len(scores), abs=1e-4)


def test_json_of_all_events(run):
    found = run("sql_json", events=([(i, f'{{"k": {i}}}') for i in range(10)], "event_id long, props string"))
    assert sorted(tuple(r) for r in found) == [(i, str(i)) for i in range(10)]


def test_graph_has_all_levels(spark, run, tmp_path):
    tables = {
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(4, "JAPAN", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(7, "c", 4)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(5, "s", 4)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(2, "p"), (3, "q")], "p_partkey long, p_name string"),
        "orders": ([(9, 7)], "o_orderkey long, o_custkey long"),
        # Two rows are the same line; no quantity is over 45.
        "lineitem": ([(9, 1, 2, 5, 1.0), (9, 1, 2, 5, 45.0), (9, 2, 3, 5, 2.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"),
        "documents": ([(1, "see https://a.b/c and https://a.b/c", "en", "src0"), (2, "none", "fr", "src0")], "doc_id long, text string, lang string, source string"),
    }
    assert {tuple(r) for r in run("ag5_edge_types", **tables)} == {("contains", 3 + 1 + 2 + 2 + 2), ("references", 3), ("links_to", 1)}
    ask = lambda query: {tuple(r) for r in catalog.queries()[query](spark, str(tmp_path)).collect()}
    assert ask("j22_orphan_nodes") == set()
    assert ask("ag19_node_types") == {("region", 1), ("nation", 1), ("customer", 1), ("supplier", 1), ("part", 2), ("order", 1), ("lineitem", 2), ("source", 1), ("document", 2), ("chunk", 2), ("link", 1)}
    assert ask("sql_recursive") == {(0, 1), (1, 1), (2, 2), (3, 1)}
    assert ask("ag6_in_degree") == {("p", 2), ("q", 1)}
