import random

import pytest

from strataq.operators import digest

R = random.Random(3)
EDGES = [(f"n{R.randint(0, 400)}", f"n{R.randint(0, 400)}", R.choice(["contains", "imports", None])) for _ in range(1500)]
SCHEMA = "from_node string, to_node string, type string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def test_order_partitions_and_columns_do_not_matter(spark, edges):
    one = digest.root(digest.tree(edges.repartition(7)))
    mixed = EDGES[:]
    R.shuffle(mixed)
    assert one == digest.root(digest.tree(spark.createDataFrame(mixed, SCHEMA).select("type", "to_node", "from_node"))) and len(one) == 64
    others = [EDGES[1:], [*EDGES, EDGES[0]], [(*EDGES[0][:2], "other"), *EDGES[1:]], [(EDGES[0][1], EDGES[0][0], EDGES[0][2]), *EDGES[1:]]]
    assert one not in {digest.root(digest.tree(spark.createDataFrame(rows, SCHEMA))) for rows in others}
    assert digest.root(digest.tree(edges.limit(0))) == ""


def test_a_changed_edge_is_found_by_few_digests(spark, edges):
    before = digest.tree(edges).cache()
    removed, added = EDGES[10:11], [("n7", "fresh", "imports")]
    now = spark.createDataFrame(EDGES[:10] + EDGES[11:] + added, SCHEMA)
    after = digest.updated(before, spark.createDataFrame(added, SCHEMA), spark.createDataFrame(removed, SCHEMA)).cache()
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, digest.tree(now).collect()))
    leaves, read = digest.changed(before, after)
    assert 1 <= len(leaves) <= 2 and read <= 2 * (1 + 2 * 16 * digest.DEPTH) < before.count()
    assert sorted(map(tuple, digest.difference(edges, now, leaves).collect())) == sorted([(*removed[0], "removed"), (*added[0], "added")])
    assert digest.changed(before, before) == ([], 2) and digest.changed(before, before.limit(0))[0] == sorted({r["prefix"] for r in before.collect() if len(r["prefix"]) == digest.DEPTH})
    before.unpersist(), after.unpersist()
