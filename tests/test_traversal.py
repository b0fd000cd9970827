"""Neighbourhoods and paths against plain searches over random graphs."""

import itertools
import random
from collections import deque

import pytest

from strataq.operators import traversal

R = random.Random(12)
NODES = [f"n{i:02}" for i in range(40)]
TYPES = {n: R.choice(["file", "folder", "concept"]) for n in NODES}
EDGES = sorted({(R.choice(NODES[:35]), R.choice(NODES[:35]), R.choice(["contains", "imports", "mentions"])) for _ in range(70)} | {("n00", "n01", "imports"), ("n00", "n01", "contains"), ("n36", "n37", "imports")})


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(list(TYPES.items()), "node_id string, type string")
    return nodes, spark.createDataFrame(EDGES + EDGES[:5], "from_node string, to_node string, type string").repartition(3)


def plain(start, depth, most=None, deny_edges=(), deny_nodes=()):
    queue, seen, out = deque([(start, 0, [start])]), {start}, []
    while queue:
        node, d, path = queue.popleft()
        if d >= depth:
            continue
        by = {}
        for a, b, t in EDGES:
            if a == node and t not in deny_edges:
                by.setdefault(b, set()).add(t)
        for b in sorted(by, key=lambda b: ("contains" not in by[b], b)):
            if b in seen or TYPES[b] in deny_nodes or (most is not None and len(out) >= most):
                continue
            seen.add(b)
            out.append((b, d + 1, [*path, b], sorted(by[b])))
            queue.append((b, d + 1, [*path, b]))
    return out


@pytest.mark.parametrize(("start", "depth", "most", "deny_edges", "deny_nodes"), [("n00", 1, None, [], []), ("n03", 3, None, ["mentions"], []), ("n00", 4, 9, [], ["concept"]), ("n00", 3, 6, [], []), ("n39", 2, 5, [], []), ("nowhere", 2, None, [], [])])
def test_neighbourhoods(graph, start, depth, most, deny_edges, deny_nodes):
    nodes, edges = graph
    found = traversal.neighbourhood(edges, start, depth, exclude_edge_types=deny_edges, nodes=nodes, exclude_node_types=deny_nodes, max_nodes=most)
    wanted = plain(start, depth, most, deny_edges, deny_nodes)
    if most is None:
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
    else:
        assert [tuple(r)[1:] for r in found.orderBy("place").collect()] == wanted


def test_parts_say_whether_they_are_whole(graph):
    nodes, edges = graph
    for limit in (4, 100):
        near, links, more = traversal.part_of(nodes, edges, "n00", 3, limit)
        wanted = plain("n00", 3, limit)
        assert {r["node_id"]: r["depth"] for r in near.collect()} == {"n00": 0} | {n: d for n, d, *_ in wanted}
        inside = {"n00", *(n for n, *_ in wanted)}
        assert {tuple(r) for r in links.collect()} == {e for e in EDGES if e[0] in inside and e[1] in inside}
        assert more == (len(plain("n00", 3)) > limit)


@pytest.mark.parametrize("named", [200, 0])
def test_paths(graph, monkeypatch, named):
    monkeypatch.setattr(traversal, "NAMED", named)
    _, edges = graph
    near = {n: set() for n in NODES}
    for a, b, _ in EDGES:
        near[a].add(b)
        near[b].add(a)

    def least(a, b):
        paths = [[a]]
        for _ in range(8):
            done = [p for p in paths if p[-1] == b]
            if done:
                return min(done)
            paths = [[*p, n] for p in paths for n in near[p[-1]] if n not in p]
        return []

    pairs = [("n00", "n20"), ("n05", "n33"), ("n36", "n37"), ("n00", "n39"), ("n02", "n02")]
    assert [traversal.path(edges, a, b) for a, b in pairs] == [least(a, b) if a != b else [a] for a, b in pairs]
    far = max(itertools.combinations(NODES[:20], 2), key=lambda p: len(least(*p)))
    long = least(*far)
    assert len(long) > 4 and traversal.path(edges, *far) == long and traversal.path(edges, *far, max_depth=len(long) - 2) == []
    assert traversal.path(edges, *far, max_visited=2) == []
