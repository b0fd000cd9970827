"""Similar sets against all pairs, with copies, buckets, frequent tokens and sets that only share those."""

import itertools
import random

import pytest

from strataq.operators import setjoin

R = random.Random(9)


def made():
    rows = []
    for i in range(140):
        tokens = {"the", "of"} | {f"w{R.randint(0, 60)}" for _ in range(R.randint(0, 9))}
        rows.append((R.choice(["p", "q", None]), i, sorted(tokens)))
    rows += [("p", 200 + i, rows[3][2]) for i in range(12)] + [("q", 300, []), ("q", 301, None), ("p", 302, ["the"]), ("p", 303, ["the", None, "the"])]
    return rows + [(b, 400 + i, [*t[:-1], "new"]) for b, i, t in rows[:40]]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_all_pairs(spark, least):
    rows = made()
    wanted = {}
    for (b, i, x), (c, j, y) in itertools.combinations([(b, i, {w for w in t or [] if w}) for b, i, t in rows], 2):
        if b == c and x and y and len(x & y) >= least * len(x | y) - 1e-12:
            low, high = sorted([(i, len(x)), (j, len(y))])
            wanted[low[0], high[0]] = (low[1], high[1], len(x & y))
    found = setjoin.similar(spark.createDataFrame(rows + [("p", None, ["a"])], "bucket string, id int, tokens array<string>").repartition(3), least).collect()
    assert len(found) == len(wanted) and {(r["a"], r["b"]): (r["na"], r["nb"], r["shared"]) for r in found} == wanted


def test_frequent_tokens_bring_none_together(spark):
    """Each set has 'the' and three words of its own: its prefix for 0.6 is of these, so no candidate meets another."""
    rows = [("p", i, ["the", f"a{i}", f"b{i}", f"c{i}"]) for i in range(300)]
    sets = spark.createDataFrame(rows, "bucket string, id int, tokens array<string>")
    order = {r["id"]: r["t"] for r in setjoin.ordered(sets).collect()}
    common = set.intersection(*(set(t) for t in order.values()))
    assert len(common) == 1 and all(t[-1] in common for t in order.values())
    assert setjoin.similar(sets, 0.6).collect() == [] and setjoin.similar(sets.limit(0), 0.6).collect() == []
