"""Sets that meet in blocks against all pairs, with blocks, strips and sums so small that all of them are many."""

import itertools
import random

import numpy as np
import pytest

from strataq.operators import setjoin

R = random.Random(3)


@pytest.fixture(params=[(2_000_000, 8192, 1 << 20, 1 << 22, 0.01, 1024), (150, 20, 40, 16, 0.2, 3), (400, 1000, 1, 1, 2.0, 0), (50, 7, 1000, 1000, 0.0, 9)])
def blocks(request, monkeypatch):
    for name, value in zip(("TOKENS", "SETS", "CELLS", "ONES", "DENSE", "COLUMNS"), request.param, strict=True):
        monkeypatch.setattr(setjoin, name, value)


def made(n):
    common = ["the", "of", "in"]
    return [(i, sorted({*R.sample(common, R.randint(0, 3)), *(f"w{R.randint(0, 70)}" for _ in range(R.randint(0, 12))), *([f"own{i}"] if i % 2 else [])})) for i in range(n)]


def test_low_similarities(spark, blocks):
    """no row for each token that two sets share."""
    rows = [(R.choice(["p", "p", "q", None]), f"r{i}", t) for i, t in made(90)]
    rows += [("p", f"s{i}", rows[0][2] or ["x"]) for i in range(8)]
    wanted = {}
    for (b, i, x), (c, j, y) in itertools.combinations([(b, i, set(t)) for b, i, t in rows], 2):
        if b == c and x & y and len(x & y) >= 0.05 * len(x | y):
            low, high = sorted([(i, len(x)), (j, len(y))])
            wanted[low[0], high[0]] = (low[1], high[1], len(x & y))
    found = setjoin.similar(spark.createDataFrame(rows, "bucket string, id string, tokens array<string>"), 0.05).collect()
    assert len(found) == len(wanted) and {(r["a"], r["b"]): (r["na"], r["nb"], r["shared"]) for r in found} == wanted


def test_low_similarities_dont_meet_by_token(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "_by_prefix", None)
    sets = spark.createDataFrame([("p", i, ["the", f"a{i}"]) for i in range(60)], "bucket string, id int, tokens array<string>")
    assert setjoin.similar(sets, 0.05).count() == 60 * 59 // 2


def test_mean_of_all_pairs(spark, blocks):
    """sets without a partner count, and so do those that share nothing."""
    sets = made(70)
    scores = [len(x & y) / len(x | y) for x, y in itertools.combinations([set(t) for _, t in sets if t], 2)]
    rows = spark.createDataFrame([(i, w) for i, t in sets for w in t] + [(None, "the"), (1, None)], "id long, token string")
    assert setjoin.mean_jaccard(rows).collect()[0][0] == pytest.approx(np.mean(scores), abs=5.1e-5)


def test_mean_of_few(spark):
    mean = lambda *rows: setjoin.mean_jaccard(spark.createDataFrame(list(rows), "id long, token string")).collect()[0][0]
    assert mean() is None and mean((1, "a")) is None and mean((1, "a"), (2, "b")) == 0.0 and mean((1, "a"), (2, "a"), (3, "b")) == 0.3333
