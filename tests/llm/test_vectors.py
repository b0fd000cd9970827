"""Operators over embeddings against brute force, with copies, ties, odd lengths, nulls and extra columns."""

import random

import numpy as np
import pytest

from strataq.llm import near_vectors, vector_codes, whitening

R = random.Random(11)
SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, code int, kept string"


def frame(spark, rows, parts=5):
    """(id, vector, label) with extra columns of clashing names, over several partitions."""
    return spark.createDataFrame([(*r, 7, "x", 1, "y") for r in rows], SCHEMA).repartition(parts)


def floored(v):
    return [int(np.floor(256 * float(np.float32(c)))) for c in v]


def noisy(v, much=0.02):
    return [c + R.gauss(0, much) for c in v]


#: Rows that take no part, and a vector of another length.
ODD = [(9001, None, 1), (9002, [None] * 6, 1), (9003, [float("nan")] * 6, 1), (9004, [float("inf")] + [0.0] * 5, 2), (None, [0.5] * 6, 1), (9005, [0.25, 0.5], 1), (9006, [], 1)]


def test_whitening(spark):
    base = [(i, [R.gauss(0, 1 + k) for k in range(6)], i % 3) for i in range(150)]
    rows = base + [(1000 + i, base[0][1], 0) for i in range(90)] + ODD
    found = whitening.whiten(frame(spark, rows)).collect()
    good = [(i, floored(v)) for i, v, _ in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    n, deviations, values, white, trace = whitening.plain_whiten([v for _, v in good])
    assert n == 151
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == 4 * len(good) + 2  # of the vector of two dimensions, two
    sign = [np.sign(by[0, k + 1]["whitened"] * white[0, k]) for k in range(4)]
    for (i, _), deviation, w in zip(good, deviations, white, strict=True):
        for k in range(4):
            r = by[i, k + 1]
            assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (n, deviation, deviation)
            assert r["whitened"] == pytest.approx(sign[k] * w[k], abs=1e-9)
            assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-12)
            assert 0 <= r["identity_error"] < 1e-9
    alone = by[9005, 1]
    assert (alone["n"], alone["deviation"], alone["whitened"], alone["explained"]) == (1, 0, None, None)


def test_whitening_beyond_longs_and_without_variance(spark):
    rows = [(i, [float(i % 2) * 2.0**40, 1.0, float(i) * 2.0**40], 0) for i in range(20)]
    found = {(r["vec_id"], r["component"]): r for r in whitening.whiten(frame(spark, rows)).collect()}
    _, deviations, values, _, trace = whitening.plain_whiten([floored(v) for _, v, _ in rows], 1)
    for i in range(20):
        assert int(found[i, 1]["deviation_exact"]) == deviations[i] and found[i, 1]["deviation"] is None
        assert found[i, 1]["explained"] == pytest.approx(values[0] / trace, rel=1e-9)
        assert found[i, 3]["whitened"] is None and found[i, 3]["explained"] == 0 and found[i, 1]["identity_error"] < 1e-9
    assert whitening.whiten(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize(("size", "many"), [(32, 200), (19, 90), (5, 40)])
def test_codes(spark, size, many):
    base = [(i, [R.choice([-0.4, 0.1, 0.1, 0.3]) + R.choice([0, 0.01]) for _ in range(size)], [0, 1, None][i % 3]) for i in range(many)]
    rows = base + [(2000 + i, base[0][1], 0) for i in range(70)]
    odd = [o for o in ODD if o[0] is not None and o[0] < 9005]
    found = sorted(tuple(r) for r in vector_codes.compress(frame(spark, rows + odd)).collect())
    assert found == sorted(vector_codes.plain_compress([(i, floored(v), label) for i, v, label in rows]))
    assert len({r[1] for r in found}) > 20


def test_codes_of_lengths_and_large_numbers(spark):
    """Each length has its own codebooks; rows without an id come last; errors beyond long are null."""
    rows = [(i, [0.1 * i] * 16, 1) for i in range(70)] + [(100 + i, [0.2, 0.4 * i], 2) for i in range(3)] + [(None, [0.9] * 16, 2), (200, [], 3), (201, [1e16] * 16, 4), (202, [2e16] * 16, 4)]
    found = {r["vec_id"]: r for r in vector_codes.compress(frame(spark, rows)).collect()}
    assert len(found) == len(rows) and len({r["codebooks_sha256"] for r in found.values()}) == 3
    assert found[102]["code"] == "0002" + "00" * 14 and found[200]["code"] == "00" * 16 and found[200]["error"] == 0
    assert found[201]["error"] is found[202]["error"] is found[202]["label_error"] is None and found[69]["error"] is not None
    assert vector_codes.compress(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("limits", [{}, {"block": 16, "at_once": 3}])
def test_near_vectors(spark, limits):
    """Groups of near copies, exact copies of a third of all rows, a chain of links, and the same vectors under other labels."""
    base = [[R.gauss(0, 1) for _ in range(24)] for _ in range(200)]
    rows = [(i, v, i % 3) for i, v in enumerate(base)]
    rows += [(500 + i, noisy(base[3], 0.05), 0) for i in range(60)] + [(700 + i, base[4], 1) for i in range(150)] + [(900 + i, base[5], None) for i in range(4)]
    step, at = base[6], 1200
    for _ in range(6):
        step = noisy(step, 0.28)
        rows.append((at, step, 0))
        at += 1
    rows += [(1300, [0.0] * 24, 0), (1301, [0.0] * 24, 0), (1302, [c * 2 for c in base[3]], 0), (1303, [1e-38] + [0.0] * 23, 0), (1304, [1e38] + [0.0] * 23, 0)]
    rows += [(i, v, label) for i, v, label in ODD if i is not None]
    found = {r["vec_id"]: r for r in near_vectors.near_duplicates(frame(spark, rows), **limits).collect()}
    plain = near_vectors.plain_near([(i, [None if c is None else float(np.float32(c)) for c in v] if v is not None else None, label) for i, v, label in rows])
    assert len(found) == len(rows)
    assert {i: (r["n_links"], r["component_id"]) for i, r in found.items()} == plain
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert plain[700][0] == 150 and plain[500][0] > 50 and plain[1304] == (1, 1303)


def test_near_vectors_of_repeated_and_null_ids(spark):
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (5, [1.0, 0.02], 1), (7, [0.0, 1.0], 1), (None, [-1.0, 0.0], 1), (8, [-0.0, 1.0], 1)]
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert found == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 1, 7, True), (None, 0, None, True), (8, 1, 7, False)], key=str)
    assert near_vectors.near_duplicates(frame(spark, rows).limit(0)).collect() == []


def test_plan_of_tables_meets_the_recall():
    """Measured over pairs just at the threshold, in many dimensions."""
    bits, tables = near_vectors.plan(64 * 256)
    assert bits == 8 and near_vectors.plan(1)[0] == 4
    rng = np.random.default_rng(3)
    planes = rng.standard_normal((48, bits * tables))
    x = rng.standard_normal((4000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((4000, 48))
    y -= (x * y).sum(axis=1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1)[:, None]
    same = ((x @ planes > 0) == (y @ planes > 0)).reshape(4000, tables, bits).all(axis=2).any(axis=1)
    assert same.mean() > 0.998
