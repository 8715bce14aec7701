import math
import random

import numpy as np
import pytest

from veilwork.llm import queries
from veilwork.llm import whitening as w

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    """{(vec_id, component): ...} and what numpy's own eigenvectors give."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return [i for i, _ in kept], n, deviation, centred @ u / np.sqrt(e), e / np.trace(cov)


def check(got, rows, k):
    ids, n, deviation, white, explained = brute(rows, k)
    assert len(got) == len(ids) * k
    table = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        mine = np.array([table[i, c + 1].whitened for i in ids])
        sign = 1 if mine @ white[:, c] > 0 else -1
        assert np.abs(mine - sign * white[:, c]).max() < 1e-6
        assert all(abs(table[i, c + 1].explained - explained[c]) <= 1e-9 * explained[c] for i in ids)
    assert {(i, table[i, 1].n, table[i, 1].deviation) for i in ids} == {(i, n, d) for i, d in zip(ids, deviation)}
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_query_against_numpy(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op13_whitening(spark, SF).collect(), rows, 8)


def test_odd_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.3), rnd.gauss(0.5, 0.1), -0.1]) for i in range(60)]
    odd = [(100, None), (101, [None, 1.0, 1.0]), (102, [math.nan, 0.0, 0.0]), (103, [math.inf, 0.0, 0.0]), (104, [0.0]), (105, []), (106, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, whitened string").repartition(5)
    got = w.whitened_rows(df, 8).collect()
    check(got, rows, 2)  # the third dimension never changes, so there are two components


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3])
def test_nothing_to_whiten(spark, rows):
    out = w.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 8)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.collect() == []


def test_repeated_rows_and_large_entries(spark):
    rows = [(i % 7, [float(i % 5) * 2.0**30, float(i % 3), 0.5 * (i % 2)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = w.fit(w.remaining(df)[0], "embedding", 3)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    got = w.whiten(df, model, 3).collect()
    want = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    assert sorted(r.deviation or -1 for r in got) == sorted(d if d < 1 << 63 else -1 for d in want)
    assert model.n == n and model.sums == list(s)


def test_factor_and_rotations():
    rnd = np.random.default_rng(1)
    for shape in ((12, 12), (12, 30), (30, 12)):
        a = rnd.normal(size=shape)
        v = a @ a.T
        factor, order = w.pivoted_cholesky(v)
        assert factor.shape[1] == min(shape)
        assert np.allclose(factor @ factor.T, v[np.ix_(order, order)])
        values, components = w.components_of(v)
        assert np.allclose(components @ components.T, np.eye(len(values)), atol=1e-12)
        assert np.allclose(components.T * values @ components, v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)])
