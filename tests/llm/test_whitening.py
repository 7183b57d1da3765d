"""Whitening against NumPy on the whole matrix, and rows that do not take part."""

import os

import numpy as np
import pytest

from colloquy.llm import queries, whitening

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
ROWS = "vec_id bigint, embedding array<float>, component string, n string, _x int, _id int"


def brute(vectors, components=32, weighted=True):
    """x of every vector, and for the fit list n, S, the leading axes and eigenvalues, and the trace."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = x if weighted else np.unique(x, axis=0)
    c = fit - fit.mean(axis=0)
    v = c.T @ c / len(fit)
    e, axes = np.linalg.eigh(v)
    return x, len(fit), fit.sum(axis=0), axes[:, ::-1][:, :components], e[::-1][:components], np.trace(v)


def check(rows, ids, vectors, components=32, weighted=True):
    x, n, s, axes, e, trace = brute(vectors, components, weighted)
    want = (x - s / n) @ axes / np.sqrt(e)
    deviation = ((n * x.astype(object) - s) ** 2).sum(axis=1)
    # Rows of one id in some order: match by their deviation as well.
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(rows) == len(ids) * len(e)
    signs = None
    for i, (d, dev) in enumerate(zip(ids, deviation)):
        own = got[d, dev]
        assert sorted(own) == list(range(1, len(e) + 1))
        line = np.array([own[c + 1][0].whitened for c in range(len(e))])
        if signs is None and np.abs(want[i]).min() > 1e-6:
            signs = np.sign(line * want[i])
        if signs is not None:
            np.testing.assert_allclose(line, signs * want[i], atol=1e-7)
    assert {r.n for r in rows} == {n}
    assert {round(r.explained / (e[r.component - 1] / trace), 9) for r in rows} == {1.0}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


@tables
def test_query_against_numpy(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = queries.QUERIES["op13_whitening"](spark, SF).collect()
    check(rows, [r.vec_id for r in given], [r.embedding for r in given])


def hot_rows(spark, seed=3):
    """A third of all rows hold one vector, others hold copies, and ids repeat."""
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (700, 6)) @ rng.normal(0, 1, (6, 6))
    vectors = [*base, *base[:100], *[base[5]] * 400]
    ids = [*range(690), *[3] * 10, *range(1000, 1500)]
    return ids, [[float(np.float32(v)) for v in row] for row in vectors]


@pytest.mark.parametrize("weighted", [True, False])
def test_copies(spark, monkeypatch, weighted):
    monkeypatch.setattr(whitening, "LEAST_HOT", 20)
    monkeypatch.setattr(whitening, "HOT_PART", 50)
    ids, vectors = hot_rows(spark)
    df = spark.createDataFrame([(i, v, "c", "n", 1, 2) for i, v in zip(ids, vectors)], ROWS).repartition(7)
    rows = whitening.whiten(df, components=4, weighted=weighted).collect()
    x, n, s, axes, e, trace = brute(vectors, 4, weighted)
    if weighted:
        check(rows, ids, vectors, 4)
    else:
        assert {r.n for r in rows} == {n} and n < len(ids)
    assert len(rows) == 4 * len(ids)


def test_rows_left_out(spark):
    ids, vectors = hot_rows(spark)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0] * 5 + [None], [1.0] * 5 + [nan], [inf] + [1.0] * 5, [-inf] * 6, [1e30] * 6, [1.0, 2.0]]
    df = spark.createDataFrame(
        [(i, v, "c", "n", 1, 2) for i, v in [*zip(ids, vectors), *((9000 + i, v) for i, v in enumerate(odd))]], ROWS
    )
    check(whitening.whiten(df).collect(), ids, vectors)


def test_nothing_to_whiten(spark):
    assert whitening.whiten(spark.createDataFrame([], ROWS)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], "", "", 0, 0) for i in range(5)], ROWS)
    assert whitening.whiten(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0], "", "", 0, 0) for i in range(3)], ROWS)
    rows = whitening.whiten(line).collect()
    assert [(r.component, r.n) for r in rows] == [(1, 3)] * 3 and rows[0].explained == pytest.approx(1)


def test_sums_and_deviations_are_exact():
    big = np.array([[1 << 40, -(1 << 41)], [5, 7], [(1 << 40) + 1, 0]], np.int64)
    fit = whitening.Fit(1 << 30, np.array([int(v) for v in big.sum(axis=0)], object) * (1 << 30), np.eye(2), np.ones(2), 2.0)
    centred = fit.centred(big)
    assert [[int(v) for v in row] for row in centred] == [
        [(1 << 30) * int(v) - int(s) for v, s in zip(row, fit.sums)] for row in big
    ]
    assert fit.deviation(centred) == [None] * 3  # beyond a long
    assert fit.deviation(np.array([[3, 4], [-(1 << 31), 5]])) == [25, (1 << 62) + 25]
