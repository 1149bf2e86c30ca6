"""Whitening against a dense version in exact integers and numpy."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int, x string, n string, z string"


def plain(rows):
    usable = [(i, [math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = {x: [(n * c - s) for c, s in zip(x, sums)] for x in fit}
    m = np.array([[c / n for c in centred[x]] for x in fit])
    values, basis = np.linalg.eigh(m.T @ m / n)
    return usable, n, centred, values[::-1], basis[:, ::-1]


def made(seed=1, n=300, d=20):
    rng = np.random.default_rng(seed)
    m = (rng.normal(size=(n, d)) * np.linspace(3, 0.2, d)).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(m)] + [(1000 + k, m[7]) for k in range(150)] + [(2000, None), (2001, m[0][:-1] + [None]), (2002, m[0][:-1] + [float("nan")]), (2003, m[0][:-1] + [float("inf")])]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "slab_blocks": 3, "slabs_at_once": 2}])
def test_whitening_equals_a_dense_version(spark, sizes):
    rows = made()
    frame = spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], ROWS).repartition(3)
    got = whitening.whiten(frame, **sizes).collect()
    usable, n, centred, values, basis = plain(rows)
    assert len(got) == 16 * len(usable) and {r.n for r in got} == {n}
    x = dict(usable)
    for c in range(1, 17):
        own = {r.vec_id: r for r in got if r.component == c}
        assert own.keys() == x.keys()
        expected = {i: float(np.dot(centred[tuple(v)], basis[:, c - 1]) / n / math.sqrt(values[c - 1])) for i, v in usable}
        turned = 1 if expected[0] * own[0].whitened > 0 else -1
        assert max(abs(turned * own[i].whitened - e) for i, e in expected.items()) < 1e-8
        assert all(abs(r.explained - values[c - 1] / values.sum()) < 1e-12 for r in own.values())
    assert all(r.deviation == sum(c * c for c in centred[tuple(x[r.vec_id])]) for r in got)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_few_vectors_and_dimensions(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame([(i, v, 0, "", "", "") for i, v in rows], ROWS)).collect()
    assert make([]) == [] and make([(1, None), (2, []), (3, [float("nan")])]) == []
    one = make([(1, [0.5, 2.0]), (2, [0.5, 2.0]), (3, [1.0])])  # a shorter vector takes no part
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = make([(1, [0.5, 2.0]), (2, [1.5, 2.0])])  # the second dimension doesn't vary
    assert {(r.component, r.explained) for r in flat} == {(1, 1.0), (2, 0.0)}
    assert all(abs(abs(r.whitened) - 1) < 1e-12 if r.component == 1 else r.whitened is None for r in flat) and flat[0].identity_error < 1e-12


def test_long_deviations_and_huge_entries(spark):
    rows = [(1, [1e6, 0.0]), (2, [-1e6, 3.0]), (3, [3e38, 1.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, "", "", "") for i, v in rows], ROWS)).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got)  # beyond a long
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, "", "", "") for i, v in rows[:2]], ROWS)).collect()
    assert {r.deviation for r in got} == {128_000_000**2 + 192**2}
