"""Whitening against eigenvectors of the exact covariance, and the two factorisations by themselves."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from naskah.llm import whitening as W
from pyspark.sql import types as P

KINDS = P.StructType([
    P.StructField("vec_id", P.LongType()), P.StructField("embedding", P.ArrayType(P.FloatType())),
    P.StructField("label", P.IntegerType()), P.StructField("n", P.StringType()), P.StructField("component", P.StringType()),
])


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], None, "clash", None) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, KINDS)


def brute(vectors):
    """n, exact deviations, eigenvalues (falling), components as columns, x - mean."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    deviations = [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x]
    centred = [[Fraction(n * r[i] - sums[i], n) for i in range(d)] for r in x]
    v = [[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(v))
    return n, deviations, e[::-1], u[:, ::-1], np.array(centred, float)


def check(got, ids, vectors, limit=8):
    n, deviations, e, u, centred = brute(vectors)
    k = min(limit, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == k * len(ids)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(k):
        mine = np.array([by[i, c + 1].whitened for i in ids])
        want = centred @ u[:, c] / math.sqrt(e[c])
        sign = 1 if mine @ want > 0 else -1
        assert np.abs(sign * mine - want).max() < 1e-8
        assert {by[i, c + 1].explained for i in ids} == {got_explained := by[ids[0], c + 1].explained}
        assert got_explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
    for i, dev in zip(ids, deviations, strict=True):
        assert by[i, 1].deviation == dev


@pytest.mark.parametrize(("n", "d"), [(40, 12), (7, 3), (9, 16), (2, 5), (30, 1), (200, 33)])
def test_equals_eigenvectors(spark, n, d):
    r = np.random.default_rng(n * d)
    vectors = (r.normal(size=(n, d)) * np.linspace(3, 0.2, d)).tolist()
    frame = table(spark, vectors)
    first = sorted(W.whitened(frame).collect())
    check(first, list(range(n)), vectors)
    again = sorted(W.whitened(frame.repartition(5)).collect())
    # the model does not depend on the partitions; a projection may differ in its last bit with the block
    for x, y in zip(first, again, strict=True):
        assert (x[:4], x.explained) == (y[:4], y.explained) and x.whitened == pytest.approx(y.whitened, abs=1e-12)


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    good = r.normal(size=(20, 4)).tolist()
    twice = [*good, good[0], good[0]]
    bad = [None, [1, None, 2, 3], [1, 2, float("nan"), 3], [float("inf"), 0, 0, 0], [1e13, 0, 0, 0]]
    other = [[1.0, 2.0], [1.0, 3.0], [5.0, 2.5]]
    frame = table(spark, [*bad, *twice, *other, [], [7.0]], [*range(100, 105), *range(22), *range(50, 53), 60, 61])
    out = W.whitened(frame).collect()
    assert {x.vec_id for x in out} == {*range(22), *range(50, 53)}
    check([x for x in out if x.vec_id < 50], list(range(22)), twice)
    check([x for x in out if x.vec_id >= 50], [50, 51, 52], other)
    assert W.whitened(table(spark, [])).count() == 0
    assert W.whitened(table(spark, [None, None])).count() == 0
    assert W.whitened(table(spark, [[1.0, 1.0]] * 5)).count() == 0  # nothing varies
    nobody = W.whitened(table(spark, [*good, good[1]], [*range(20), None]))
    assert nobody.where("vec_id IS NULL").count() == 4


def test_rank_and_constant_dimensions(spark):
    r = np.random.default_rng(3)
    two = np.rint(r.normal(size=(50, 2)) * 50)
    vectors = np.column_stack([two, two[:, 0] + two[:, 1], np.full(50, 7.0), 2 * two[:, 1]])
    out = W.whitened(table(spark, vectors.tolist())).collect()
    assert {x.component for x in out} == {1, 2}
    check(out, list(range(50)), vectors.tolist())


def test_large_entries_stay_exact(spark):
    vectors = [[3e11, -1.0], [-2e11, 0.5], [1.5, 2.25], [7e10, 9.0]]
    deviations = brute(vectors)[1]
    full = W.whiten(table(spark, vectors)).where("component = 1").collect()
    assert [int(x.deviation_exact) for x in sorted(full)] == deviations
    kept = [x.deviation for x in sorted(W.whitened(table(spark, vectors)).where("component = 1").collect())]
    assert kept == [dev if dev < 2**63 else None for dev in deviations] and None in kept


@pytest.mark.parametrize("seed", range(4))
def test_factorisations(seed):
    r = np.random.default_rng(seed)
    d, rank = 17, [17, 9, 1, 16][seed]
    b = r.normal(size=(d, rank)) * 10.0 ** np.linspace(0, -4, rank)
    a = b @ b.T
    l, order = W.pivoted_cholesky(a)
    assert l.shape == (d, rank) and np.allclose(np.triu(l, 1), 0)
    assert np.allclose(l @ l.T, a[order][:, order], atol=1e-13 * np.trace(a))
    assert (np.diff(np.diag(l)) <= 1e-12).all()
    g = W.one_sided_jacobi(l)
    assert np.allclose(g @ g.T, l @ l.T, atol=1e-13 * np.trace(a))
    norms = (g * g).sum(0)
    cosines = (g.T @ g) / np.sqrt(np.outer(norms, norms))
    assert np.abs(cosines - np.eye(rank)).max() < 1e-13
    # small eigenvalues keep their relative accuracy, which an eigensolver of the product loses
    exact = np.sort(np.linalg.svd(b, compute_uv=False) ** 2)
    assert np.allclose(np.sort(norms), exact, rtol=1e-6)


def test_scatter_is_exact_beyond_doubles():
    x = np.array([[2**40 + 1, -3], [5, 2**39 + 7], [-(2**41) + 9, 1]])
    want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(2)] for i in range(2)]
    assert W.scatter(x).tolist() == want
    many = np.random.default_rng(0).integers(-(2**25), 2**25, (1000, 3))
    assert W.scatter(many).tolist() == (many.astype(object).T @ many.astype(object)).tolist()
    assert W.scatter(x[:0]).tolist() == [[0, 0], [0, 0]]


def test_sliced_columns():
    column = pa.array([[1.0], [0.5, 0.25], None, [2.0, None], [0.75, -0.001]], pa.list_(pa.float32())).slice(1, 4)
    ((rows, x),) = W.vectors(column)
    assert rows.tolist() == [0, 3]
    assert x.tolist() == [[100_512, 100_256], [100_768, 99_998]]
