from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import vectors, whitening
from tests.llm.vector_cases import SCHEMA, clashing, odd, table


def integers(rows):
    kept = [(r[0], [np.float64(x) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return [k for k, _ in kept], np.array([[int(np.floor(1024 * x)) + 100000 for x in v] for _, v in kept], dtype=object)


def test_against_an_eigensolver(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 50)
    rows = [*table(400, 16), *odd(16)]
    ids, x = integers(rows)
    n = len(x)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    s = x.sum(axis=0)
    d = n * x - s
    v = np.array([[float(Fraction(int(y), n**3)) for y in r] for r in d.T @ d])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    want = sorted(zip(ids, map(int, (d * d).sum(axis=1))), key=repr)
    assert sorted([(r["vec_id"], r["deviation"]) for r in got if r["component"] == 1], key=repr) == want
    plain = (d.astype(float) / n) @ axes[:, :8] / np.sqrt(values[:8])
    for c in range(8):
        mine = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1)
        theirs = sorted((i if i is not None else -1, int(q), w) for i, q, w in zip(ids, (d * d).sum(axis=1), plain[:, c]))
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        (explained,) = {r["explained"] for r in got if r["component"] == c + 1}
        assert explained == pytest.approx(values[c] / np.trace(v), rel=1e-10)
    (error,) = {r["identity_error"] for r in got}
    assert error < 1e-10


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 9))
def test_factor_and_rotations(seed, dim, rank):
    r = np.random.default_rng(seed)
    b = r.integers(-50, 50, (dim, rank)).astype(object)
    a = b @ b.T
    factor = whitening.pivoted_factor(a.tolist())
    assert factor.shape[1] == np.linalg.matrix_rank(a.astype(float))
    top = max(1.0, float(np.abs(a.astype(float)).max()))
    assert np.abs((factor @ factor.T).astype(float) - a.astype(float)).max() < 1e-13 * top
    values, axes = whitening.jacobi(factor)
    assert np.allclose(np.linalg.eigvalsh(a.astype(float))[::-1][: len(values)], values.astype(float), rtol=1e-9, atol=1e-9 * top)
    assert np.abs((axes.T @ axes).astype(float) - np.eye(len(values))).max(initial=0) < 1e-14


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix: an eigensolver of the matrix loses the least value, rotations of the factor keep it."""
    a = [[10**24, 10**12, 1], [10**12, 2 * 10**6, 3], [1, 3, 7]]
    values, _ = whitening.jacobi(whitening.pivoted_factor(a))
    det = a[0][0] * (a[1][1] * a[2][2] - 9) - a[0][1] * (a[0][1] * 7 - 3) + (a[0][1] * 3 - a[1][1])
    assert float(values.prod()) == pytest.approx(det, rel=1e-12)


def test_large_entries_are_exact():
    z = np.array([[2**49, -(2**49)], [3, 2**40]], np.int64)
    assert whitening.products(z).tolist() == (z.T.astype(object) @ z.astype(object)).tolist()
    how = whitening.Whitening(5, [2**50, 1], np.ones(2), np.eye(2), 2.0)
    assert how.deviations(z)[0] is None and how.deviations(np.array([[1, 1]]))[0] is None
    assert whitening.Whitening(5, [2, 1], np.ones(2), np.eye(2), 2.0).deviations(np.array([[1, 1]])) == [9 + 16]


def test_columns_empty_and_degenerate(spark):
    rows = table(40, 4)
    plain = sorted(map(tuple, whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()))
    clash = sorted(map(tuple, whitening.whiten(clashing(spark, rows)).collect()))
    assert [r[:4] for r in plain] == [r[:4] for r in clash] and len(plain) == 160
    for few in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)] * 3):
        out = whitening.whiten(spark.createDataFrame(few, SCHEMA))
        assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.5, 2.0], 1)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    with pytest.raises(Exception, match="entries in one table"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1)], SCHEMA)).collect()
