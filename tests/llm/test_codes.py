import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import codes
from tests.llm.vector_cases import SCHEMA, clashing, odd, table


def brute(rows):
    """Plain Lloyd rounds in Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(4096 * np.float64(x))) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // 8
    parts = [[tuple(v[k * w : k * w + w]) for v in ints] for k in range(8)]
    books = [list(p[:16]) for p in parts]
    nearest = lambda p, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(p, book[e])), e))
    for _ in range(6):
        for k in range(8):
            at = [nearest(p, books[k]) for p in parts[k]]
            for e in range(len(books[k])):
                own = [p for p, a in zip(parts[k], at) if a == e]
                if own:
                    books[k][e] = tuple(sum(c) // len(own) for c in zip(*own))
    at = [[nearest(p, books[k]) for p in parts[k]] for k in range(8)]
    error = [sum(sum((a - b) ** 2 for a, b in zip(parts[k][i], books[k][at[k][i]])) for k in range(8)) for i in range(len(kept))]
    total = {}
    for (_, _, lab), e in zip(kept, error):
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{at[k][i]:02x}" for k in range(8)), error[i], total[r[2]], digest) for i, r in enumerate(kept)), key=repr)


@pytest.mark.parametrize("block,leaf", [(4096, 32), (64, 4)])
def test_against_plain_rounds(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(codes, "BLOCK", block)
    monkeypatch.setattr(codes, "LEAF", leaf)
    rows = [*table(500, 16), *odd(16)]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 16), st.integers(1, 4), st.sampled_from([2, 10, 3000]))
def test_each_point_gets_its_nearest_entry(seed, n, k, dim, top):
    """Also with ties, equal entries and points on entries."""
    r = np.random.default_rng(seed)
    centres = r.integers(-top, top + 1, (5, dim))
    points, entries = centres[r.integers(0, 5, n)] + r.integers(-2, 3, (n, dim)), centres[r.integers(0, 5, k)] + r.integers(-3, 4, (k, dim))
    order = codes.sorted_by_tree(points, 4)
    assert sorted(order) == list(range(n))
    code, count, sums, compared = codes.assigned(codes.Tree(points[order], 4), entries)
    far = ((points[order][:, None] - entries[None]) ** 2).sum(axis=2)
    assert code.tolist() == far.argmin(axis=1).tolist() and compared <= n
    assert count.tolist() == np.bincount(code, minlength=k).tolist()
    assert sums.tolist() == [points[order][code == e].sum(axis=0).tolist() for e in range(k)]


def test_whole_nodes_are_assigned():
    """Groups that lie apart are settled by boxes alone."""
    r = np.random.default_rng(5)
    points = np.repeat(np.arange(16)[:, None] * 1000, 8, axis=1)[r.integers(0, 16, 4000)] + r.integers(-9, 10, (4000, 8))
    entries = np.repeat(np.arange(16)[:, None] * 1000, 8, axis=1)
    assert codes.assigned(codes.Tree(points[codes.sorted_by_tree(points, 16)], 16), entries)[3] < 400


def test_columns_empty_few_and_wrong(spark):
    rows = [(i, [float(x % 3) - 0.5 for x in range(i, i + 8)], i % 2 or None) for i in range(5)]
    assert sorted(map(tuple, codes.compress(clashing(spark, rows)).collect())) == brute(rows)
    for few in ([], [(1, None, 1), (2, [None] * 8, 1)]):
        out = codes.compress(spark.createDataFrame(few, SCHEMA))
        assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))
    with pytest.raises(Exception, match="entries in one table"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], SCHEMA))
    with pytest.raises(Exception, match="or more"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], SCHEMA))
