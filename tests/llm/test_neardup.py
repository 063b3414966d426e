import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import neardup
from keelson.llm.graph import components
from tests.llm import cases


def brute(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = re.findall("[^ \t-\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((r[0], len(s), least[find(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def edited(base, n, r):
    w = base.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**9)}"
    return " ".join(w)


def copies(n=150):
    """A large group of copies with more and fewer edits, so that many are linked only through others."""
    r = random.Random(4)
    base = cases.prose(150, 99)
    return [(1000 + i, edited(base, r.randrange(0, 9), r), "en", "s", 0) for i in range(n)] + [(5000 + i, f"{cases.prose(40, i)}\n{base[:400]}", "en", "s", 0) for i in range(30)]


@pytest.mark.parametrize("width,percent,tile,long", [(3, 85, 1024, 256), (3, 85, 16, 8), (5, 80, 16, 8)])
def test_against_brute_force(spark, monkeypatch, width, percent, tile, long):
    monkeypatch.setattr(neardup, "TILE_ROWS", tile)
    monkeypatch.setattr(neardup, "LONG", long)
    monkeypatch.setattr(neardup, "SET_ROWS", tile // 2)
    rows = [*cases.rows(), *copies()]
    got = neardup.near_duplicates(spark.createDataFrame(rows, cases.SCHEMA).repartition(4), width, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows, width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_lone_members(spark):
    """Whoever is alike to another member stays, whatever else it holds."""
    r = np.random.default_rng(3)
    base = list(range(100))
    sets = [sorted({*r.choice(base, 100 - k % 30, replace=False).tolist(), *(1000 * i + x for x in range(k % 30))}) for i, k in enumerate(r.integers(0, 60, 80).tolist(), 1)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node bigint, shingles array<bigint>")
    gone = {r["node"] for r in neardup.lone(df.selectExpr("node", "size(shingles) as n"), df, 85).collect()}
    alike = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(set(a) & set(b)) >= 85 * len(set(a) | set(b))}
    assert gone and not gone & alike
    others = [set().union(*(sets[:i] + sets[i + 1 :])) for i in range(len(sets))]
    assert gone == {i for i, s in enumerate(sets) if 100 * len(set(s) & others[i]) < 85 * len(s)}


def test_columns_and_empty(spark):
    assert neardup.near_duplicates(cases.clashing(spark)).count() == len(cases.rows())
    assert neardup.near_duplicates(cases.empty(spark)).collect() == []


def test_least_matches():
    assert neardup.least_matches(32, 100, 1e-6) == 32 and 10 < neardup.least_matches(32, 85, 1e-6) < 27


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 400), (7, 7), (500, 500)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 300: 200, 400: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def tile_row(node, posted, sig, key, comp=None, n=100):
    return (key, 0, 0, 0, node, node if comp is None else comp, n, posted, np.array(sig, "<u4").tobytes())


@pytest.mark.parametrize("one,other", [(0, 3), (3, 0), (1, 3), (3, 1), (3, 4)])
def test_pairs_that_no_earlier_list_holds_are_found(one, other):
    """Two classes of equal signatures in a list of coordinate 5, each posted under one more coordinate than the other."""
    rows = [tile_row(1, 1 << 5 | 1 << one, range(32), 5 << 32), tile_row(2, 1 << 5 | 1 << other, range(32), 5 << 32)]
    assert sorted(neardup._Tiles(85, 16, 32).found(rows)) == [(5 << 32, 1), (5 << 32, 2)]
    both = [tile_row(1, 1 << 5 | 1 << one, range(32), 5 << 32), tile_row(2, 1 << 5 | 1 << one, range(32), 5 << 32)]
    assert bool(neardup._Tiles(85, 16, 32).found(both)) == (one > 5)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 12))
def test_each_pair_is_proposed_by_exactly_one_list(seed, n):
    """Whatever coordinates classes are posted under: a pair with enough collisions that shares a list is proposed once."""
    r = np.random.default_rng(seed)
    k, matches = 8, 3
    sigs, posted = r.integers(0, 3, (n, k)), r.integers(0, 1 << k, n)
    lists = {}
    for i in range(n):
        for c in range(k):
            if posted[i] >> c & 1:
                lists.setdefault((c, sigs[i, c]), []).append(i)
    tiles, times = neardup._Tiles(50, matches, k), {}
    for (c, value), members in lists.items():
        rows = [tile_row(i, int(posted[i]), sigs[i], (c << 32) + int(value)) for i in members]
        for near in tiles.near(rows, rows, rows[0][0]):
            for a, b in zip(*np.nonzero(near)):
                pair = frozenset((members[a], members[b]))
                times[pair] = times.get(pair, 0) + 1
    shared = lambda i, j: any(posted[i] & posted[j] & 1 << c and sigs[i, c] == sigs[j, c] for c in range(k))
    want = {frozenset((i, j)) for i in range(n) for j in range(i) if (sigs[i] == sigs[j]).sum() >= matches and shared(i, j)}
    assert times == dict.fromkeys(want, 1)
