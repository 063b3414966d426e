"""Merged key ranges against plain comparisons of prefixes and tokens."""

import random

import pytest

from keelson.sources import intervals as I
from keelson.sources import listing as L

ALPHABET = ["a", "b", "/", "é", "\U0010ffff", "퟿", "\x00", "z"]


def drawn(seed, n):
    r = random.Random(seed)
    text = lambda m: "".join(r.choice(ALPHABET) for _ in range(r.randint(0, m)))
    keys = [*(text(5) for _ in range(n)), None, "", "a", "a", "a"]
    entries = [(text(3), r.choice([None, "", text(4)])) for _ in range(r.randint(1, 12))]
    return keys, [*entries, (None, "a")]


def plain(keys, entries, tokens):
    hit = lambda k, p, t: k is not None and p is not None and k.startswith(p) and (not tokens or k.encode() > (t or "").encode())
    return [any(hit(k, p, t) for p, t in entries) for k in keys]


@pytest.mark.parametrize("filtered", [64, 0])
@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("tokens", [True, False])
def test_against_plain_comparisons(spark, seed, filtered, tokens):
    keys, entries = drawn(seed, 120)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, _at int").repartition(3)
    e = spark.createDataFrame(entries, "prefix string, token string")
    e = e if tokens else e.select("prefix")
    want = plain(keys, entries, tokens)
    for inside in (True, False):
        got = sorted(r["_at"] for r in I.select(rows, e, inside, filtered=filtered).collect())
        assert got == [i for i, w in enumerate(want) if w == inside]


def test_merged(spark):
    ranges = [(b"a", b"c"), (b"b", b"d"), (b"d", b"e"), (b"f", b"g"), (b"a", b"b"), (b"h", b"z"), (b"i", b"j"), (b"k", b"l")]
    df = spark.createDataFrame(ranges, "lo binary, hi binary").repartition(3)
    assert sorted((bytes(r["lo"]), bytes(r["hi"])) for r in I.merged(df).collect()) == [(b"a", b"e"), (b"f", b"g"), (b"h", b"z")]
    assert I.merged(df.limit(0)).collect() == []
    assert I.merged_few(ranges) == [(b"a", b"e"), (b"f", b"g"), (b"h", b"z")] and I.merged_few([]) == []


def test_bounds():
    assert I.text_bound(b"a/\xff") == "a0" and I.text_bound(b"a/k\0") == "a/k\0" and I.text_bound(b"\xff") is None
    assert I.text_bound("a\U0010ffff".encode() + b"\xff") == "b" and I.text_bound("퟿".encode() + b"\xff") == ""


def test_few_ranges_reach_the_scan_and_a_root_entry_shuffles_nothing(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/inventory"
    spark.range(1000).selectExpr("concat('p', id % 10, '/', id) as key", "id as size").write.parquet(path)
    inventory = spark.read.parquet(path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = L.resumed(inventory, spark.createDataFrame([("p1/", "p1/5"), ("p1/7", None)], "prefix string, token string"))
    assert "GreaterThanOrEqual(key,p1/5" in plan(one) and "LessThan(key,p10)" in plan(one) and "Exchange" not in plan(one)
    assert one.count() == sum(f"p1/{i}" > "p1/5" for i in range(1000) if i % 10 == 1)
    root = L.under_entries(inventory, spark.createDataFrame([("",), ("p3/",)], "prefix string"))
    assert "Exchange" not in plan(root) and root.count() == 1000
    many = L.under_entries(inventory, spark.createDataFrame([(f"p{i % 10}/{i}",) for i in range(0, 1000, 3)], "prefix string"))
    want = {f"p{i % 10}/{i}" for i in range(0, 1000, 3)}
    assert many.count() == sum(any(f"p{i % 10}/{i}".startswith(w) for w in want) for i in range(1000))


def test_a_key_of_most_rows_is_spread(spark):
    rows = spark.createDataFrame([("hot/k", i) for i in range(3000)] + [(f"z{i}", i) for i in range(50)], "key string, n int")
    entries = spark.createDataFrame([("hot/",), *((f"z{i}",) for i in range(10, 15))], "prefix string")
    ranges = I.merged(I.intervals(entries))
    assert I.swept(rows, ranges, True, "key").count() == 3005 and I.swept(rows, ranges, False, "key").count() == 45
