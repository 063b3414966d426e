import hashlib
import random
import time
from collections import Counter, defaultdict

import duckdb
import pytest

from keelson.llm import mixing
from keelson.llm.oracles import MIX_SQL
from tests.conftest import same_rows
from tests.llm import cases


def edf(a, period):
    """A whole simulation of one period: slot to source."""
    done, out = dict.fromkeys(a, 0), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // a[s]), s) for s in sorted(a) if done[s] < a[s] and done[s] * period // a[s] <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


def test_schedule_is_pfair(spark):
    a = {"a": 50, "b": 33, "c": 1, "d": 16}
    rows = mixing.schedule(spark.createDataFrame(list(a.items()), "source string, a int"), 100).collect()
    order = [r["source"] for r in sorted(rows, key=lambda r: r["slot"])]
    assert order == edf(a, 100)
    seen = Counter()
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - a[x] * t / 100) < 1 for x in a)


@pytest.mark.parametrize("weights,numbered", [(None, 20_000), ({"x": 0.7, "y": 0.2, "z": 0.1}, 20_000), ({"x": 1, "y": 3}, 10)])
def test_mix(spark, monkeypatch, weights, numbered):
    monkeypatch.setattr(mixing, "NUMBERED", numbered)
    docs = spark.createDataFrame([(i, "xyz"[i % 3 if i % 4 else 0]) for i in range(900)], "doc_id bigint, source string")
    rows = sorted(mixing.mix(docs, weights, block=2, period=20).collect(), key=lambda r: r["position"])
    assert sorted(r["doc_id"] for r in rows) == list(range(900)) and len({r["position"] for r in rows}) == 900
    ranks = defaultdict(list)
    for r in rows:
        ranks[r["source"]].append(r["source_rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())
    sizes = Counter(r["source"] for r in rows)
    share = {r["source"]: r["a"] for r in mixing.shares(spark.createDataFrame(list(sizes.items()), "source string, n bigint"), weights, 0.5, 20).collect()}
    assert sum(share.values()) == 20 and min(share.values()) >= 1
    first_out = min(-(-sizes[s] // 2) * 20 // share[s] for s in sizes) - 20
    seen = Counter()
    for slot in range(first_out):
        got = [r["source"] for r in rows if r["slot"] == slot]
        assert len(got) == 2 and len(set(got)) == 1
        seen[got[0]] += 1
        assert all(abs(seen[s] - share[s] * (slot + 1) / 20) < 1 for s in share)


def test_small_sources_keep_a_slot(spark):
    tail = [*[(f"big{i}", 4_000_000) for i in range(3)], *[(f"small{i:02}", 16) for i in range(30)]]
    for sizes in (tail, [("hot", 9_000_000), *[(f"m{i}", 3_000_000) for i in range(6)], *[(f"s{i:02}", 40) for i in range(25)]]):
        share = {r["source"]: r["a"] for r in mixing.shares(spark.createDataFrame(sizes, "source string, n bigint"), None, 0.5, 1000).collect()}
        assert len(share) == len(sizes) and sum(share.values()) == 1000 and min(share.values()) == 1
    share = {r["source"]: r["a"] for r in mixing.shares(spark.createDataFrame(tail, "source string, n bigint"), None, 0.5, 1000).collect()}
    assert sorted(share.values())[-3:] == [323, 323, 324]


@pytest.mark.parametrize("weights", [{"web": 1}, None])
def test_no_row_of_a_long_tail_is_lost(spark, weights):
    sizes = {"web": 500, **{f"s{i}": 2 for i in range(3 if weights else 15)}}
    docs = spark.createDataFrame([(100 * k + i if s != "web" else 10_000 + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id bigint, source string")
    rows = mixing.mix(docs, weights, block=2, period=20).collect()
    assert Counter(r["source"] for r in rows) == sizes and len({r["position"] for r in rows}) == len(rows)
    assert mixing.mix_in_order(docs, weights, block=2, period=20).count() == len(rows)


def test_odd_tables(spark):
    docs = cases.clashing(spark)
    out = mixing.mix(docs)
    assert out.count() == len(cases.rows()) and {"source_rank", "slot", "position", "node"} <= set(out.columns)
    ordered = mixing.mix_in_order(docs)
    assert ordered.columns == docs.columns and sorted(map(repr, ordered.collect())) == sorted(map(repr, docs.collect()))
    assert mixing.mix(cases.empty(spark)).collect() == [] == mixing.mix_in_order(cases.empty(spark)).collect()
    with pytest.raises(ValueError):
        mixing.mix(docs, period=2)


def test_rows_that_share_a_doc_id_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 10)
    docs = spark.createDataFrame([(None if i % 3 else i, "xy"[i % 2], i % 7) for i in range(1500)], "doc_id bigint, source string, more int").repartition(5)
    rows = mixing.mix(docs, block=2, period=20).collect()
    assert len(rows) == len({r["position"] for r in rows}) == 1500
    for s in "xy":
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: r["source_rank"])
        assert [r["source_rank"] for r in own] == list(range(len(own)))
        keys = [hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest() for r in own]
        assert keys == sorted(keys)
    parts = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "_tie" in parts


def test_more_sources_than_slots_of_a_period(spark):
    docs = spark.createDataFrame([(i, f"s{i % 1500}") for i in range(3000)], "doc_id bigint, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == len({r["position"] for r in rows}) == 3000 and len({r["source"] for r in rows}) == 1500


def test_sql_with_a_tail_of_small_sources(spark):
    tail = [(k * 1000 + i, f"s{k:03}" if k else "big") for k in range(590) for i in range(1 if k else 4000)]
    docs = spark.createDataFrame(tail, "doc_id bigint, source string")
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(MIX_SQL)
    same_rows(mixing.mix(docs).collect(), mixing.mix(docs).columns, want)


@pytest.mark.parametrize("seed", range(4))
def test_groups_of_one_share_take_turns(spark, seed):
    """Many sources of few shares, also with ties between groups, against the whole simulation."""
    r = random.Random(seed)
    a = {}
    while sum(a.values()) < 300:
        a[f"s{r.randrange(10**6):06}"] = min(r.choice([1, 1, 1, 2, 3, 5, 20]), 300 - sum(a.values()))
    period = sum(a.values())
    rows = mixing.schedule(spark.createDataFrame(list(a.items()), "source string, a int"), period).collect()
    rows = sorted(rows, key=lambda x: x["slot"])
    assert [x["source"] for x in rows] == edf(a, period) and [x["slot"] for x in rows] == list(range(period))
    assert {s: sorted(x["j"] for x in rows if x["source"] == s) for s in a} == {s: list(range(n)) for s, n in a.items()}


def test_ten_thousand_sources_in_seconds(spark):
    r = random.Random(1)
    sizes = [(f"host{i}", int(r.paretovariate(1.1))) for i in range(10_000)]
    period = mixing.SLOTS * 20
    share = mixing.shares(spark.createDataFrame(sizes, "source string, n bigint"), None, 0.5, period)
    began = time.time()
    rows = mixing.schedule(share, period).collect()
    assert len(rows) == period and len({x["source"] for x in rows}) == 10_000 and time.time() - began < 90


def test_plans_that_are_not_sent_around(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 7 if i % 3 else 0}") for i in range(500)], "doc_id bigint, source string")
    want = sorted(map(tuple, mixing.mix(docs, block=2).collect()))
    monkeypatch.setattr(mixing, "SENT_SLOTS", 0)
    assert sorted(map(tuple, mixing.mix(docs, block=2).collect())) == want
