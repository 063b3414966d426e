"""The journal tracker and the marker feed over several batches: results, repeats, and what stays in their state."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.operators import commits as C
from keelson.operators import progress as P
from keelson.operators import sinks as K
from keelson.streaming import streams as T
from keelson.streaming import tracker


def run(spark, tmp_path, batches, name="a"):
    """Changes of a tracker over batches of events, one a trigger; the folder of its state."""
    source, state, out = (f"file://{tmp_path}/{name}-{x}" for x in ("in", "state", "out"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, tracker.EVENTS).repartition(3).write.parquet(f"{source}/b{k:03d}")
        stream = spark.readStream.schema(tracker.EVENTS).parquet(f"{source}/*")
        T.per_batch(tracker.track(stream), lambda b, n: C.commit(out, f"b{n}", lambda f: b.write.parquet(f)), state, "update")
    return C.read_committed(spark, out, "parquet", tracker.CHANGES), state


def held(spark, state):
    return {r["key"]["prefix"] for r in spark.read.format("statestore").option("path", state).option("stateVarName", "head").load().collect()}


def test_golden_positions_and_state(spark, tmp_path):
    page = lambda p, s, n, t: (p, "page", s, n, t)
    end = lambda p, s, n=1: (p, "terminal", s, n, "")
    batches = [
        [("p", "seed", None, None, "T0"), page("p", 0, 3, "T1"), end("p", 0, 2), end("q", 0), page("r", 0, 0, "")],
        [page("p", 1, 1000, "T2"), end("p", 0), *[end("p", 1)] * 400, end("p", 9), end("r", 0)],
        [page("p", 2, 1, ""), end("p", 2), end("p", 1, 700), end("p", 1)],
    ]
    first, state = run(spark, tmp_path, batches[:1])
    assert {tuple(r)[:4] for r in first.collect()} == {("p", -1, "T0", False), ("r", 0, "", True)}
    assert held(spark, state) == {"p"}  # neither the done prefix nor the one that only had a terminal
    changes, state = run(spark, tmp_path, batches, "b")
    assert [tuple(r)[1:4] for r in changes.where("prefix = 'p'").orderBy("version").collect()] == [(-1, "T0", False), (0, "T1", False), (2, "", True)]
    assert changes.where("prefix = 'q'").count() == 0 and changes.where("prefix = 'r'").count() == 1
    assert held(spark, state) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch(spark, tmp_path, seed):
    """Random logs cut into batches, terminals behind their page: the last changes equal positions of the whole."""
    r = random.Random(seed)
    pages, terminals, order = [], [], []
    for p in "abcdef":
        n = r.randint(1, 5)
        for s in range(n):
            count = r.randint(0, 6)
            pages.append((p, s, count, "" if s == n - 1 and r.random() < 0.7 else f"T{s}"))
            ends = [(p, s)] * (count if r.random() < 0.7 else r.randint(0, count))
            at = r.random() * 2 + s
            terminals += ends
            order += [(at, (p, "page", s, count, pages[-1][3])), *((at + r.random() * 2, (p, "terminal", s, 1, "")) for _ in ends)]
    order = [e for _, e in sorted(order, key=lambda x: x[0])]
    cuts = [order[i : i + len(order) // 3 + 1] for i in range(0, len(order), len(order) // 3 + 1)]
    changes, state = run(spark, tmp_path, cuts)
    got = {x["prefix"]: (x["position"], x["token"], x["done"]) for x in tracker.latest(changes).collect()}
    batch = P.positions(P.page_outstanding(spark.createDataFrame(pages, "prefix string, seq int, obj_count bigint, next_token string"), spark.createDataFrame(terminals, "prefix string, seq int")))
    assert got == {x["prefix"]: (x["position"], x["token"], x["done"]) for x in batch.collect()}
    assert held(spark, state) == {p for p, (_, _, done) in got.items() if not done}


def test_markers_once_at_any_distance_and_level_state(spark, tmp_path):
    """The same markers come in every batch, a year apart; what has left the state is found in the table."""
    source, state, out = (f"file://{tmp_path}/{x}" for x in ("in", "state", "out"))
    schema = "bucket string, key string, version_id string, is_delete_marker boolean, last_modified timestamp"
    sizes = []
    for k in range(5):
        rows = spark.range(40).select(F.lit("b").alias("bucket"), F.concat(F.lit("k"), (F.col("id") % 20).cast("string")).alias("key"), F.concat(F.lit(f"v{k}-"), (F.col("id") % 20).cast("string")).alias("version_id"), F.lit(True).alias("is_delete_marker"), F.expr(f"timestamp'2020-01-01' + make_interval({k})").alias("last_modified"))
        again = rows.withColumn("version_id", F.lit("v-all"))
        rows.unionByName(again).unionByName(rows.limit(3).withColumn("is_delete_marker", F.lit(False))).write.parquet(f"{source}/b{k}")
        query = T.feed_markers(spark.readStream.schema(schema).parquet(f"{source}/*"), out, state, kept="1 second")
        sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    fed = T.fed_markers(spark, out)
    assert fed.count() == fed.distinct().count() == 20 * 5 + 20
    assert max(sizes) <= 80 and sizes[-1] <= 40


def test_a_repeated_run_is_there_once(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("o1", "ok", "b|k1"), ("o2", "mp", "b|k2")], "owner_dir string, result string, line string")
    for k in ("first run", "first run", "second/run"):
        K.write_owner_lines(rows, path, k)
    read = lambda: sorted(tuple(r) for r in K.read_lines(spark, path, "owner_dir string, result string").select("owner_dir", "result", "line").collect())
    assert read() == sorted([("o1", "ok", "b|k1"), ("o2", "mp", "b|k2")] * 2)

    def dies(folder):
        rows.select("line").write.text(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        C.commit(path, "third", dies)
    assert len(read()) == 4 and C.remove_unlisted(path) == 2 and len(read()) == 4
    assert K.read_lines(spark, f"file://{tmp_path}/none").collect() == []
    log = f"file://{tmp_path}/log"
    for _ in range(2):
        K.write_log(rows, log)
    assert K.read_log(spark, log, "owner_dir string, result string, line string").count() == 2


def test_a_repeated_batch_is_there_once(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    stream = T.as_stream(spark.createDataFrame([("ok", f"l{i}") for i in range(10)], "result string, line string"))
    for state in ("s1", "s2"):  # the second starts from nothing, as after a lost checkpoint
        T.per_batch(stream, lambda b, n: K.write_lines(b, out, f"batch-{n}"), f"file://{tmp_path}/{state}")
    assert K.read_lines(spark, out).count() == 10


def test_results_and_counters_come_from_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([("ok", f"l{i}") for i in range(10)] + [("mp", "x")], "result string, line string")
    counting, seen = K.counted(rows, n=F.count("*"), mp=F.count_if(F.col("result") == "mp"))
    K.write_lines(counting, f"file://{tmp_path}/out")
    assert seen.get == {"n": 11, "mp": 1} and K.read_lines(spark, f"file://{tmp_path}/out").count() == 11


def batch_of(rows):
    fields = [("prefix", pa.string()), ("kind", pa.string()), ("seq", pa.int32()), ("n", pa.int64()), ("token", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[f[0] for f in fields])


@pytest.mark.parametrize("most", [500_000, 7])
def test_a_task_adds_up_terminals_of_many_batches(monkeypatch, most):
    monkeypatch.setattr(tracker, "SUMMED_PAGES", most)
    batches = [batch_of([*((f"p{i % 10}", "terminal", i % 2, 1, "") for i in range(100)), (f"q{k}", "page", 0, 5, "T")]) for k in range(50)]
    rows = [r for b in tracker.added_up(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["prefix"] for r in rows if r["kind"] == "page") == sorted(f"q{k}" for k in range(50))
    sums = {}
    for r in rows:
        if r["kind"] == "terminal":
            sums[r["prefix"], r["seq"]] = sums.get((r["prefix"], r["seq"]), 0) + r["n"]
    assert sums == {(f"p{i}", i % 2): 500 for i in range(10)}
    assert len(rows) == 50 + 10 if most > 7 else len(rows) <= 50 + 50 * 10


def test_pages_that_come_and_go_in_a_batch_stay_out_of_the_state():
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

        def exists(self):
            return False

    t = tracker.Tracker()
    t.head, t.pages = State(), State()
    events = pd.DataFrame([("page", s, 1, "" if s == 99 else f"T{s}") for s in range(100)] + [("terminal", s, 1, "") for s in range(100)], columns=["kind", "seq", "n", "token"])
    (out,) = t.handleInputRows(("p",), iter([events]), None)
    assert out.values.tolist() == [["p", 99, "", True, 1]] and calls == []
    (out,) = t.handleInputRows(("p",), iter([events[:150]]), None)
    assert out.values.tolist() == [["p", 49, "T49", False, 1]] and calls == ["updateValue"] * 50 + ["update"]
