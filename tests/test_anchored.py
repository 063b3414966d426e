"""Anchored windows, range by range, against one loop over each worker's calls."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.operators import anchored


def looped(rows, span):
    out = {}
    start = {}
    for worker, us, value in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        if worker not in start or us >= start[worker] + span:
            start[worker] = us
        n, total, top = out.get((worker, start[worker]), (0, 0.0, 0.0))
        out[worker, start[worker]] = (n + 1, total + (value or 0.0), max(top, value or 0.0))
    return sorted(((w, us, n, round(t, 6), m) for (w, us), (n, t, m) in out.items()), key=repr)


def found(spark, rows, seconds, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "worker bigint, us bigint, latency_ms double").withColumn("ts", F.timestamp_micros("us")).repartition(3)
        got = anchored.anchored_windows(df, seconds).select("worker", F.unix_micros("window_start"), "calls", "total_ms", "max_ms").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return sorted(((w, us, n, round(t, 6), m) for w, us, n, t, m in got), key=repr)


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 4), (3, 9), (4, 13)])
def test_random_logs(spark, seed, parts):
    """Dense and sparse workers, equal times, null workers, times and latencies, one worker with most calls."""
    r = random.Random(seed)
    rows = []
    for worker, n, wide in ((0, 400, 60), (1, 30, 3000), (None, 20, 400), (7, 5, 2), (9, 60, 300)):
        rows += [(worker, r.randrange(wide * 1_000_000) if r.random() < 0.8 else r.randrange(wide) * 1_000_000, r.choice([None, 1.0, r.random() * 100])) for _ in range(n)]
    rows += [(0, None, 1.0), (5, 10, 2.0)]
    assert found(spark, rows, 10, parts) == looped(rows, 10_000_000)


def test_even_steps_never_meet(spark):
    """A call each second: chains from different ends stay apart, and windows cross every range."""
    rows = [(1, i * 1_000_000, 1.0) for i in range(200)]
    assert found(spark, rows, 7, 8) == looped(rows, 7_000_000)
    assert anchored.anchored_windows(spark.createDataFrame([], "worker bigint, ts timestamp, latency_ms double")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.integers(1, 20), st.integers(0, 20))
def test_map_of_a_range(times, span, ahead):
    at = np.array(sorted(times))
    end = at[0] + span - ahead  # an end that may come in
    upto, start = anchored.range_map(at, span)
    k = int(np.searchsorted(upto, end))
    places = anchored.chain(at, int(np.searchsorted(at, end)), span)
    assert (k < len(upto)) == (len(places) > 0) and (k == len(upto) or start[k] == at[places[-1]])
    assert (np.diff(start) != 0).all() and len(upto) <= np.searchsorted(at, at[0] + span) + 1
