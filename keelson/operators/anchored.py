"""Windows anchored at calls: each starts at the first call at or after the end of the last one.

Which calls start windows depends on all calls before, yet no task reads a worker's calls in a row. Calls are dealt by ranges
of (worker, time). What a range does to the chain of windows is a small map: from the end of the window that is open when
the range begins to the start of the one that is open when it ends. Only ends within one length of the range's first call can
come in, and chains from different ends soon meet, so a map has few rows, and no more than calls in one length. Maps of neighbours are
composed pair by pair up a tree of ranges; then each range gets the end that comes in to it, from the root down. At last each range
steps through its own windows, and windows that cross ranges are added up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.sources.shared import new_folder

#: Before every call.
FIRST = -(1 << 62)
MAP = "w string, node bigint, upto bigint, start bigint"


def chain(at: np.ndarray, begin: int, span: int) -> np.ndarray:
    """The places in sorted times where windows start, the first at `begin`."""
    out = []
    while begin < len(at):
        out.append(begin)
        begin = int(np.searchsorted(at, at[begin] + span))
    return np.array(out, np.int64)


def range_map(at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted times of a range: (upto, start), a window that ends at e is followed by the call at or after e, and the
    last window that then starts in the range starts at `start` of the first row with upto >= e."""
    after = np.searchsorted(at, at + span)  # the start that follows each call as a start; the number of calls if none does
    last = np.arange(len(at))
    goes = np.append(after, len(at))
    final = np.append(last, len(at))
    while True:  # steps double: final[i] is the last start of i's chain so far, goes[i] the one after it
        open_ = goes[:-1] < len(at)
        if not open_.any():
            break
        final[:-1] = np.where(open_, final[goes[:-1]], final[:-1])
        goes[:-1] = np.where(open_, goes[goes[:-1]], goes[:-1])
    n = min(len(at), int(np.searchsorted(at, at[0] + span)) + 1)  # later ends don't come in
    begin = np.flatnonzero(np.diff(final[:n], append=-1))
    return at[begin], at[final[begin]]


def _times(span: int) -> object:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def put() -> pd.DataFrame:
            upto, start = range_map(np.unique(np.concatenate(held)), span)
            return pd.DataFrame({"w": key[0], "node": key[1], "upto": upto, "start": start})

        for rows in batches:
            for own, part in rows.groupby(["w", "_range"], sort=False):
                if key is not None and own != key:
                    yield put()
                    held = []
                key = own
                held.append(part["us"].to_numpy())
        if held:
            yield put()

    return each


def _together(span: int) -> object:
    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The map of two neighbours: what comes out of the left one goes on through the right one."""
        left, right = (rows[rows["node"] % 2 == side].sort_values("upto") for side in (0, 1))
        if len(left) and len(right):
            at = np.searchsorted(right["upto"].to_numpy(), left["start"].to_numpy() + span)
            starts = np.append(right["start"].to_numpy(), 0)[at]
            left = left.assign(start=np.where(at < len(right), starts, left["start"].to_numpy()))
            rows = pd.concat([left, right[right["upto"] > left["upto"].iloc[-1]]])
        else:
            rows = rows.sort_values("upto")
        last = rows["start"].ne(rows["start"].shift(-1))
        return pd.DataFrame({"w": key[0], "node": key[1], "upto": rows["upto"][last], "start": rows["start"][last]})

    return each


def _windows(span: int) -> object:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (w, _range, us, value, enters) in order, range by range, to parts of windows; a task holds a batch and a sum."""
        key, open_, out = None, None, []

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["w", "us", "calls", "total", "top"])

        for rows in batches:
            for own, part in rows.groupby(["w", "_range"], sort=False):
                at, value = part["us"].to_numpy(), part["latency_ms"].to_numpy()
                if own != key:
                    out += [open_] if open_ and open_[2] else []
                    enters = int(part["enters"].iloc[0])
                    key, open_ = own, (own[0], enters - span, 0, 0.0, -np.inf) if enters != FIRST else None
                inside = int(np.searchsorted(at, open_[1] + span)) if open_ else 0
                starts = chain(at, inside, span)
                edges = [*([0] if inside else []), *starts.tolist(), len(at)]
                for a, b in zip(edges[:-1], edges[1:]):
                    if a >= inside:
                        out += [open_] if open_ and open_[2] else []
                        open_ = (own[0], int(at[a]), 0, 0.0, -np.inf)
                    got = value[a:b][~np.isnan(value[a:b])]
                    open_ = (*open_[:2], open_[2] + b - a, open_[3] + float(got.sum()), max(open_[4], float(got.max(initial=-np.inf))))
            yield frame()
            out = []
        out = [open_] if open_ and open_[2] else []
        yield frame()

    return each


def _kept(df: DataFrame, what: str) -> DataFrame:
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def entering(maps: DataFrame, span: int) -> DataFrame:
    """w, node and enters (the end of the window open when a range begins; FIRST where none is) from the ranges' maps."""
    levels, top = [maps], maps.agg(F.max("node")).first()[0] or 0
    while top >> (len(levels) - 1):
        pairs = levels[-1].withColumn("up", F.expr("node div 2")).groupBy("w", "up")
        levels.append(_kept(pairs.applyInPandas(_together(span), MAP), "window-maps"))
    ends = levels[-1].select("w", "node").distinct().withColumn("enters", F.lit(FIRST))
    for maps in reversed(levels[:-1]):
        left = ends.select("w", (F.col("node") * 2).alias("node"), "enters")
        met = left.join(maps, ["w", "node"], "left").groupBy("w", "node").agg(F.min("enters").alias("enters"), F.min_by("start", F.when(F.col("upto") >= F.col("enters"), F.col("upto"))).alias("start"))
        right = met.select("w", (F.col("node") + 1).alias("node"), F.coalesce(F.col("start") + span, "enters").alias("enters"))
        there = maps.select("w", "node").distinct()
        ends = _kept(left.unionByName(right).join(there, ["w", "node"]), "window-ends")
    return ends


def anchored_windows(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """worker, window_start, calls, total_ms and max_ms of calls (worker, ts, latency_ms), windows anchored at a worker's calls.

    Null workers are one worker; a call without a time is in no window; one without a latency counts, but adds nothing."""
    span = seconds * 1_000_000
    kind = calls.schema["worker"].dataType
    name: Column = F.coalesce(F.concat(F.lit("="), F.col("worker").cast("string")), F.lit(""))
    rows = calls.where("ts is not null").select(name.alias("w"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("latency_ms").cast("double").alias("latency_ms"))
    order = [F.col("w"), F.col("us"), F.xxhash64("latency_ms")]
    at = _kept(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id().cast("bigint")).sortWithinPartitions("w", "us"), "window-calls")
    sorted_ = lambda df, *c: df.repartition("w", "_range").sortWithinPartitions("w", "_range", "us").select(*c)
    maps = _kept(sorted_(at.select("w", "_range", "us").distinct(), "w", "_range", "us").mapInPandas(_times(span), MAP), "window-maps")
    ends = entering(maps, span).select("w", F.col("node").alias("_range"), "enters")
    parts = sorted_(at.join(ends, ["w", "_range"]), "w", "_range", "us", "latency_ms", "enters").mapInPandas(_windows(span), "w string, us bigint, calls bigint, total double, top double")
    each = parts.groupBy("w", "us").agg(F.sum("calls").alias("calls"), F.sum("total").alias("total_ms"), F.max("top").alias("top"))
    worker = F.when(F.col("w") != "", F.substring("w", F.lit(2), F.length("w"))).cast(kind)
    none = F.lit(float("-inf"))
    return each.select(worker.alias("worker"), F.timestamp_micros("us").alias("window_start"), "calls", "total_ms", F.when(F.col("top") > none, F.col("top")).otherwise(0.0).alias("max_ms"))
