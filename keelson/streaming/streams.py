"""Streams over the same rules: latency windows, journals with state, node health, re-checks, delete-marker feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keelson.functions import rules as R
from keelson.operators.audit import recheck
from keelson.operators.commits import commit, read_committed
from keelson.operators.progress import latency_windows
from keelson.sources.manifest import split_manifest
from keelson.sources.shared import new_folder


def as_stream(rows: DataFrame, files: int | None = None, order: str | None = None) -> DataFrame:
    """rows written to a folder and read as a stream of Parquet files, for trials; as many files as there are cores, unless told."""
    path = new_folder(rows.sparkSession, "stream-in")
    files = files or max(4, rows.sparkSession.sparkContext.defaultParallelism)
    (rows.repartitionByRange(files, order).sortWithinPartitions(order) if order else rows.repartition(files)).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there; its rows as a table. In complete mode the last batch holds the result."""
    spark = stream.sparkSession
    out, state = new_folder(spark, "stream-out"), new_folder(spark, "stream-state")

    def put(batch: DataFrame, number: int) -> None:
        # a repeated batch replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch bigint").parquet(out) if query.lastProgress else None
    if rows is None:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last)
    return rows.drop("batch")


def latency(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """latency_windows with late calls up to two minutes."""
    return latency_windows(calls.withWatermark("ts", "2 minutes"), seconds)


def anchored_stream(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """anchored_windows as a stream: state holds a worker's open window, closed ones are returned."""

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = state.get if state.exists else None
        out = []
        for rows in parts:
            rows = rows.sort_values(["ts", "call_id"])
            for ts, value in zip(rows["ts"], rows["latency_ms"]):
                micros = ts.value // 1000
                if open_ is None or micros - open_[0] >= seconds * 1_000_000:
                    if open_ is not None:
                        out.append((key[0], pd.Timestamp(open_[0], unit="us"), *open_[1:]))
                    open_ = (micros, 0, 0.0, 0.0)
                open_ = (open_[0], open_[1] + 1, open_[2] + value, max(open_[3], value))
        if open_ is not None:
            state.update(open_)
        yield pd.DataFrame(out, columns=["worker", "window_start", "calls", "total_ms", "max_ms"])

    return calls.groupBy("worker").applyInPandasWithState(each, "worker bigint, window_start timestamp, calls bigint, total_ms double, max_ms double", "start bigint, calls bigint, total double, top double", "append", GroupStateTimeout.NoTimeout)


def journal_frontier(events: DataFrame) -> DataFrame:
    """Each change of a prefix's state (prefix, line_no, done, token) from a stream of journal events; events that are
    older than what the state has are ignored."""

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        move, done, cursor, token = state.get if state.exists else (-1, False, -1, "")
        last = -1
        for rows in parts:
            for line, kind, text in zip(rows["line_no"], rows["kind"], rows["token"]):
                last = max(last, line)
                if kind != "discovered" and line > move:
                    move, done = line, kind == "done"
                if kind == "cursor" and line > cursor:
                    cursor, token = line, text
        state.update((move, done, cursor, token))
        yield pd.DataFrame([(key[0], last, done, token)], columns=["prefix", "line_no", "done", "token"])

    return events.groupBy("prefix").applyInPandasWithState(each, "prefix string, line_no bigint, done boolean, token string", "move bigint, done boolean, cursor bigint, token string", "update", GroupStateTimeout.NoTimeout)


def health_step(state: tuple[int, bool, int], fault: bool, threshold: int, good: int) -> tuple[tuple[int, bool, int], str]:
    """(faults, isolated, good in a row) after a call: a fault counts while the node is in use; an isolated node is
    probed, and after so many good probes in a row it is back and counts from 0."""
    faults, isolated, streak = state
    if not isolated:
        faults += fault
        return ((faults, faults >= threshold, 0), "isolated" if faults >= threshold else "")
    streak = 0 if fault else streak + 1
    return ((0, False, 0), "readmitted") if streak >= good else ((faults, True, streak), "")


def node_health(calls: DataFrame, threshold: int = 3, good: int = 2) -> DataFrame:
    """node, call_id and change (isolated, readmitted), in the order of call_id."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, out = rows.sort_values("call_id"), (0, False, 0), []
        for call, fault in zip(rows["call_id"], rows["fault"]):
            state, change = health_step(state, bool(fault), threshold, good)
            if change:
                out.append((key[0], call, change))
        return pd.DataFrame(out, columns=["node", "call_id", "change"])

    rows = calls.select("node", "call_id", R.is_node_fault(F.col("http_code"), F.col("err")).alias("fault"))
    return rows.groupBy("node").applyInPandas(each, "node bigint, call_id bigint, change string")


def node_health_stream(calls: DataFrame, threshold: int = 3, good: int = 2) -> DataFrame:
    """node_health of a stream whose batches come in the order of call_id."""

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("call_id")
        now, out = tuple(state.get) if state.exists else (0, False, 0), []
        for call, fault in zip(rows["call_id"], rows["fault"]):
            now, change = health_step(now, bool(fault), threshold, good)
            if change:
                out.append((key[0], call, change))
        state.update(now)
        yield pd.DataFrame(out, columns=["node", "call_id", "change"])

    rows = calls.select("node", "call_id", R.is_node_fault(F.col("http_code"), F.col("err")).alias("fault"))
    return rows.groupBy("node").applyInPandasWithState(each, "node bigint, call_id bigint, change string", "faults bigint, isolated boolean, streak bigint", "append", GroupStateTimeout.NoTimeout)


#: Folders by hash that the table of a feed has, so that a small batch reads few of them.
FEED_HASHES = 64
MARKER = ["bucket", "key", "version_id"]


def marker_feed(versions: DataFrame, kept: str = "2 hours") -> DataFrame:
    """Delete markers of a stream of version events, each (bucket, key, version_id) once among those that came within the
    time `kept`. That is time of arrival: no row is late, however old the version, and state holds the keys of that time."""
    seen = versions.where("is_delete_marker").withColumn("_arrived", F.current_timestamp())
    return seen.withWatermark("_arrived", kept).dropDuplicatesWithinWatermark(MARKER).select(*MARKER)


def feed_markers(versions: DataFrame, path: str, state: str, kept: str = "2 hours") -> StreamingQuery:
    """Run marker_feed over what is there into the table at path, each marker once at any distance of time.

    Keys that came before are in the table itself, by batch and hash: a batch leaves those out by an anti-join on its
    own hashes and is then put on the list of batches. A repeated batch looks at the other batches only and takes its own place."""

    def put(batch: DataFrame, number: int) -> None:
        run = f"batch-{number}"
        new = batch.dropDuplicates(MARKER).withColumn("h", F.pmod(F.xxhash64(*MARKER), F.lit(FEED_HASHES)).cast("int"))
        before = read_committed(batch.sparkSession, path, "parquet", "bucket string, key string, version_id string, h int", but=run).alias("b")
        same = [new[c].eqNullSafe(before[c]) for c in MARKER]
        fresh = new.join(before, [*same, new["h"] == before["h"]], "left_anti")
        commit(path, run, lambda folder: fresh.write.partitionBy("h").parquet(folder))

    query = marker_feed(versions, kept).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fed_markers(spark: SparkSession, path: str) -> DataFrame:
    """The table of a feed."""
    return read_committed(spark, path, "parquet", "bucket string, key string, version_id string, h int").drop("h")


def running_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def lines_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they come."""
    return spark.readStream.text(folder).select(F.col("value").alias("line"))


def recheck_stream(lines: DataFrame, head: DataFrame, bodies: DataFrame, bucket: str) -> DataFrame:
    """line and result of a stream of manifest lines: each is parsed, joined with the object's current etag and size and its
    body, and judged as in `audit.recheck`. A line that can't be parsed is parse_failed."""
    parsed = split_manifest(lines.select(F.lit(0).alias("line_no"), "line"), bucket)
    judged = recheck(parsed.withColumn("is_multipart", F.coalesce("is_multipart", F.lit(False))), head, bodies)
    return judged.select("line", F.when(F.col("reason").isNotNull(), "parse_failed").otherwise(F.col("result")).alias("result"))


def per_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """Results first, progress after: the offsets of a batch are kept once act has returned; act must bear a repeat."""
    stream.writeStream.outputMode(mode).foreachBatch(act).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
