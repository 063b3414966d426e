"""Result files: lines dealt to directories by owner and result set, structured logs, manifests, run folders."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keelson.functions import rules as R
from keelson.operators.commits import commit, read_committed


def write_owner_lines(routed: DataFrame, path: str, run: str = "run") -> None:
    """routed (owner_dir, result, line) as text files below owner_dir=.../result=...; a set without rows has no folder. A
    run that is written again takes the place of what it wrote before."""
    rows = routed.select("owner_dir", "result", "line").repartition("owner_dir", "result", F.pmod(F.xxhash64("line"), F.lit(16)))
    commit(path, run, lambda folder: rows.write.partitionBy("owner_dir", "result").text(folder))


def write_lines(routed: DataFrame, path: str, run: str = "run", **counters: Column) -> None:
    """routed (result, line) as text files below result=..., a run once; counters (aggregates over routed) are taken in the
    pass that writes and kept with the run."""
    rows, seen = counted(routed, **counters) if counters else (routed, None)
    commit(path, run, lambda folder: rows.select("result", "line").write.partitionBy("result").text(folder), lambda: seen.get if seen else {})


def read_lines(spark: SparkSession, path: str, columns: str = "result string") -> DataFrame:
    """What write_lines or write_owner_lines has written, each run once."""
    return read_committed(spark, path, "text", f"value string, {columns}").withColumnRenamed("value", "line")


def write_log(rows: DataFrame, path: str, run: str = "run") -> None:
    commit(path, run, lambda folder: rows.write.json(folder))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_log has written, each run once."""
    return read_committed(spark, path, "json", schema)


def counted(rows: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation that holds counters (aggregates) over them once a job has read all of them: results and
    counters come from one pass. Tasks that are repeated count once."""
    seen = Observation()
    return rows.observe(seen, *(c.alias(n) for n, c in counters.items())), seen


def failure_log(calls: DataFrame) -> DataFrame:
    """time, level, msg, req_id, bucket, key or prefix (the other is null), http_code ('N/A' for none), s3_code and err ('-'
    for empty) of failed calls (call_id, ts, op, req_id, bucket, target, ...); the target of a listing is a prefix."""
    failed = calls.where((F.col("http_code") < 200) | (F.col("http_code") >= 300))
    listing = F.col("op") == "list"
    what = [R.rfc3339(F.col("ts").cast("timestamp")).alias("time"), R.or_dash(F.col("req_id")).alias("req_id"), R.or_dash(F.col("bucket")).alias("bucket"), F.when(~listing, F.col("target")).alias("key"), F.when(listing, F.col("target")).alias("prefix")]
    return failed.select("call_id", *what, F.lit("WARN").alias("level"), F.concat("op", F.lit(" failed")).alias("msg"), F.when(F.col("http_code") == 0, "N/A").otherwise(F.col("http_code").cast("string")).alias("http_code"), R.or_dash(F.col("s3_code")).alias("s3_code"), R.or_dash(F.col("err")).alias("err"))


def parse_failures(uploads: DataFrame) -> DataFrame:
    """key, etag_len and etag of multipart ETags without usable offsets."""
    bad = ~R.is_normal_etag(F.col("etag")) & R.offset_etag(F.col("etag"), F.col("size")).isNull()
    return uploads.where(bad).select("key", F.octet_length("etag").cast("bigint").alias("etag_len"), "etag")


def write_manifest(rows: DataFrame, path: str) -> None:
    """bucket|key|md5 lines, replacing what is there."""
    rows.select(F.concat_ws("|", "bucket", "key", "md5").alias("value")).write.mode("overwrite").text(path)


def run_folder(path: str, at: datetime.datetime) -> str:
    """A folder beside path for one run."""
    return f"{path.rstrip('/')}_{at:%Y%m%d_%H%M%S}"


def archive(lines: DataFrame, folder: str, base: str, at: datetime.datetime) -> str:
    """Copy an input list before work on it starts; a failure is an error."""
    target = f"{folder.rstrip('/')}/.backup_lists/{base}_{at:%Y%m%d_%H%M%S}.txt"
    lines.select(F.col("line").alias("value")).write.mode("errorifexists").text(target)
    return target
