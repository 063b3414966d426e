"""Object versions: delete markers, their state now, deletion on snapshots, pages of versions and their markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import rules as R
from keelson.operators.commits import commit
from keelson.operators.sinks import counted
from keelson.sources.listing import numbered

KEY = ["bucket", "key", "version_id"]


def delete_marker_rows(versions: DataFrame) -> DataFrame:
    """result (delete_markers, invalid_keys) and line for each delete marker; keys that would tear a row go encoded."""
    torn = R.tears_row(F.col("key"))
    key = F.when(torn, R.query_escape(F.col("key"))).otherwise(F.col("key"))
    line = F.concat_ws(R.SEP, "bucket", key, "version_id", R.rfc3339(F.col("last_modified").cast("timestamp")))
    return versions.where("is_delete_marker").select(F.when(torn, "invalid_keys").otherwise("delete_markers").alias("result"), line.alias("line"))


def counters_of_scan() -> dict[str, Column]:
    torn = R.tears_row(F.col("key"))
    return {"scanned": F.count("*"), "delete_markers": F.count_if(F.col("is_delete_marker") & ~torn), "invalid_keys": F.count_if(F.col("is_delete_marker") & torn)}


def scan_counters(versions: DataFrame) -> DataFrame:
    return versions.agg(*(c.alias(n) for n, c in counters_of_scan().items()))


def write_scan(versions: DataFrame, path: str, run: str = "run") -> None:
    """delete_marker_rows as result files, with the counters of the scan, from one pass."""
    rows, seen = counted(versions, **counters_of_scan())
    commit(path, run, lambda folder: delete_marker_rows(rows).write.partitionBy("result").text(folder), lambda: seen.get)


def states(listed: DataFrame, current: DataFrame) -> DataFrame:
    """listed (bucket, key, version_id, ...) with state: marker, not_marker or absent in the current versions."""
    now = current.groupBy(*KEY).agg(F.bool_or("is_delete_marker").alias("_marker"))
    return listed.join(now, KEY, "left").withColumn("state", F.when(F.col("_marker").isNull(), "absent").when(F.col("_marker"), "marker").otherwise("not_marker")).drop("_marker")


def deleted(current: DataFrame, rows: DataFrame) -> DataFrame:
    """current without the versions of rows; a second time changes nothing."""
    return current.join(rows.select(*KEY).distinct(), KEY, "left_anti")


def paged(versions: DataFrame, size: int) -> DataFrame:
    """versions with row_no and page within their bucket's prefix (text up to the first '/'), in listing order."""
    out = versions.withColumn("prefix", F.substring_index("key", "/", 1))
    out = numbered(out, ["bucket", "prefix"], [F.col("key"), F.col("last_modified").desc(), F.col("version_id")])
    return out.withColumn("page", F.ceil(F.col("row_no") / size).cast("bigint"))


def page_tails(pages: DataFrame) -> DataFrame:
    """prefix, page, entries, tail_key, tail_version: the greatest key, of equal keys the oldest version."""
    order = F.struct(F.col("key"), -F.unix_micros(F.col("last_modified").cast("timestamp")), F.col("version_id"))
    return pages.groupBy("prefix", "page").agg(F.count("*").alias("entries"), F.max("key").alias("tail_key"), F.max_by("version_id", order).alias("tail_version"))


def short_pages(tails: DataFrame, size: int) -> DataFrame:
    """tails with truncated and short: fewer entries than asked for though more pages follow."""
    last = F.max("page").over(Window.partitionBy("prefix"))
    return tails.withColumn("truncated", F.col("page") < last).withColumn("short", F.col("truncated") & (F.col("entries") < size))
