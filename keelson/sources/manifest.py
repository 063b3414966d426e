"""Line manifests: text files with line numbers, and lines parsed into columns with bad ones kept and named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import rules as R

MAX_LINE = 1 << 20
MAX_ROW = 16 << 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, by file name and place in it) and line.

    Each piece of a file that a task reads is counted, and the counts before it give its first number: lines aren't
    sorted, and the one ordered window is over a row for each piece."""
    from pyspark.sql import Window

    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"))
    pieces = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = pieces.select("_f", "_b", "_first", F.coalesce(before, F.lit(0)).alias("_start"))
    return lines.join(starts, ["_f", "_b"]).select((F.col("_start") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def split_manifest(lines: DataFrame, bucket: str, mixed: bool = True, max_line: int = MAX_LINE) -> DataFrame:
    """line_no, line, key, is_multipart, offsets and reason; the first three parsed columns are null where reason is set."""
    line = F.col("line")
    reason = F.when(F.octet_length(line) > max_line, "line too long").otherwise(R.mixed_reason(line, bucket) if mixed else R.multipart_reason(line, bucket))
    parts = F.split(line, r"\|")
    out = lines.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.select("line_no", "line", F.when(ok, F.get(parts, F.lit(1))).alias("key"), F.when(ok, F.size(parts) > 2).alias("is_multipart"), F.when(ok, R.line_offsets(line)).alias("offsets"), "reason")


def strict(parsed: DataFrame) -> DataFrame:
    """parsed, failing on the first bad line."""
    return parsed.where(F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("malformed line "), F.col("line_no").cast("string"), F.lit(": "), F.col("reason")))).otherwise(True))


def resume_entries(lines: DataFrame) -> DataFrame:
    """line_no, prefix, token and reason: an empty line is the root, white space alone is malformed, cut at the first pipe."""
    line = F.col("line")
    reason = F.when((line != "") & R.is_blank(line), "whitespace-only line")
    parts = F.split(line, r"\|", 2)
    return lines.select("line_no", F.when(reason.isNull(), F.get(parts, F.lit(0))).alias("prefix"), F.when(reason.isNull(), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("token"), reason.alias("reason"))


def retry_entries(lines: DataFrame, strict_lines: bool = False) -> DataFrame:
    """line_no, prefix, key_marker, version_marker: 1 or 3 fields, the first of equal entries; no line at all is the root."""
    parts = F.split("line", R.SEP)
    bad = ~F.size(parts).isin(1, 3)
    good = lines.where(F.when(bad, F.raise_error(F.lit("malformed retry line"))).otherwise(True) if strict_lines else ~bad)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    rows = good.select("line_no", part(0).alias("prefix"), part(1).alias("key_marker"), part(2).alias("version_marker"))
    first = rows.groupBy("prefix", "key_marker", "version_marker").agg(F.min("line_no").alias("line_no"))
    none = lines.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("prefix"), F.lit("").alias("key_marker"), F.lit("").alias("version_marker"), F.lit(0).cast("bigint").alias("line_no"))
    return first.unionByName(none)


def cleanup_rows(lines: DataFrame, encoded: Column, max_row: int = MAX_ROW) -> DataFrame:
    """Delete-marker rows of 3 or 4 fields; the key is decoded where encoded; torn rows are kept with a reason. Blank lines go."""
    parts = F.split("line", R.SEP)
    raw = F.get(parts, F.lit(1))
    key = F.when(encoded, F.try_url_decode(raw)).otherwise(raw)
    reason = F.when(F.octet_length("line") > max_row, "row too long").when(~F.size(parts).isin(3, 4), "wrong number of fields").when(key.isNull(), "bad encoding")
    ok = lambda c: F.when(F.col("reason").isNull(), c)
    kept = lines.where("line <> ''").withColumns({"reason": reason})
    return kept.select("line_no", ok(F.get(parts, F.lit(0))).alias("bucket"), ok(key).alias("key"), ok(F.get(parts, F.lit(2))).alias("version_id"), ok(F.coalesce(F.get(parts, F.lit(3)), F.lit(""))).alias("last_modified"), ok(encoded).alias("key_encoded"), "reason")


def output_key(key: Column, encoded: Column) -> Column:
    return F.when(encoded, R.query_escape(key)).otherwise(key)


def journal_events(lines: DataFrame, torn_tail: bool = False) -> DataFrame:
    """line_no, kind, prefix, token. A torn last line is left out; another malformed line is an error, as is no line."""
    if torn_tail:
        last = lines.agg(F.max("line_no")).first()[0]
        lines = lines.where(F.col("line_no") != F.lit(last))
    at = lines.withColumn("_j", R.journal_fields(F.col("line")))
    checked = at.where(F.when(F.col("_j").isNull(), F.raise_error(F.concat(F.lit("malformed journal line "), F.col("line_no").cast("string")))).otherwise(True))
    return checked.select("line_no", "_j.kind", "_j.prefix", "_j.token")


def ends_torn(spark: SparkSession, path: str) -> bool:
    """Whether the last file of a path ends without a newline: one byte is read."""
    import pyarrow.fs as pafs

    last = spark.read.format("binaryFile").load(path).select("path", "length").orderBy(F.col("path").desc()).first()
    if not last or not last["length"]:
        return False
    fs, at = pafs.FileSystem.from_uri(last["path"])
    with fs.open_input_file(at) as f:
        f.seek(last["length"] - 1)
        return f.read(1) != b"\n"
