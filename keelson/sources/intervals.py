"""Rows by key intervals: entries of resume lists become merged half-open ranges of keys.

Keys compare by the bytes of their UTF-8, as Spark compares strings. A prefix p covers the keys from p up to, but without, p
followed by byte FF, which no key holds; a token moves the lower end up behind itself. Overlapping ranges are merged, so a key
lies in one at most. Few ranges become a filter that reaches the scan. More are put among the rows in one order of keys, dealt
by ranges, and each row looks at the last range that begins before it: what the ranges of rows before its own end with
is a small table. Neither way has a key that gathers rows, and the table is passed over once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.sources.shared import new_folder

#: No more merged ranges than this become a filter.
FILTERED = 64
END = b"\xff"


def intervals(entries: DataFrame) -> DataFrame:
    """lo and hi (binary, hi excluded) of entries (prefix and perhaps token, then only keys after the token). Entries whose
    prefix is null, or whose token is behind all their keys, have none; a null token is an empty one."""
    p = F.col("prefix").cast("binary")
    lo = F.greatest(p, F.concat(F.coalesce(F.col("token"), F.lit("")).cast("binary"), F.lit(b"\0"))) if "token" in entries.columns else p
    return entries.where("prefix is not null").select(lo.alias("lo"), F.concat(p, F.lit(END)).alias("hi")).where("lo < hi")


def dealt(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with _range, dealt by ranges of the order and written once."""
    path = new_folder(rows.sparkSession, "swept")
    rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.schema(rows.withColumn("_range", F.lit(0)).schema).parquet(path)


def carried(each: DataFrame, value: Column) -> DataFrame:
    """each (_range, ...) with _carry: value taken over the ranges before. A row for each range."""
    return each.withColumn("_carry", value.over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))


def merged(ranges: DataFrame) -> DataFrame:
    """Ranges (lo, hi) with those that overlap or touch made one. Dealt by lo: a new one begins where lo is behind every hi
    before it."""
    at = dealt(ranges.groupBy("lo").agg(F.max("hi").alias("hi")), F.col("lo"))
    tops = carried(at.groupBy("_range").agg(F.max("hi").alias("_top")), F.max("_top")).select("_range", "_carry")
    within = Window.partitionBy("_range").orderBy("lo")
    before = F.greatest(F.max("hi").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    begun = at.join(F.broadcast(tops), "_range").withColumn("_begin", F.when(before.isNull() | (before < F.col("lo")), F.col("lo")))
    last = carried(begun.groupBy("_range").agg(F.max("_begin").alias("_last")), F.max("_last")).select("_range", F.col("_carry").alias("_from"))
    own = F.max("_begin").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return begun.drop("_carry").join(F.broadcast(last), "_range").withColumn("_lo", F.coalesce(own, "_from")).groupBy(F.col("_lo").alias("lo")).agg(F.max("hi").alias("hi"))


def merged_few(ranges: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """The same for a few ranges at hand."""
    out: list[tuple[bytes, bytes]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept(ranges: DataFrame) -> DataFrame:
    """ranges (lo, hi) written, so that the entries are computed once."""
    path = new_folder(ranges.sparkSession, "key-ranges")
    ranges.write.parquet(path)
    return ranges.sparkSession.read.schema("lo binary, hi binary").parquet(path)


def text_bound(bound: bytes) -> str | None:
    """The least text at or after a bound: itself, or for one that ends in FF the least one after the prefix; None if none is."""
    if not bound.endswith(END):
        return bound.decode()
    prefix = bound[:-1].decode()
    while prefix:
        after = ord(prefix[-1]) + 1
        if after <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if 0xD800 <= after < 0xE000 else after)
        prefix = prefix[:-1]
    return None


def as_filter(key: str, ranges: list[tuple[bytes, bytes]]) -> Column:
    """Whether a key is in one of a few merged ranges, as comparisons with texts that reach a scan."""
    def one(lo: bytes, hi: bytes) -> Column:
        low, high = text_bound(lo), text_bound(hi)
        parts = ([F.col(key) >= low] if low else []) + ([F.col(key) < high] if high is not None else [])
        return reduce(lambda a, b: a & b, parts, F.col(key).isNotNull())

    return reduce(lambda a, b: a | b, (one(*r) for r in ranges), F.lit(False))


def select(rows: DataFrame, entries: DataFrame, inside: bool = True, key: str = "key", filtered: int = FILTERED) -> DataFrame:
    """The rows whose key is in a range of entries (prefix and perhaps token), or, not inside, all others; each row once,
    whole, as often as it is there. A row without a key is in no range."""
    ranges = kept(intervals(entries))
    few = ranges.limit(filtered + 1).collect()
    if len(few) > filtered:
        ranges = kept(merged(ranges))
        few = ranges.limit(filtered + 1).collect()
    if len(few) > filtered:
        return swept(rows, ranges, inside, key)
    within = as_filter(key, merged_few([(bytes(r["lo"]), bytes(r["hi"])) for r in few]))
    return rows.where(within if inside else ~F.coalesce(within, F.lit(False)))


def swept(rows: DataFrame, ranges: DataFrame, inside: bool, key: str) -> DataFrame:
    """`select` for any number of merged ranges (lo, hi): one order of rows and ranges, rows of one key spread over several
    tasks if they are many."""
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    lost = rows.where(F.col(key).isNull())
    kind = rows.select(own.alias("_row")).schema["_row"].dataType
    # (3, 4 and so on: rows of the same key fall apart by a hash)
    marked = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("binary").alias("_at"), (F.pmod(F.xxhash64(own), F.lit(1 << 20)) + 1).cast("int").alias("_salt"), F.lit(None).cast("binary").alias("_hi"), own.alias("_row"))
    every = marked.unionByName(ranges.select(F.col("lo").alias("_at"), F.lit(0).alias("_salt"), F.col("hi").alias("_hi"), F.lit(None).cast(kind).alias("_row")))
    at = dealt(every, F.col("_at"), F.col("_salt"))
    ends = carried(at.groupBy("_range").agg(F.max_by("_hi", F.when(F.col("_hi").isNotNull(), F.col("_at"))).alias("_end")), F.last("_end", True)).select("_range", "_carry")
    last = F.last("_hi", True).over(Window.partitionBy("_range").orderBy("_at", "_salt").rowsBetween(Window.unboundedPreceding, 0))
    found = at.withColumn("_last", last).where("_row is not null").join(F.broadcast(ends), "_range")
    within = F.coalesce(F.col("_at") < F.coalesce("_last", "_carry"), F.lit(False))
    out = found.where(within if inside else ~within).select("_row.*")
    return out if inside else out.unionByName(lost)
