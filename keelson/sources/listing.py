"""Listings of an inventory (bucket, key, size, ...) and of versions, as relations instead of page loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.sources import intervals
from keelson.sources.shared import new_folder


def flat(inventory: DataFrame, prefix: str, start_after: str = "") -> DataFrame:
    """Every object under a prefix; the filters reach the scan."""
    found = inventory.where(F.col("key").startswith(prefix)) if prefix else inventory
    return found.where(F.col("key") > start_after) if start_after else found


def one_level(inventory: DataFrame, prefix: str = "") -> DataFrame:
    """kind (object, prefix) and entry of a delimited listing: direct objects and distinct common prefixes."""
    rest = F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key"))
    cut = F.instr(rest, "/")
    at = flat(inventory, prefix).select("key", cut.alias("cut"))
    objects = at.where("cut = 0").select(F.lit("object").alias("kind"), F.col("key").alias("entry"))
    prefixes = at.where("cut > 0").select(F.substring("key", F.lit(1), F.lit(len(prefix)) + F.col("cut")).alias("entry")).distinct()
    return objects.unionByName(prefixes.select(F.lit("prefix").alias("kind"), "entry"))


def ancestors(key: Column) -> Column:
    """All prefixes of a key that end in '/', the root ('') first."""
    parts = F.split(key, "/")
    depth = F.size(parts) - 1
    inner = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    return F.concat(F.array(F.lit("")), F.coalesce(inner, F.array().cast("array<string>")))


def parent(key: Column) -> Column:
    """The directory that a key lies in: up to its last '/', '' at the root."""
    return F.substring(key, F.lit(1), F.length(key) - F.length(F.substring_index(key, "/", -1)))


def prefixes(inventory: DataFrame) -> DataFrame:
    """Every directory of the tree once, the root included: distinct parents of keys first, then those above them."""
    own = inventory.select(parent(F.col("key")).alias("d")).distinct()
    return own.select(F.explode(ancestors(F.col("d"))).alias("prefix")).distinct()


def walk(inventory: DataFrame, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects that a recursive walk reaches, and the failed prefixes; siblings of a failed prefix are kept."""
    if failed is None:
        return inventory, inventory.select(F.lit("").alias("prefix")).limit(0)
    return intervals.select(inventory, failed.select("prefix"), inside=False), failed


def two_phase(inventory: DataFrame, start_after: str = "") -> DataFrame:
    """Root objects after a marker, then everything below the sub-prefixes after it."""
    cut = F.instr("key", "/")
    root = inventory.where((cut == 0) & (F.col("key") > start_after))
    return root.unionByName(inventory.where((cut > 0) & (F.substring("key", F.lit(1), cut) > start_after)))


def countable(inventory: DataFrame) -> DataFrame:
    """Without directory placeholders."""
    return inventory.where((F.col("key") != "") & ~F.col("key").endswith("/"))


def usage(inventory: DataFrame) -> DataFrame:
    """prefix, files, dirs (itself included) and bytes below it. Sizes below 0 count as 0.

    Rows are added up by the directory that they lie in, within tasks first; only directories go up the tree."""
    own = inventory.groupBy(parent(F.col("key")).alias("d")).agg(F.count("*").alias("files"), F.sum(F.greatest("size", F.lit(0))).alias("size"))
    up = own.select(F.explode(ancestors(F.col("d"))).alias("prefix"), "files", "size")
    files = up.groupBy("prefix").agg(F.sum("files").alias("files"), F.sum("size").alias("bytes"))
    below = files.select(F.explode(ancestors(F.col("prefix"))).alias("prefix"))
    dirs = below.groupBy("prefix").agg(F.count("*").alias("dirs"))
    return files.join(dirs, "prefix").select("prefix", "files", "dirs", "bytes")


def version_order(versions: DataFrame) -> Window:
    """Key ascending, newest first; the version id decides between equal times."""
    return Window.partitionBy("bucket", "key").orderBy(F.col("last_modified").desc(), F.col("version_id"))


def versions_after(versions: DataFrame, key_marker: str, version_marker: str) -> DataFrame:
    """Versions after a marker pair: later keys, and of the marker's key those after the marked version."""
    if not version_marker:
        return versions.where(F.col("key") > key_marker)
    rn = F.row_number().over(version_order(versions))
    ranked = versions.where(F.col("key") >= key_marker).withColumn("_rn", rn)
    at = F.max(F.when((F.col("key") == key_marker) & (F.col("version_id") == version_marker), F.col("_rn"))).over(Window.partitionBy("bucket", "key"))
    return ranked.withColumn("_at", at).where((F.col("key") > key_marker) | (F.col("_rn") > F.coalesce("_at", F.lit(0)))).drop("_rn", "_at")


def under_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (key) under any of the entries (prefix), once each."""
    return intervals.select(rows, entries.select("prefix"))


def resumed(inventory: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows under the prefix of an entry (prefix, token) and after its token, once each."""
    return intervals.select(inventory, entries.select("prefix", "token"))


def in_ranges(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with _range, dealt by ranges of (by, order) and written once: no task holds a whole group."""
    spark = rows.sparkSession
    path = new_folder(spark, "ranges")
    rows.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def numbered(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with row_no (from 1) within `by` in a total order, without a task that holds a whole group.

    A group's rows in a range are numbered from the count of those in the ranges before it. The one window over a whole
    group has a row for each of its ranges."""
    dealt = in_ranges(rows, by, order)
    each = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    at = dealt.withColumn("_within", within).join(starts, [*same, F.col("_range") == F.col("_r")])
    return at.select(*rows.columns, (F.col("_before") + F.col("_within")).cast("bigint").alias("row_no"))


def ordered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with row_no, their place in one order of all rows."""
    return numbered(rows.withColumn("_all", F.lit(0)), ["_all"], order).drop("_all")


def pages(entries: DataFrame, size: int) -> DataFrame:
    """prefix, page, entries, first, next_marker and truncated for the ordered entries (prefix, entry) of each prefix."""
    at = numbered(entries.select("prefix", "entry"), ["prefix"], [F.col("entry")])
    each = at.groupBy("prefix", F.ceil(F.col("row_no") / size).cast("bigint").alias("page")).agg(F.count("*").alias("entries"), F.min("entry").alias("first"), F.max("entry").alias("next_marker"))
    last = each.groupBy("prefix").agg(F.max("page").alias("_last"))
    return each.join(last, "prefix").select("prefix", "page", "entries", "first", "next_marker", (F.col("page") < F.col("_last")).alias("truncated"))


def first_page(inventory: DataFrame, marker: str, size: int) -> DataFrame:
    return inventory.where(F.col("key") > marker).select("key", "size").orderBy("key").limit(size)
