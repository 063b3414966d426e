"""Two whole buckets compared by digests: rows are looked at only where sums of hashes differ.

A row's key falls into a range of hashes, and a range's digest is the number of its rows and two sums of row hashes, which tasks
add up before the shuffle. Ranges whose digests differ between the buckets are cut finer and summed again, then opened:
their rows alone are joined. So what is shuffled grows with the differences; each level reads the tables' few columns once
more. Rows that differ stay unseen only if both 64-bit hashes' sums agree by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.sources.shared import new_folder


def hashed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """key and columns with _h (of the key) and two hashes of the row; nulls count as values of their own."""
    whole = [F.col("key"), F.col("key").isNull(), *(x for c in columns for x in (F.col(c), F.col(c).isNull()))]
    return rows.select("key", *columns, F.xxhash64("key").alias("_h"), F.xxhash64(*whole).alias("_d1"), F.xxhash64(F.lit(1), *whole).alias("_d2"))


def slot(level: int, bits: int) -> Column:
    """The range that a key's hash falls into: its first bits, `bits` more at each level."""
    return F.shiftrightunsigned("_h", 64 - bits * level).cast("long")


def digests(rows: DataFrame, level: int, bits: int) -> DataFrame:
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.groupBy(slot(level, bits).alias("_s")).agg(F.count("*").alias("_n"), total("_d1").alias("_t1"), total("_d2").alias("_t2"))


def within(rows: DataFrame, slots: DataFrame | None, level: int, bits: int) -> DataFrame:
    """The rows in some of a level's ranges. Spark knows the size of the list, which is a written table."""
    return rows if slots is None else rows.withColumn("_s", slot(level, bits)).join(slots, "_s", "left_semi").drop("_s")


def differing(source: DataFrame, target: DataFrame, bits: int = 12, levels: int = 2) -> DataFrame | None:
    """The ranges (_s) of the last level whose digests differ, both tables from `hashed`."""
    slots = None
    for level in range(1, levels + 1):
        a, b = (digests(within(t, slots, level - 1, bits), level, bits) for t in (source, target))
        names = ["_n", "_t1", "_t2"]
        b = b.select("_s", *(F.col(c).alias(f"{c}b") for c in names))
        odd = a.join(b, "_s", "full").where(~(F.col("_n").eqNullSafe(F.col("_nb")) & F.col("_t1").eqNullSafe(F.col("_t1b")) & F.col("_t2").eqNullSafe(F.col("_t2b"))))
        path = new_folder(source.sparkSession, "digests")
        odd.select("_s").write.parquet(path)
        slots = source.sparkSession.read.schema("_s bigint").parquet(path)
    return slots


def compare_buckets(source: DataFrame, target: DataFrame, columns: list[str], bits: int = 12, levels: int = 2) -> DataFrame:
    """key, status (only_source, only_target, differs), and source_* and target_* of each of columns, for all keys of source and
    target (key and columns) that aren't the same in both.

    A key that a table has several times differs unless the other has the same rows as often; its least values are shown."""
    a, b = hashed(source, columns), hashed(target, columns)
    slots = differing(a, b, bits, levels)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))

    def opened(rows: DataFrame, side: str) -> DataFrame:
        each = within(rows, slots, levels, bits).groupBy("key").agg(F.struct(F.count("*"), total("_d1"), total("_d2")).alias("_own"), *(F.min(c).alias(f"{side}_{c}") for c in columns))
        return each.withColumnRenamed("key", f"_{side}").withColumnRenamed("_own", f"_own_{side}")

    both = opened(a, "source").join(opened(b, "target"), F.col("_source").eqNullSafe(F.col("_target")), "full").where(~F.col("_own_source").eqNullSafe(F.col("_own_target")))
    status = F.when(F.col("_own_target").isNull(), "only_source").when(F.col("_own_source").isNull(), "only_target").otherwise("differs")
    return both.select(F.coalesce("_source", "_target").alias("key"), status.alias("status"), *(f"{side}_{c}" for c in columns for side in ("source", "target")))
