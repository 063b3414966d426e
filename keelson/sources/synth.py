"""Synthetic key trees from parameters: keys by arithmetic on their number, sizes and bodies by hashes, no walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Objects whose numbers a task gets as one row.
RANGE = 500


def total_objects(depth: Column, width: Column, files: Column) -> Column:
    """files * (depth * width + 1): a directory for each leaf and for each step of the chain."""
    return (files * (depth * width + 1)).cast("bigint")


def tree_keys(trees: DataFrame) -> DataFrame:
    """trees (tree, prefix, depth, width, files) with idx and key of every object, in the walk's order of idx.

    A layer holds files beside the next one's directory, then width - 1 leaf directories; the last has one leaf more. Parameters are
    few bytes, which Spark reads in one task, so they are dealt out as ranges of numbers; those of a large tree spread."""
    spark = trees.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = trees.withColumn("_n", total_objects(F.col("depth"), F.col("width"), F.col("files"))).where("_n > 0")
    dealt = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(RANGE).cast("bigint")))).repartition(parts, "tree", "_from")
    rows = dealt.withColumn("idx", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + RANGE, F.col("_n")) - 1))).drop("_n", "_from")
    rows = rows.withColumn("_block", F.col("files") * F.col("width")).withColumn("layer", (F.least(F.expr("idx div _block"), F.col("depth") - 1) + 1).cast("int"))
    rest = F.col("idx") - (F.col("layer") - 1) * F.col("_block")
    rows = rows.withColumn("_rest", rest).withColumns({"slot": F.expr("_rest div files").cast("int"), "file": (F.col("_rest") % F.col("files") + 1).cast("int")})
    root = F.regexp_replace("prefix", "/$", "")
    chain = F.array_join(F.transform(F.sequence(F.lit(1), F.col("layer")), lambda i: F.concat(F.lit("l"), i.cast("string"))), "/")
    leaf = F.when(F.col("slot") > 0, F.concat(F.lit("/d"), F.col("slot").cast("string"))).otherwise("")
    number = F.lpad(F.col("file").cast("string"), F.greatest(F.length(F.col("files").cast("string")), F.length(F.col("file").cast("string"))), F.lit("0"))
    return rows.withColumn("key", F.concat(F.when(root == "", "").otherwise(F.concat(root, F.lit("/"))), chain, leaf, F.lit("/file_"), number)).drop("_block", "_rest")


def draw(seed: Column, low: int, high: int) -> Column:
    """A number from low to high that depends on the seed (text) only: the first 15 hex digits of its md5."""
    return (F.lit(low) + F.pmod(F.conv(F.substring(F.md5(seed.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(high - low + 1))).cast("bigint")


def body(key: Column, size: Column) -> Column:
    """Text of an exact size from md5s of the key with a counter."""
    blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(size / 32) - 1, F.lit(0))), lambda i: F.md5(F.concat(key, F.lit(":"), i.cast("string")).cast("binary")))
    return F.substring(F.array_join(blocks, ""), F.lit(1), size.cast("int"))


def upload_class(size: Column, part_size: Column) -> Column:
    return F.when(size > part_size, "multipart").otherwise("single")


def part_count(size: Column, part_size: Column) -> Column:
    return F.when(size > part_size, F.ceil(size / part_size)).otherwise(F.lit(1)).cast("bigint")
