"""Shared pieces: tables, the shared folder, small files in it, and null-safe text columns."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where it is unset, a local run gets a temporary folder of its own; a cluster run is refused, since
    executors could not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = "file://" + tempfile.mkdtemp(prefix="spark-keelson-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


_watched: list[list[str]] = []


@contextmanager
def folders_made() -> Iterator[list[str]]:
    """The folders that new_folder names meanwhile, the last one last."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched.remove(made)


def remove_folders(folders: list[str]) -> None:
    """Delete intermediate folders that nothing will read again; those that were never written are passed over."""
    for folder in folders:
        fs, root = pafs.FileSystem.from_uri(folder)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


def new_folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for made in _watched:
        made.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a plan may hold whose rows are rows of a file, each once.
SCANS = re.compile(r"[ :+-]*(Project|Filter|Repartition|SubqueryAlias|View|Relation)\b")


def in_files(df: DataFrame) -> DataFrame:
    """df if it is a scan of files, perhaps with fewer rows or columns or in other partitions: its rows have a place of
    their own. Else, as after a join, df written and read back."""
    plain = all(SCANS.match(line) for line in df._jdf.queryExecution().analyzed().toString().splitlines())
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
        return df if plain else written(df, "rows")
    except AnalysisException:
        return written(df, "rows")


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parallel(df: DataFrame, least: int | None = None) -> DataFrame:
    """df over at least as many partitions as there are cores, where it has fewer."""
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


#: A key with more than one of so many rows is dealt to SPREAD tasks.
SHARE, SPREAD = 512, 16


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with over 1 / SHARE of df's rows: fewer than SHARE, whatever the data. Found once, and written."""
    n = df.count()
    return written(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > n / SHARE).select(key), "hot-keys")


def join_spread(many: DataFrame, one: DataFrame, key: str, by: str | list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """many joined with one (a row for each key), also where a few keys hold most rows of many.

    hot: keys as `hot_keys` finds them. This short list is sent around; its keys' rows of many are dealt by a hash of the
    columns `by` to SPREAD tasks, and one's row goes to each of these."""
    hot = F.broadcast(hot.select(F.col(key).alias("_hot")))
    by = [by] if isinstance(by, str) else by
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    left = many.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
    top = F.when(F.col("_hot").isNotNull(), F.lit(SPREAD - 1)).otherwise(F.lit(0)).cast("long")
    right = one.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), top))).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def arrow_type(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32(), "longs": pa.list_(pa.int64())}[kind]


def schema_of(**kinds: str) -> tuple[str, pa.Schema]:
    """A Spark schema string and the Arrow schema that matches it."""
    spark = ", ".join(f"{k} {'array<bigint>' if v == 'longs' else 'bigint' if v == 'long' else v}" for k, v in kinds.items())
    return spark, pa.schema([(k, arrow_type(v)) for k, v in kinds.items()])


def tidy(task: Callable) -> Callable:
    """A task's function that gives Arrow's unused memory back at its end: its worker is kept for other tasks."""

    @wraps(task)
    def run(*args: object) -> Iterator[pa.RecordBatch]:
        yield from task(*args)
        pa.default_memory_pool().release_unused()

    return run


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file of the shared folder whole or not at all: a retried task replaces it by a rename."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{root}/{name}")


def get_file(folder: str, name: str) -> bytes:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        return f.read()


def local_name(path: str) -> str:
    return os.path.basename(path.rstrip("/"))


def tucked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under names that nothing else uses, and the new name of each: none clashes with an operator's."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def untucked(names: dict[str, str], but: tuple[str, ...] = ()) -> list[Column]:
    """The columns under their own names again, less those of `but`."""
    return [F.col(n).alias(c) for c, n in names.items() if c not in but]
