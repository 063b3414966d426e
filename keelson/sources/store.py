"""Listing of a store of objects, breadth first: each round lists the prefixes of one level in tasks.

A round's prefixes are a table; tasks list each through Arrow's file systems and return its objects and its sub-prefixes, which
are the next round's table. A prefix that can't be listed becomes a row with its error, and its siblings go on. The driver
sees whether a round found prefixes, not which. A level's prefixes are dealt out by a hash, so those of one parent spread. A
task holds one directory's entries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.ranged import located
from keelson.sources.shared import new_folder

FOUND = "kind string, entry string, place string, size bigint, error string"
NAMES = ["kind", "entry", "place", "size", "error"]


def key_at(place: str) -> str:
    """The key, or prefix of keys, that a place below the root stands for (`ranged.object_name`)."""
    *above, last = place.replace("~/", "").split("/")
    return "".join(f"{unquote(s[:-1])}/" for s in above) + ("" if last == "%" else unquote(last))


def entries_of(root: str, place: str) -> Iterator[tuple[str, str, str, int | None, str | None]]:
    """kind (object, prefix, part), entry, place below root, size and error of what a directory holds. A part is a long
    segment that goes on below: no prefix of keys yet."""
    fs, at = located(f"{root}/{place}".rstrip("/"))
    for info in fs.get_file_info(pafs.FileSelector(at)):
        below = f"{place}{info.base_name}"
        if info.type != pafs.FileType.Directory:
            yield "object", key_at(below), below, info.size, None
        elif below.endswith("~"):
            yield "part", "", f"{below}/", None, None
        else:
            yield "prefix", key_at(f"{below}/"), f"{below}/", None, None


def _list(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column(0).to_pylist():
                try:
                    rows = list(entries_of(root, place))
                except OSError as e:
                    rows = [("list_failed", key_at(place), place, None, str(e))]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=NAMES)

    return each


def listed(spark: SparkSession, root: str) -> DataFrame:
    """kind (object, prefix, list_failed), entry, size and error of everything below a store's root."""
    folder = new_folder(spark, "listed")
    front = spark.createDataFrame([("",)], "place string")
    level = 0
    while True:
        path = f"{folder}/level={level}"
        front.repartition(F.xxhash64("place")).mapInArrow(_list(root.rstrip("/")), FOUND).write.parquet(path)
        front = spark.read.schema(FOUND).parquet(path).where(F.col("kind").isin("prefix", "part")).select("place")
        if not front.take(1):
            break
        level += 1
    every = spark.read.schema(f"{FOUND}, level int").option("basePath", folder).parquet(*(f"{folder}/level={i}" for i in range(level + 1)))
    return every.where("kind <> 'part'").select("kind", "entry", "size", "error")
