"""Ranged reads and copies of stored objects, in tasks, through Arrow's file systems."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.sources.shared import new_folder

PIECE = 4 << 20
#: Characters of an encoded segment in one name of a file system.
NAME = 200


def object_name(key: str) -> str:
    """Where a key's object lies below a folder: a segment of the key is a name, '+' marks those that others lie below, '~' a name
    that goes on in the next one. So no key leaves the folder, and 'a' lies beside 'a/b'."""
    segments = [quote(s, safe="-_").replace(".", "%2E").replace("~", "%7E") for s in key.split("/")]
    cut = ["~/".join(s[i : i + NAME] for i in range(0, len(s), NAME)) for s in segments]
    return "/".join([*(f"{s}+" for s in cut[:-1]), cut[-1] or "%"])


def object_path(folder: str, key: str | Column = "key") -> Column:
    """The address of a key's object, as a column."""
    own = F.col(key) if isinstance(key, str) else key
    encoded = lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("."), F.lit("%2E"))
    cut = F.transform(F.split(own, "/"), lambda s: F.regexp_replace(encoded(s), f"(.{{{NAME}}})(?=.)", "$1~/"))
    last = F.element_at(cut, -1)
    above = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda s: F.concat(s, F.lit("+/")))
    return F.concat(F.lit(f"{folder}/"), F.array_join(above, ""), F.when(last == "", "%").otherwise(last))


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of an address whose key may hold any character. Arrow decodes addresses, not plain paths."""
    return pafs.FileSystem.from_uri(uri if uri.startswith("/") else quote(uri, safe="/:@"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            fs, at = located(path)
            with fs.open_input_file(at) as f:
                f.seek(min(start, f.size()))
                out.append(f.read(length))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["path", "start", "length", "body"])


def read_ranges(probes: DataFrame) -> DataFrame:
    """probes (path, start, length) with body; shorter than asked at an object's end only."""
    rows = probes.select("path", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"))
    return rows.repartition("path").mapInArrow(_read, "path string, start bigint, length bigint, body binary")


def _store(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = located(f"{folder}/{object_name(key)}")
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as out:
                    out.write(body)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["key"])

    return store


def store_objects(rows: DataFrame, folder: str) -> int:
    """Write each row (key, body) as the object `object_path` of its key; how many there are. A repeated task writes the same
    again."""
    return rows.select("key", F.col("body").cast("binary").alias("body")).mapInArrow(_store(folder), "key string").count()


def relay(source: str, target: str, offsets: list[int] | None, size: int) -> str:
    """Copy one object by parts and return its ETag. Raises if the source isn't there or is short, or if a part has no
    bytes; then nothing is left at the target. One piece is in memory at a time."""
    ends = [*(offsets or [0])[1:], size]
    for k, (start, end) in enumerate(zip(offsets or [0], ends), 1):
        if end <= start and offsets:
            raise ValueError(f"part {k} at offset {start} has length {end - start}")
    (fs, at), (to, place) = located(source), located(target)
    to.create_dir(place.rpartition("/")[0], recursive=True)
    partial = f"{place}.{uuid.uuid4().hex}.part"
    whole, parts = hashlib.md5(), []
    try:
        with fs.open_input_file(at) as f, to.open_output_stream(partial) as out:
            for start, end in zip(offsets or [0], ends):
                part = hashlib.md5()
                f.seek(min(start, f.size()))
                while start < end:
                    if not (data := f.read(min(PIECE, end - start))):
                        raise ValueError(f"the source ends at {start}, {end - start} bytes before the part's end")
                    out.write(data)
                    whole.update(data)
                    part.update(data)
                    start += len(data)
                parts.append(part.digest())
        to.move(partial, place)
    except BaseException:
        if to.get_file_info(partial).type != pafs.FileType.NotFound:
            to.delete_file(partial)
        raise
    return f"{hashlib.md5(b''.join(parts)).hexdigest()}-{len(parts)}" if offsets else whole.hexdigest()


def _copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, source, target, offsets, size in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                rows.append((key, target, relay(source, target, offsets, size), None))
            except (OSError, ValueError) as e:
                rows.append((key, target, None, str(e)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 4)], names=["key", "target", "dst_etag", "error"])


def copy_objects(objects: DataFrame) -> DataFrame:
    """objects (key, source, target, offsets, size) copied part by part; key, target, dst_etag and error of each.

    Null offsets: one part, a plain md5; else the composite ETag of the parts. A copy that fails has no ETag and leaves no
    object; a repeated task writes the same bytes to the same target. The copies are made once, before this returns."""
    rows = objects.select("key", "source", "target", F.col("offsets").cast("array<bigint>").alias("offsets"), F.col("size").cast("bigint").alias("size"))
    path = new_folder(rows.sparkSession, "copies")
    rows.mapInArrow(_copy, "key string, target string, dst_etag string, error string").write.parquet(path)
    return rows.sparkSession.read.schema("key string, target string, dst_etag string, error string").parquet(path)
