"""The folder that driver and executors share, for tables and files that one job writes and the next reads."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, what: str) -> str:
    """A path that is not there yet below spark.checkpoint.dir; a local run without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = "file://" + tempfile.mkdtemp(prefix="spark-keelson-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def put_small(folder: str, name: str, text: str) -> None:
    """Write a small file whole or not at all, in the place of one of that name."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(text.encode())
    try:
        fs.move(part, f"{root}/{name}")
    except OSError:  # a file system that doesn't rename over a file
        if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
            raise
        fs.delete_file(f"{root}/{name}")
        fs.move(part, f"{root}/{name}")


def get_small(folder: str) -> dict[str, str]:
    """The small files of a folder by name; none if it isn't there."""
    fs, root = pafs.FileSystem.from_uri(folder)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.is_file and not info.base_name.startswith("."):
            with fs.open_input_file(info.path) as f:
                out[info.base_name] = f.read().decode()
    return out
