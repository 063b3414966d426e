"""Result folders that bear a repeated job: a list says which runs are there.

Below a path, `runs` has a folder for each attempt at writing a run, and `list` a small file for each run that names the attempt
that counts. An attempt is written under a name of its own; then one rename puts it on the list, in the place of an earlier
attempt of the same run. Readers take what the list names: a job that is repeated, or dies half way, leaves each line
once. The list is as long as there were runs. Counters of a run, observed while it was written, stand with it on the list, so
they come and go with its lines."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from keelson.sources.shared import get_small, put_small


def commit(path: str, run: str, write: Callable[[str], None], counters: Callable[[], dict[str, int]] = dict) -> str:
    """Let write(folder) write an attempt of a run, and put it on the list with what counters() then says; its folder."""
    root = path.rstrip("/")
    attempt = f"attempt={quote(run, safe='')}.{uuid.uuid4().hex}"
    write(f"{root}/runs/{attempt}")
    put_small(f"{root}/list", quote(run, safe=""), f"{attempt}\n{json.dumps(counters())}")
    return f"{root}/runs/{attempt}"


def committed(path: str, but: str | None = None) -> list[str]:
    """The folders of the runs on the list, less that of one run."""
    root = path.rstrip("/")
    skip = quote(but, safe="") if but is not None else None
    return [f"{root}/runs/{entry.splitlines()[0]}" for run, entry in sorted(get_small(f"{root}/list").items()) if run != skip]


def counters(path: str) -> dict[str, int]:
    """Sums of the counters of all runs on the list."""
    out: Counter[str] = Counter()
    for entry in get_small(f"{path.rstrip('/')}/list").values():
        out.update(json.loads(entry.splitlines()[1]))
    return dict(out)


def read_committed(spark: SparkSession, path: str, kind: str, schema: str, but: str | None = None) -> DataFrame:
    """What the runs on the list hold, in files of a kind (text, json, parquet)."""
    folders = committed(path, but)
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, attempt string").format(kind).option("basePath", f"{path.rstrip('/')}/runs")
    return rows.load(folders).drop("attempt")


def remove_unlisted(path: str) -> int:
    """Delete attempts that aren't on the list, when no job writes; how many there were."""
    fs, root = pafs.FileSystem.from_uri(path.rstrip("/"))
    kept = {entry.splitlines()[0] for entry in get_small(f"{path.rstrip('/')}/list").values()}
    gone = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{root}/runs", allow_not_found=True)) if x.base_name not in kept]
    for folder in gone:
        fs.delete_dir(folder)
    return len(gone)
