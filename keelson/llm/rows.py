"""Rows of files by address, and sets of chosen rows that tasks look up page by page.

An address is (_file, _row): a hash of the data file's path and the row's number in the file. Chosen rows are kept as
bit maps, one for each page of PAGE rows of a file, in the shared folder, with a list of these pages: 16 bytes for each file
that has a chosen row, as many as the files that Spark's driver lists for a scan. A task reads only the list and the pages of
the files that it scans, so rows are chosen where they are: no whole row is shuffled and nothing is sent to all executors. A
page that is on the list and can't be read is an error, as is a list that is gone.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import get_file, in_files, new_folder, put_file

#: Rows of a page: 128 KB of bits.
PAGE = 1 << 20
#: Pages that a worker keeps, and lists.
KEPT_PAGES, KEPT_LISTS = 64, 4
LIST = "pages"


def addressed(docs: DataFrame) -> DataFrame:
    """docs with _file and _row (longs). What is no plain scan of files is written first: after a join, say, one place in a
    file may stand for several rows."""
    docs = in_files(docs)
    of = docs.metadataColumn("_metadata")
    return docs.withColumns({"_file": F.xxhash64(of["file_path"]), "_row": of["row_index"].cast("long")})


def _name(file: int, page: int) -> str:
    return f"{file & (2**64 - 1):016x}-{page}"


class _Put:
    """Writes pages from rows (_file, page, word, bits), a page's rows together."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, bits, pages = None, np.zeros(0, np.int64), []
        for batch in batches:
            file, page, word, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(page) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(file)]):
                if a == b:
                    continue
                if of != (int(file[a]), int(page[a])):
                    if of:
                        put_file(self.folder, _name(*of), bits.tobytes())
                    of, bits = (int(file[a]), int(page[a])), np.zeros(PAGE // 64, np.int64)
                    pages.append(of)
                bits[word[a:b]] |= value[a:b]
        if of:
            put_file(self.folder, _name(*of), bits.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pages], pa.int64()) for i in (0, 1)], names=["file", "page"])


def choose(picks: DataFrame) -> str:
    """Keep the addresses (_file, _row) of picks in a folder, for `chosen`. Repeated ones count once."""
    folder = new_folder(picks.sparkSession, "chosen")
    at = F.pmod("_row", F.lit(PAGE))
    bits = picks.select("_file", F.expr(f"_row div {PAGE}").alias("page"), F.shiftright(at, 6).cast("long").alias("word"), F.expr(f"shiftleft(1L, int(pmod(_row, 64)))").alias("bit"))
    words = bits.groupBy("_file", "page", "word").agg(F.bit_or("bit").alias("bits"))
    found = words.repartition("_file", "page").sortWithinPartitions("_file", "page").mapInArrow(_Put(folder), "file bigint, page bigint").toArrow()
    put_list(folder, found.column("file").to_numpy(), found.column("page").to_numpy())
    return folder


def put_list(folder: str, files: np.ndarray, pages: np.ndarray) -> None:
    """Write the list of a folder's pages, in their order."""
    order = np.lexsort((pages, files))
    put_file(folder, LIST, np.stack([files[order], pages[order]]).astype("<i8").tobytes())


_lists: OrderedDict[str, np.ndarray] = OrderedDict()
_kept: OrderedDict[tuple[str, int, int], np.ndarray] = OrderedDict()


def _listed(folder: str, file: int, page: int) -> bool:
    """Whether a page has chosen rows."""
    if folder not in _lists:
        _lists[folder] = np.frombuffer(get_file(folder, LIST), "<i8").reshape(2, -1)
        while len(_lists) > KEPT_LISTS:
            _lists.popitem(last=False)
    files, pages = _lists[folder]
    a, b = np.searchsorted(files, file), np.searchsorted(files, file, "right")
    at = a + np.searchsorted(pages[a:b], page)
    return bool(at < b and pages[at] == page)


def _page(folder: str, file: int, page: int) -> np.ndarray | None:
    """The bits of a page as bytes; None if no row of it is chosen."""
    if not _listed(folder, file, page):
        return None
    key = (folder, file, page)
    if key not in _kept:
        _kept[key] = np.frombuffer(get_file(folder, _name(file, page)), np.uint8)
        while len(_kept) > KEPT_PAGES:
            _kept.popitem(last=False)
    _kept.move_to_end(key)
    return _kept[key]


def mask(folder: str, files: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the addresses are among those of `choose`."""
    out = np.zeros(len(files), bool)
    pages = rows // PAGE
    edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(pages) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, len(files)]):
        if a < b and (bits := _page(folder, int(files[a]), int(pages[a]))) is not None:
            at = rows[a:b] % PAGE
            out[a:b] = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
    return out


def chosen(folder: str) -> Column:
    """Whether the row at (_file, _row) is among those of `choose`."""

    @F.arrow_udf("boolean")
    def look(file: pa.Array, row: pa.Array) -> pa.Array:
        return pa.array(mask(folder, file.to_numpy(), row.to_numpy()))

    return look("_file", "_row")
