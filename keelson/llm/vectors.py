"""Columns of vectors as rows of integers, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Rows that are worked on at once.
ROWS = 4096


def finite(column: str) -> Column:
    """Whether a vector is there and holds numbers only: no null, NaN or infinite entry."""
    return F.coalesce(F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))), F.lit(False))


def vectors(rows: DataFrame, *beside: str) -> DataFrame:
    """vec_id, embedding (floats or doubles, whatever numbers it had) and the columns of rows named in `beside`."""
    kind = getattr(rows.schema["embedding"].dataType, "elementType", None)
    own = rows["embedding"] if isinstance(kind, (FloatType, DoubleType)) else rows["embedding"].cast("array<double>")
    return rows.select(rows["vec_id"].cast("long").alias("vec_id"), own.alias("embedding"), *(rows[c] for c in beside))


def floored(batches: Iterator[pa.RecordBatch], scale: int, most: int, dim: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with a whole vector (column 1), ROWS at a time, and floor(scale * entry) of each as longs.

    All vectors must have one length, `dim` if that is known, and no value may be `most` or larger: else sums and squares
    of the values would not be exact, which is an error rather than a wrong result."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            column = batch.column(1)
            there = np.ones(len(column), bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
            flat, ends = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
            starts = np.cumsum(ends) - ends
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
            keep = there & (bad[starts + ends] == bad[starts])
            batch, starts, ends = batch.filter(pa.array(keep)), starts[keep], ends[keep]
            if not len(ends):
                continue
            dim = int(ends[0]) if dim is None else dim
            if (ends != dim).any():
                raise ValueError(f"vectors of {dim} and of {int(ends[ends != dim][0])} entries in one table")
            found = np.floor(scale * entries[starts[:, None] + np.arange(dim)[None, :]])
            if np.abs(found).max(initial=0) >= most:
                raise ValueError(f"a vector has an entry of {most / scale:g} or more")
            yield batch, found.astype(np.int64)
