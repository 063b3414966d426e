"""Line dedup (operator 9): lines found in many documents go, by probing a sharded minimal perfect hash.

A line's key is the line stripped of space and U+0009 to U+000D at both ends, with A-Z lower-cased. Distinct line
hashes (128 bits) are counted by documents. All of them go to a minimal perfect hash of shards, each a file of the shared
folder with bit arrays, 32-bit fingerprints and counts (kept up to the threshold, in a byte where that fits). Documents
probe these arrays, whose counts decide; lines aren't joined. A task reads each shard once for every PROBE_BYTES of text
that it has, beyond what its worker keeps.

Null text is one empty line. Empty keys never go. A row that repeats (same doc_id and text) counts as one more document.
Texts and lines of any length are read whole. An empty table gives an empty result. `drop_common_lines` looks at doc_id
and text only; `drop_common_lines_in_place` returns all columns as they are but for text and n_chars, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from keelson.llm.common import get_file, new_folder, put_file, schema_of, text_of, tidy, tucked, untucked

COUNT_SPARK, COUNT_ARROW = schema_of(hi="long", lo="long", n="long")
#: Shards are read when a probe needs them; a worker keeps so many bytes of them.
CACHE_BYTES = 192 << 20
#: A batch's line counts are merged over so many lines before they go to the shuffle.
MERGE_LINES = 400_000
#: Bytes of text whose lines are probed at once.
PROBE_BYTES = 32 << 20


def key_of(line: bytes) -> bytes:
    return line.strip().lower()


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as (n, 2) uint64."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").reshape(-1, 2).astype(np.uint64)


def _merged(parts: list[np.ndarray]) -> pa.RecordBatch:
    h = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
    order = np.lexsort((h[:, 1], h[:, 0]))
    h = h[order]
    first = np.ones(len(h), bool)
    if len(h):
        first[1:] = (h[1:] != h[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(h)))
    h = h[starts]
    return pa.RecordBatch.from_arrays([pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], schema=COUNT_ARROW)


class _LineCounts:
    def __init__(self, min_chars: int):
        self.min_chars = min_chars

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                keys = {key_of(x) for x in text.split(b"\n")}
                keys = [k for k in keys if long_enough(k, self.min_chars)]
                if keys:
                    parts.append(hashes_of(keys))
                    held += len(keys)
                if held >= MERGE_LINES:
                    yield _merged(parts)
                    parts, held = [], 0
        yield _merged(parts)


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 and bool(key) or len(key.decode()) >= max(1, min_chars))


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """hi, lo (a line key's hash) and n, in how many documents the key is."""
    texts = docs.select(text_of(docs).cast("binary").alias("t"))
    return texts.mapInArrow(_LineCounts(min_chars), COUNT_SPARK).groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Another mix of the 64-bit keys for each level, onto 0 to size - 1."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """A minimal perfect hash of distinct (hi, lo) pairs: at each level a key takes a slot that it has alone, the
    others go on; the rank of the slot among all taken slots is the index. Half of lo is kept as fingerprint, n as count."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        self.ranks, before = [], 0
        for bits in levels:
            each = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(before + np.cumsum(each) - each)
            before += int(each.sum())

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, most: int, gamma: float = 1.7) -> PerfectHash:
        """Counts over `most` are kept as most."""
        keys, levels, left = hi ^ (lo << np.uint64(1)), [], np.arange(len(hi))
        while len(left):
            size = max(64, int(gamma * len(left)) + 63 & ~63)
            slot = _slots(keys[left], len(levels), size)
            alone = np.bincount(slot.astype(np.int64), minlength=size)[slot.astype(np.int64)] == 1
            bits = np.zeros(size // 8, np.uint8)
            taken = slot[alone]
            np.bitwise_or.at(bits, (taken >> np.uint64(3)).astype(np.int64), np.uint8(1) << (taken & np.uint64(7)).astype(np.uint8))
            levels.append(bits.view(np.uint64))
            left = left[~alone]
            if len(levels) > 200:
                raise ValueError("two distinct lines have one hash")
        out = cls(levels, np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.min_scalar_type(most)))
        at = out.index(hi, lo)
        out.prints[at] = lo >> np.uint64(32)
        out.counts[at] = np.minimum(n, most)
        return out

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """For members their index; for others any index or -1."""
        keys = hi ^ (lo << np.uint64(1))
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            slot = _slots(keys[left], k, len(bits) * 64)
            word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
            got = bits[word]
            hit = (got >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(got[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = ranks[word[hit]] + below
            left = left[~hit]
        return out

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Documents that have the line; 0 for lines that aren't indexed."""
        at = self.index(hi, lo)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == lo[ok] >> np.uint64(32)
        out = np.zeros(len(hi), self.counts.dtype)
        out[ok] = self.counts[at[ok]]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, prints=self.prints, counts=self.counts, **{f"level{i}": x for i, x in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        z = np.load(io.BytesIO(data))
        return cls([z[f"level{i}"] for i in range(sum(k.startswith("level") for k in z.files))], z["prints"], z["counts"])


class _BuildShard:
    """Builds the shards of a partition: rows (shard, hi, lo, n) sorted by shard."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[int] = []
        parts: list[np.ndarray] = []

        def close() -> None:
            if parts:
                rows = np.concatenate(parts)
                hi, lo = np.ascontiguousarray(rows[:, 1]).view(np.uint64), np.ascontiguousarray(rows[:, 2]).view(np.uint64)
                put_file(self.folder, f"shard-{rows[0, 0]}", PerfectHash.build(hi, lo, rows[:, 3], self.most).dump())
                done.append(int(rows[0, 0]))
                parts.clear()

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for piece in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                if len(piece):
                    if parts and parts[0][0, 0] != piece[0, 0]:
                        close()
                    parts.append(piece)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["shard"])


def build_index(counts: DataFrame, min_docs: int, least: int = 1, shard_keys: int = 500_000) -> tuple[str, int, list[int]]:
    """The index of the lines found in `least` documents or more, which is all of them unless least is raised: its folder,
    its number of shards, and which of these have lines. Up to min_docs a higher least changes no verdict."""
    spark = counts.sparkSession
    folder = new_folder(spark, "line-index")
    table = f"{folder}/counts"
    counts.where(F.col("n") >= least).write.parquet(table)
    lines = spark.read.schema("hi bigint, lo bigint, n bigint").parquet(table)
    shards = max(1, -(-lines.count() // shard_keys))
    of = lines.select(F.pmod(F.col("lo"), F.lit(shards)).alias("shard"), "hi", "lo", "n")
    built = of.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard").mapInArrow(_BuildShard(folder, min_docs), "shard bigint")
    return folder, shards, sorted(r[0] for r in built.collect())


_kept: OrderedDict[tuple[str, int], tuple[PerfectHash, int]] = OrderedDict()


def shard(folder: str, k: int) -> PerfectHash:
    """A shard, from this worker's cache of the last used ones or from the shared folder."""
    if (folder, k) not in _kept:
        data = get_file(folder, f"shard-{k}")
        _kept[folder, k] = (PerfectHash.load(data), len(data))
        while len(_kept) > 1 and sum(x[1] for x in _kept.values()) > CACHE_BYTES:
            _kept.popitem(last=False)
    _kept.move_to_end((folder, k))
    return _kept[folder, k][0]


class _Drop:
    def __init__(self, folder: str, shards: int, full: list[int], min_docs: int, min_chars: int, texts: bool, schema: pa.Schema):
        self.folder, self.shards, self.full, self.min_docs, self.min_chars, self.texts, self.schema = folder, shards, frozenset(full), min_docs, min_chars, texts, schema

    def often(self, h: np.ndarray) -> np.ndarray:
        hi, lo = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
        # as Spark's pmod of the signed value
        which = lo.view(np.int64) % self.shards
        out = np.zeros(len(h), bool)
        for k in np.unique(which):
            if int(k) in self.full:
                m = which == k
                out[m] = shard(self.folder, int(k)).count(hi[m], lo[m]) >= self.min_docs
        return out

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held.append(batch.slice(at, 500))
                size += pc.sum(pc.binary_length(held[-1].column(batch.num_columns - 1))).as_py() or 0
                if size >= PROBE_BYTES:
                    yield self.part(pa.concat_batches(held))
                    held, size = [], 0
        if held:
            yield self.part(pa.concat_batches(held))

    def part(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        docs = [(x or b"").split(b"\n") for x in texts]
        keys = [key_of(x) for lines in docs for x in lines]
        distinct = {k: i for i, k in enumerate(dict.fromkeys(k for k in keys if long_enough(k, self.min_chars)))}
        hit = self.often(hashes_of(list(distinct))) if distinct else np.zeros(0, bool)
        gone = {k for k, i in distinct.items() if hit[i]}
        n_lines, n_dropped, out, at = [], [], [], 0
        for whole, lines in zip(texts, docs):
            kept = [x for x, k in zip(lines, keys[at : at + len(lines)]) if k not in gone] if gone else lines
            at += len(lines)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            text = b"\n".join(kept)
            out.append(None if whole is None else text.decode() if self.texts else hashlib.sha256(text).hexdigest())
        cols = [*batch.columns[:-1], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, texts: bool = True, least: int = 1) -> DataFrame:
    """docs with doc_id, n_lines, n_dropped and either kept_text or kept_sha256 (texts=False), a row for each row."""
    folder, shards, full = build_index(line_counts(docs, min_chars), min_docs, least)
    name = "kept_text" if texts else "kept_sha256"
    spark_schema, arrow = schema_of(doc_id="long", n_lines="long", n_dropped="long", **{name: "string"})
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("t"))
    return rows.mapInArrow(_Drop(folder, shards, full, min_docs, min_chars, texts, arrow), spark_schema)


def drop_common_lines_in_place(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with its own columns, text without the common lines and n_chars made to fit; for pipelines.

    A document whose text is null keeps null. A document all of whose lines go stays, with an empty text."""
    folder, shards, full = build_index(line_counts(docs, min_chars), min_docs)
    rows, own = tucked(docs)
    # texts cross to Python and back once; null stays null
    rows = rows.select(*(n for c, n in own.items() if c != "text"), F.col(own["text"]).cast("string").cast("binary").alias("bytes"))
    schema = StructType([*rows.schema.fields[:-1], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())])
    out = rows.mapInArrow(_Drop(folder, shards, full, min_docs, min_chars, True, to_arrow_schema(schema)), schema)
    changed = {own["text"]: F.col("kept")}
    if "n_chars" in own:
        changed[own["n_chars"]] = F.when(F.col("kept").isNull(), F.col(own["n_chars"])).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*untucked(own))
