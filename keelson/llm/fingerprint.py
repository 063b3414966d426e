"""Document fingerprints (operator 10): context-triggered piecewise hashing.

A rolling hash of the last eight bytes marks chunk borders; every chunk gives one of 64 letters. A fingerprint is
`size:letters:letters`, with letters at a block size and at its double, the size fitted to the length. Two
fingerprints are compared at block sizes that both have, by the edit distance (insertions and deletions) of letters.

Texts are read whole, null as empty. Equal texts have equal fingerprints. For neighbours, rows are ordered by
(doc_id, hash of the text), null doc_ids first; a row that repeats is its own neighbour's text. An empty table gives an
empty result. Other columns of docs are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import schema_of, text_of, written

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LEAST_BLOCK, CHUNKS, WINDOW = 4, 64, 8
#: Bytes that are hashed at once; longer texts go by in segments.
SEGMENT = 1 << 22


def _table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x << np.uint64(29))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


TABLE = _table()


class Rolled:
    """Rolling hashes of a text's bytes, by segment; kept while the text is short, made again for each level if not."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.kept = [self._segment(0)] if len(data) <= SEGMENT else None

    def _segment(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        before = max(0, start - WINDOW + 1)
        g = TABLE[self.data[before : start + SEGMENT]]
        for k in (1, 2, 4):  # each doubles the window
            if len(g) > k:
                more = g[:-k] << np.uint32(k)
                g = g.copy() if k == 1 else g
                g[k:] += more
        g = g[start - before :]
        trigger = g * np.uint32(0x9E3779B1)
        trigger ^= trigger >> np.uint32(15)
        sums = g.astype(np.uint64)
        sums *= np.uint64(0xD6E8FEB86659FD93)
        sums ^= sums >> np.uint64(32)
        np.cumsum(sums, out=sums)
        return trigger, sums

    def letters(self, block: int) -> bytes:
        """A letter for each chunk that a border ends, and for what is left."""
        ends, before, n = [], np.uint64(0), len(self.data)
        with np.errstate(over="ignore"):
            for start in range(0, n, SEGMENT):
                trigger, sums = self.kept[0] if self.kept else self._segment(start)
                ends.append(sums[np.flatnonzero(trigger & np.uint32(block - 1) == 0)] + before)
                before = before + sums[-1]
            if not ends:
                return b""
            s = np.concatenate(ends)
            if not len(s) or s[-1] != before:
                s = np.append(s, before)
            each = np.diff(s, prepend=np.uint64(0))
            each = (each ^ (each >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return LETTERS[(each >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(data: bytes) -> str:
    """The block size is the largest at which the text has half of CHUNKS chunks or more, LEAST_BLOCK at least."""
    block = LEAST_BLOCK
    while block * CHUNKS < len(data):
        block *= 2
    rolled = Rolled(data)
    with np.errstate(over="ignore"):
        one, two = rolled.letters(block), None
        while len(one) < CHUNKS // 2 and block > LEAST_BLOCK:
            block //= 2
            one, two = rolled.letters(block), one
        two = rolled.letters(block * 2) if two is None else two
    return f"{block}:{one.decode()}:{two.decode()}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, in one pass with a bit for each letter of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def alike(a: str, b: str) -> float:
    """1 - distance / (lengths together), or 0 unless a run of letters is common to both."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    need = min(5, max(1, min(len(a), len(b)) // 2))
    runs = {a[i : i + need] for i in range(len(a) - need + 1)}
    if not any(b[i : i + need] in runs for i in range(len(b) - need + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(one: str, two: str) -> float:
    """0 to 1; 0 where the two have no block size in common."""
    if one == two:
        return 1.0
    (a, a1, a2), (b, b1, b2) = one.split(":"), two.split(":")
    a, b = int(a), int(b)
    if a == b:
        return max(alike(a1, b1), alike(a2, b2))
    return alike(a1, b2) if a == 2 * b else alike(a2, b1) if b == 2 * a else 0.0


PAIR_SPARK, PAIR_ARROW = schema_of(doc_id="long", n_chars="long", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, copy, doc_id, text) in order; each bucket ends with a copy of the row after it."""
    last = None
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch, rows = whole.slice(at, 500), []
            for bucket, copied, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                mark = fingerprint(text.encode())
                if last and last[0] == bucket:
                    _, _, own_doc, own, own_mark = last
                    half = len(own) // 2
                    edited = (own[: len(own) - half] + text[:half]).encode()
                    edited_mark = fingerprint(edited)
                    rows.append((own_doc, len(own), hashlib.sha256(edited).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                last = None if copied else (bucket, copied, doc, text, mark)
            cols = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PAIR_ARROW)], schema=PAIR_ARROW)


class _Targets:
    """The range of a row's key (doc_id, hash), and for the first row of a range the range before it too."""

    def __init__(self, bounds: list[int], heads: dict[tuple[int, int], tuple[int, int]]):
        self.bounds, self.heads = np.array(bounds, np.int64), heads

    def bucket(self, doc: np.ndarray, salt: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.bounds, doc, "left"), np.searchsorted(self.bounds, doc, "right")
        # a doc_id that is itself several bounds has several ranges: its rows are dealt to them by the salt, in order
        part = ((salt.astype(np.float64) + 2.0**63) / 2.0**64 * (high - low)).astype(np.int64)
        return np.where(high - low > 1, low + 1 + np.minimum(part, high - low - 1), high)

    def udf(self):
        def targets(doc: pa.Array, salt: pa.Array) -> pa.Array:
            d, s = doc.fill_null(-(2**63)).to_numpy(), salt.to_numpy(zero_copy_only=False)
            out = []
            for k, x, y in zip(self.bucket(d, s).tolist(), doc.to_pylist(), s.tolist()):
                out.append([k, *(b for _, b in self.heads.get((x, y), ()))])
            return pa.array(out, pa.list_(pa.int32()))

        return F.arrow_udf(targets, "array<int>")


def fingerprints_with_next(docs: DataFrame, range_bytes: int = 8 << 20, max_ranges: int = 200_000) -> DataFrame:
    """Fingerprints of each text, of its edited text, and its likeness to the edited and the next document's text.

    The last half of the edited text's code points (rounded down) is the first as many of the next document, by
    ascending doc_id, after the last the first. Rows go to ranges of doc_id of about range_bytes; whole texts move once.
    The first row of each range goes to the range before it too, so that neighbours meet in one task."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    keys = written(rows.select("doc_id", F.xxhash64("text").alias("salt"), F.octet_length("text").alias("size")), "fingerprint-keys")
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], PAIR_SPARK)
    ranges = int(min(max_ranges, n, max(1, -(-total // range_bytes))))
    probs = [i / ranges for i in range(1, ranges)]
    known = keys.select(F.col("doc_id").cast("double").alias("d")).where("d is not null")
    bounds = sorted(int(b) for b in known.approxQuantile("d", probs, min(0.01, 0.25 / ranges))) if probs else []
    bucket_of = _Targets(bounds, {}).udf()
    first = keys.select("doc_id", "salt", bucket_of("doc_id", "salt")[0].alias("b")).groupBy("b").agg(F.min(F.struct("doc_id", "salt")).alias("k")).collect()
    heads = sorted((r["b"], r["k"]["doc_id"], r["k"]["salt"]) for r in first if r["k"]["doc_id"] is not None)
    heads = [(r["b"], None, r["k"]["salt"]) for r in first if r["k"]["doc_id"] is None] + heads
    before: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, (b, doc, salt) in enumerate(heads):
        before.setdefault((doc, salt), []).append((b, heads[i - 1][0]))
    targets = _Targets(bounds, before).udf()
    sent = rows.withColumn("t", targets("doc_id", F.xxhash64("text"))).select("doc_id", "text", F.posexplode("t").alias("copied", "bucket"))
    placed = sent.withColumn("salt", F.xxhash64("text")).repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "copied", F.col("doc_id").asc_nulls_first(), "salt")
    return placed.select("bucket", (F.col("copied") > 0).alias("copied"), "doc_id", "text").mapInArrow(_compare, PAIR_SPARK)
