"""Best-fit packing (operator 13) of tokenised documents into sequences of a fixed number of tokens.

A document is its ids and an end id; one that is longer than a sequence is cut into full pieces, the first of which may be
shorter. Which piece goes where depends on lengths only, so the plan is made for the counts of lengths (as many numbers as
a sequence has tokens) and its rows are ranges of pieces of one length: time and size of the plan depend on the sequence's
length, not on the number of pieces. Pieces above a third of a sequence come in at most two to a sequence: greedy matching
gives each, from the largest down, the largest other that fits. Then smaller ones, from the largest down, go into the least gap
that takes them, or into new sequences when none does.

Pieces are numbered within their length without gathering them: tasks number their own, and sums of the tasks' counts say
where each begins. Every task looks its pieces up in the plan, a file in the shared folder.

Null text is a document of the end id alone. Texts of any length are tokenised in parts split where the pattern always has a
border. Rows that repeat are packed each. An empty table gives an empty result. Other columns of docs are not looked at.
"""

from __future__ import annotations

import io
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keelson.llm.bpe import encode
from keelson.llm.common import get_file, new_folder, put_file, schema_of, text_of, tidy, written

#: A task holds its first text of each batch, up to so many characters, against the tokenizers library.
PROVED = 5_000
PIECE_SPARK, PIECE_ARROW = schema_of(doc_id="long", piece="int", start="long", length="long", ids_crc32="long", task="long", number="long")
PACK_SPARK, PACK_ARROW = schema_of(doc_id="long", piece="int", start="long", length="long", ids_crc32="long", sequence_id="long", offset="long")


class Ids:
    """Ids of a tokenizer file with a byte-level vocabulary, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    The library's own pre-tokenizer is the slow part, so the file's merges go to tiktoken, whose ranks are the merges' order;
    that both agree is checked on loading (merges and numbers in one order) and on a text of every batch. A text that
    holds an added token's string, or a file of another kind, goes to the library itself."""

    def __init__(self, path: str, pattern: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.added = [t["content"] for t in own.get("added_tokens", [])]
        self.fast = None
        shape = own.get("pre_tokenizer") or {}
        plain = shape.get("type") == "ByteLevel" and not shape.get("add_prefix_space") and shape.get("use_regex", True) and not own.get("normalizer")
        model = own["model"]
        if plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            number = {token: i for i, token in enumerate(byte_letters())}
            ranks = {bytes(number[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added}
            merges = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            if merges == sorted(merges) and len(set(merges)) == len(merges):
                self.fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(t in text for t in self.added):
            return self.slow(text)
        return encode(self.fast, text)

    def slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def prove(self, text: str) -> None:
        text = text[:PROVED]
        if self(text) != self.slow(text):
            raise RuntimeError(f"the tokenizers library gives other ids for {text[:100]!r}")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else one from U+0100 on."""
    shows = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shows]
    return [chr(b) if b in shows else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(2)
def loaded(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


def cut_at(n: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


class _Pieces:
    """Rows (doc_id, text) to their pieces, numbered in this task within their length."""

    def __init__(self, path: str, pattern: str, end: int, capacity: int):
        self.path, self.pattern, self.end, self.capacity = path, pattern, end, capacity

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, seen = loaded(self.path, self.pattern), TaskContext.get().partitionId(), defaultdict(int)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, rows = whole.slice(at, 500), []
                texts = batch.column(1).to_pylist()
                ids.prove(texts[0])
                for doc, text in zip(batch.column(0).to_pylist(), texts):
                    own = np.array([*ids(text), self.end], "<u4")
                    for k, (start, n) in enumerate(cut_at(len(own), self.capacity)):
                        rows.append((doc, k, start, n, zlib.crc32(own[start : start + n].tobytes()), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE_ARROW)], schema=PIECE_ARROW)


class Plan:
    """Rows (length, first number, how many to a sequence, first sequence, offset) that say where pieces go, made from the
    number of pieces of each length. Sequences with the same content are kept as ranges of sequence numbers."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c}
        self.taken: dict[int, int] = defaultdict(int)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap to ranges (first sequence, how many)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        large = capacity // 3 + 1
        self.match(large)
        for n in range(min(large - 1, capacity), 0, -1):
            if self.left.get(n):
                self.fit(n)

    def new(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def put(self, n: int, each: int, first: int, many: int, gap: int) -> None:
        """each * many pieces of length n into the sequences of a range that has this gap; their gap shrinks."""
        self.rows.append((n, self.taken[n], each, first, self.capacity - gap))
        self.taken[n] += each * many
        self.left[n] -= each * many
        if gap > each * n:
            self.gaps[gap - each * n].append((first, many))

    def match(self, large: int) -> None:
        """Pieces of `large` or more, two to a sequence where that is possible."""
        for n in range(self.capacity, large - 1, -1):
            other = min(n, self.capacity - n)
            while self.left.get(n):
                while other >= large and (not self.left.get(other) or other == n and self.left[n] < 2):
                    other -= 1
                if other < large:
                    self.put(n, 1, self.new(self.left[n]), self.left[n], self.capacity)
                    break
                many = self.left[n] // 2 if other == n else min(self.left[n], self.left[other])
                first = self.new(many)
                if other == n:
                    self.put(n, 2, first, many, self.capacity)
                else:
                    self.put(n, 1, first, many, self.capacity)
                    self.gaps[self.capacity - n].pop()
                    self.put(other, 1, first, many, self.capacity - n)

    def fit(self, n: int) -> None:
        """Pieces of length n into the least gaps that take them: a sequence gets as many as it takes before the next."""
        for gap in sorted(g for g, ranges in self.gaps.items() if g >= n and ranges):
            while self.left[n] and self.gaps[gap]:
                first, many = self.gaps[gap].pop()
                each = min(gap // n, self.left[n])
                used = min(many, self.left[n] // each)
                if many > used:
                    self.gaps[gap].append((first + used, many - used))
                self.put(n, each, first, used, gap)
        each = self.capacity // n
        if many := self.left[n] // each:
            self.put(n, each, self.new(many), many, self.capacity)
        if rest := self.left[n]:
            self.put(n, rest, self.new(1), 1, self.capacity)

    def array(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 5)


@lru_cache(4)
def plan_in(folder: str) -> np.ndarray:
    return np.load(io.BytesIO(get_file(folder, "plan.npy")))


class _Place:
    """Pieces with their number within their length to their places."""

    def __init__(self, folder: str):
        self.folder = folder

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_in(self.folder)
        wide = np.int64(1) << 48  # no length has more pieces
        keys = plan[:, 0] * wide + plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            n, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, n * wide + number, "right") - 1
            _, begin, each, first, offset = plan[at].T
            k = number - begin
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first + k // each), pa.array(offset + k % each * n)], schema=PACK_ARROW)


def pack(docs: DataFrame, path: str, pattern: str, end: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs (doc_id, text); ids by the
    tokenizer file at `path`, whose pattern is given for its fast form, then the id `end`."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    pieces = written(rows.mapInArrow(_Pieces(path, pattern, end, capacity), PIECE_SPARK), "pack-pieces")
    each = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    out = io.BytesIO()
    np.save(out, Plan(counts, capacity).array())
    folder = new_folder(docs.sparkSession, "pack-plan")
    put_file(folder, "plan.npy", out.getvalue())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = each.select("length", "task", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = pieces.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("number")).alias("number"))
    return numbered.mapInArrow(_Place(folder), PACK_SPARK)
