"""Byte-level BPE (operator 4) by the tiktoken library with a local rank file.

The pattern is matched on whole texts, or on the parts of a long one split where the pattern always has a border: a
character that isn't white space before one that is. So the ids never depend on the split. Null text counts as empty
(no ids). Rows that repeat are each encoded. An empty table gives an empty result. Other columns of docs are not looked
at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from keelson.llm.common import text_of, tidy

#: Texts of more characters are split before they are matched.
LONG = 1 << 16
BORDER = regex.compile(r"(?<=\S)(?=\s)")
SPACE_RUN = regex.compile(r"\s+")


@lru_cache(4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 token and rank), without special tokens."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=pattern, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = LONG) -> Iterator[tuple[str, bool]]:
    """Parts of text in order; True for a run of white space that is one match by itself.

    A part ends before white space that follows something else. White space of over size characters is taken out of
    its part, for the pattern's look-ahead would walk back through it: all but its last character are one match, or
    all of it at the end of the text."""
    at, n = 0, len(text)
    while n - at > size:
        m = BORDER.search(text, at + size)
        long_space = SPACE_RUN.match(text, at) if text[at].isspace() else None
        if long_space and long_space.end() - at > size:
            end = long_space.end() if long_space.end() == n else long_space.end() - 1
            yield text[at:end], True
            at = end
            continue
        cut = m.start() if m else n
        space = next((s for s in SPACE_RUN.finditer(text, at, cut) if s.end() - s.start() > size), None)
        if space and space.start() > at:
            cut = space.start()
        yield text[at:cut], False
        at = cut
    if at < n:
        yield text[at:], False


def encode(enc: tiktoken.Encoding, text: str, size: int = LONG) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part, alone in parts(text, size):
        out += enc._encode_single_piece(part) if alone else enc.encode_ordinary(part)
    return out


class _Encode:
    def __init__(self, ranks: str, pattern: str, schema: pa.Schema, ids: bool):
        self.ranks, self.pattern, self.schema, self.ids = ranks, pattern, schema, ids

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(self.ranks, self.pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for text in batch.column(1).to_pylist():
                    ids = encode(enc, text)
                    back = enc.decode_bytes(ids)
                    rows.append((len(ids), hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), *([ids] if self.ids else [])))
                cols = zip(*rows) if rows else [()] * (4 + self.ids)
                arrays = [batch.column(0), *batch.columns[2:], *(pa.array(c, f.type) for c, f in zip(cols, list(self.schema)[batch.num_columns - 1 :]))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, self.schema)], schema=self.schema)


def bpe_round_trip(docs: DataFrame, ranks: str, pattern: str, ids: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of docs named in `beside`, n_tokens, ids_sha256, decoded_sha256, n_bytes and, if asked for, ids,
    for each row of docs (doc_id, text). An empty table gives an empty result; columns not named are not looked at."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), *(docs[c] for c in beside))
    made = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("n_bytes", LongType()), *([StructField("ids", ArrayType(LongType()))] if ids else [])]
    schema = StructType([rows.schema["doc_id"], *(rows.schema[c] for c in beside), *made])
    return rows.mapInArrow(_Encode(ranks, pattern, to_arrow_schema(schema), ids), schema)


class _Decode:
    def __init__(self, ranks: str, pattern: str):
        self.ranks, self.pattern = ranks, pattern

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(self.ranks, self.pattern)
        for batch in batches:
            back = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])


def bpe_decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and decoded, the raw bytes of ids; null ids give no bytes. Bytes need not be whole characters."""
    return encoded.select("doc_id", "ids").mapInArrow(_Decode(ranks, pattern), "doc_id bigint, decoded binary")
