"""The text pipeline: STAGES in order, each a function of (spark, docs, sf_dir), written as Parquet between them.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents; rows whose
text is null count as empty. An empty table goes through and gives an empty result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, linededup, mixing, neardup, quality
from keelson.llm.common import folders_made, in_files, parallel, remove_folders, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the base rules and the learned decision list accept."""
    return quality.kept_documents(parallel(docs), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the lines that ten documents or more share out of every text."""
    return linededup.drop_common_lines_in_place(parallel(docs), min_docs=10, min_chars=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, similarity 0.8): the one with the least doc_id, of whole
    rows that repeat the first. Rows are dropped where they stand, so texts aren't shuffled."""
    return neardup.drop_near_duplicates(parallel(docs), width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mixture: sources by the root of their size. All of them stay."""
    return mixing.mix_in_order(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part and row (where the document stands in the order of the mixture: the number of its file, and its row
    there), n_tokens, digests of the ids and of the bytes that they decode to, and how many bytes these are."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = in_files(docs)
    at = docs.metadataColumn("_metadata")
    part = F.regexp_extract(at["file_name"], "part-([0-9]+)", 1).try_cast("int")
    placed = docs.select("doc_id", "text", part.alias("part"), at["row_index"].alias("row"))
    return bpe.bpe_round_trip(placed, ranks, public_tokenizers.PATTERN, beside=("part", "row"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing sources to target weights", mix_sources), ("byte-level BPE encoding and decoding", bpe_tokens)]
#: Learned rules, sketches and token ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again by the next. What a stage has
    left there, and the table before it, are removed once its own table is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with folders_made() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{k + 1}")
        remove_folders([*made[:-1], *before])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
