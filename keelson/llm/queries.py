"""The registered queries of these operators: (spark, sf_dir) to DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, codes, fingerprint, linededup, lm, mixing, neardup, packing, pii, quality, urlfilter, warc, whitening
from keelson.llm.common import parallel, table
from keelson.llm.oracles import ORACLES

#: The rule list that op1 judges by before the mined rules.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(parallel(table(spark, sf_dir, "documents")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(parallel(table(spark, sf_dir, "documents")), RANKS, public_tokenizers.PATTERN)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(parallel(table(spark, sf_dir, "documents")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(parallel(table(spark, sf_dir, "documents")), width=3, percent=85)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_round_trip(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(parallel(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_common_lines(parallel(table(spark, sf_dir, "documents")), min_docs=10, min_chars=1, texts=False)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints_with_next(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(parallel(table(spark, sf_dir, "embeddings")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(parallel(table(spark, sf_dir, "documents")), TOKENIZER, public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mix_sources, op3_pii, op4_bpe, op5_lm_scores, op6_near_dedup, op7_warc, op8_quality_rules, op9_line_dedup, op10_fingerprints, op11_whitening, op12_vector_codes, op13_packing)}
__all__ = ["ORACLES", "QUERIES"]
