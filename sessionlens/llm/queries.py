"""The operators applied to whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import (
    decontam, licenses, lm, ngram_join, oracles, packing, pii, prefix_trie, pu_quality, quality,
    sharding, spelling, urllist, warc,
)
from sessionlens.llm.shared import table

SHARDS = 40
TOKENIZER = "word_bpe_49k.json"


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return rows.withColumn("law", F.lit("key")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.recognise(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return lm.score(table(spark, sf_dir, "documents"), held)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urllist.judge(urllist.derived_captures(pages), urllist.derived_history(pages))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return pu_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_jump_shards": (op1_jump_shards, None),
    "op2_license_sentences": (op2_license_sentences, oracles.LICENSES),
    "op3_personal_data": (op3_personal_data, None),
    "op4_warc": (op4_warc, None),
    "op5_language_model": (op5_language_model, None),
    "op6_decontamination": (op6_decontamination, None),
    "op7_line_quality": (op7_line_quality, oracles.QUALITY),
    "op8_url_lists": (op8_url_lists, oracles.URL_LISTS),
    "op9_packing": (op9_packing, None),
    "op10_ngram_join": (op10_ngram_join, None),
    "op11_prefix_trie": (op11_prefix_trie, oracles.PREFIX_TRIE),
    "op12_pu_quality": (op12_pu_quality, None),
    "op13_spelling_variants": (op13_spelling_variants, oracles.SPELLING),
}
