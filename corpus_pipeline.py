"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on every row its predecessor
kept. All but the last return the columns of documents. ``run`` writes each stage as Parquet in the
shared folder and reads it again for the next one, so a lost executor
repeats tasks of one stage alone. A new call of ``run`` starts from the first stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import decontam, ngram_join, packing, pii, quality
from sessionlens.llm.shared import table, work_folder

TOKENIZER = "word_bpe_49k.json"
LENGTH = 4096
SHINGLE, PERCENT = 5, 80  # op10's own query has other ones


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed; n_chars follows the text."""
    return quality.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by five-word shingles: the one with the least doc_id."""
    return ngram_join.representatives(docs, n=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; n_chars follows the text."""
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training windows."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), LENGTH)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Tokenizers and alignment are beyond SQL; the tests hold near duplicates against brute
#: force and the other stages against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the pipeline makes of the documents in ``sf_dir``."""
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
