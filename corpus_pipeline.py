"""From raw documents to token ids: quality, near duplicates, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontam, neardup, pii, quality, shared
from brindle.llm.queries import DEMO_KEY, load


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores 0.3 or more; learns from the labels of the documents that are there and not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = quality.quality(docs, load(spark, sf_dir, "labels"), keep=docs.columns, held_out=held_out, names=("__score", "__predicted"))
    return scored.filter("__predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that is 80 per cent alike in five-word shingles, that of smallest id. Rows are told
    apart by themselves, not by their ids, which may be null or repeat."""
    return neardup.unique_rows(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    return decontam.decontaminated(docs, load(spark, sf_dir, "benchmark"), percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; n_chars follows the text."""
    return pii.pseudonymised(docs, DEMO_KEY, keep=docs.columns, names=("__n", "__kinds")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes the ids again."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_level_bpe),
]

#: Not expressible: a trained classifier and byte-level BPE. The test compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
