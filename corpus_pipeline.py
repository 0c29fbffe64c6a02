"""A training corpus from ``documents``: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of its input; the last returns
the tokens of each document.  ``run`` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import byte_bpe, jaccard_join, language_id, mixing, secrets
from tonemill.llm.queries import MIX_BLOCK_CHARS, MIX_WEIGHTS
from tonemill.session import durable

#: No SQL: trained models, redaction by entropy and byte-level BPE are tested against brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject; text without a letter is rejected."""
    return language_id.without_rejected(docs, language_id.fit(language_id.learnable(docs)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near equality, the one of the smallest id; a null id is always kept."""
    return jaccard_join.keep_one_per_component(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret masked and their length counted again."""
    found = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mixture."""
    return mixing.in_mixed_order(docs, MIX_WEIGHTS, MIX_BLOCK_CHARS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_and_decode(docs, ranks)
    listed = F.array_join("ids", " ").cast("binary")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"), "ids"
    )


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("secrets", redact),
    ("mixture", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
