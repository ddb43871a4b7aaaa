"""Corpus pipeline: toxicity, near copies, benchmark leaks, secrets, token ids."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import gleaner  # noqa: E402
from gleaner.llm import bpe, decontamination, ngram_join, secret_scan, toxicity  # noqa: E402
from gleaner.llm.queries import tokenizer_path  # noqa: E402
from gleaner.session import ensure_checkpoint_dir  # noqa: E402

# Python workers may run elsewhere and need not have the package installed.
cloudpickle.register_pickle_by_value(gleaner)

#: Columns of documents that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network finds toxic go; it learns from the labels of documents still there."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the one with the smallest id stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS), ngram_join.Join(words=5, percent=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays. n_chars follows the new text."""
    return secret_scan.redact_secrets(docs.select(*COLUMNS), length="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests that show that decoding gives the text again."""
    return bpe.bpe_round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs


#: The toxicity stage is a trained network, which SQL cannot express.
ORACLE_SQL = None
