"""Queries of the corpus operators, each over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontamination, html_extraction, lm_scoring, merkle, neighbours, ngram_join, quality_rules, secret_scan, sharding, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, *tables: str, sql: str | None = None):
    """Register a query over the named tables."""

    def register(fn: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in tables])
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_lm_scoring", "documents")
def op1(documents: DataFrame) -> DataFrame:
    return lm_scoring.score_documents(documents)


@query("op2_html_extraction", "pages")
def op2(pages: DataFrame) -> DataFrame:
    return html_extraction.main_text(pages)


@query("op3_url_filter", "pages")
def op3(pages: DataFrame) -> DataFrame:
    return url_filter.url_filter(pages)


@query("op4_quality_rules", "documents")
def op4(documents: DataFrame) -> DataFrame:
    return quality_rules.quality_rules(documents)


# crc32 by its table of 256 remainders, each from eight shifts; bytes are read from the text's hex digits.
SHARDS_SQL = """
WITH remainders AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
sized AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS BIGINT) AS text_crc32
  FROM documents, remainders),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size) - size AS before, sum(size) OVER () AS total FROM sized),
cut AS (SELECT doc_id, size, text_crc32, CAST((2 * before + size) * 16 // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
""".strip()


@query("op5_sharding", "documents", sql=SHARDS_SQL)
def op5(documents: DataFrame) -> DataFrame:
    return sharding.byte_shards(documents, shards=16)


@query("op6_toxicity", "documents", "labels")
def op6(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.score_toxicity(documents, labels)


@query("op7_ngram_jaccard", "documents", sql=ngram_join.ORACLE)
def op7(documents: DataFrame) -> DataFrame:
    return ngram_join.ngram_components(documents)


@query("op8_secret_scan", "documents", sql=secret_scan.oracle())
def op8(documents: DataFrame) -> DataFrame:
    return secret_scan.secret_digest(documents)


@query("op9_decontamination", "documents", "benchmark")
def op9(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontamination.find_leaks(documents, benchmark)


@query("op10_bpe", "documents")
def op10(documents: DataFrame) -> DataFrame:
    return bpe.bpe_round_trip(documents, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("round_trip"))


@query("op11_centroids", "embeddings", sql=centroids.oracle())
def op11(embeddings: DataFrame) -> DataFrame:
    return centroids.assign_clusters(embeddings)


@query("op12_nearest_neighbours", "embeddings")
def op12(embeddings: DataFrame) -> DataFrame:
    return neighbours.nearest_neighbours(embeddings, every=50)


@query("op13_merkle_manifest", "documents", sql=merkle.oracle())
def op13(documents: DataFrame) -> DataFrame:
    return merkle.merkle_manifest(documents)
