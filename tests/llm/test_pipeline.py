"""The corpus pipeline by its stages, and the registered queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.mark.parametrize("name", ["op5_sharding", "op7_ngram_jaccard", "op8_secret_scan", "op11_centroids", "op13_merkle_manifest"])
def test_query(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    status, detail = compare(spark, con, name, FOLDER)
    assert status == "OK", detail


def test_every_corpus_query_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, FOLDER)
        assert after.columns == list(corpus_pipeline.COLUMNS), name
        left = spark.createDataFrame(after.collect(), docs.schema)
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    result = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in result) == sorted(ids)
    assert all(r["round_trip"] for r in result) and 0.5 * docs.count() < len(ids) < docs.count()
