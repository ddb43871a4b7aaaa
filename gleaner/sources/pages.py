"""Raw page source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (page_id, url, html) of a data folder."""
    return spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
