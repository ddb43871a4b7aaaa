"""Capture envelopes: reading, building and storing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import nonempty
from ..schemas import CAPTURE_DDL, CAPTURE_SCHEMA_VERSION

_CORRUPT = "_corrupt_record"


def parse_captures(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON lines with the fixed schema.

    ``envelope`` is NULL where the line is no JSON object; ``corrupt`` then
    holds the line, so that it can be set aside instead of failing the job.
    """
    parsed = F.from_json(
        F.col(column), f"{CAPTURE_DDL}, {_CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )
    bad = F.col("_parsed").isNull() | F.col(f"_parsed.{_CORRUPT}").isNotNull()
    fields = ["schema_version", "capture_id", "source", "document", "capture"]
    envelope = F.struct(*[F.col(f"_parsed.{f}").alias(f) for f in fields])
    return (
        lines.withColumn("_parsed", parsed)
        .withColumn("envelope", F.when(~bad, envelope))
        .withColumn("corrupt", F.when(bad, F.col(column)))
        .drop("_parsed", column)
    )


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture files (one JSON envelope per line) with a quarantine column."""
    return parse_captures(spark.read.text(path))


def flatten_captures(parsed: DataFrame) -> DataFrame:
    """Envelope → the flat columns the content operators use."""
    e = F.col("envelope")
    return parsed.filter(e.isNotNull()).select(
        e["capture_id"].alias("capture_id"),
        e["source"]["type"].alias("source_type"),
        e["source"]["url"].alias("source_url"),
        e["source"]["canonical_url"].alias("canonical_url"),
        e["source"]["title"].alias("title"),
        e["source"]["author"].alias("author"),
        e["document"]["text"].alias("markdown"),
        F.coalesce(e["capture"]["mode"], F.lit("manual")).alias("capture_mode"),
        e["capture"]["quality"]["level"].alias("capture_quality"),
        F.to_json(e).alias("payload"),
        *[c for c in parsed.columns if c not in ("envelope", "corrupt")],
    )


def capture_extractions(extractions: DataFrame) -> DataFrame:
    """Capture lines (value, captured_at) of the extraction rows that have a text.

    The capture id follows from the page's address and the time of the capture, so
    a job that runs again captures nothing twice. A capture keeps the time of its extraction.
    """
    rows = extractions.filter("ok")
    envelope = build_capture(
        F.sha2(F.concat_ws("|", "url", "captured_at"), 256).alias("capture_id"), F.col("url"), F.substring("title", 1, 1000), F.col("author"),
        F.col("markdown"), F.col("level"), F.col("warnings"), F.col("engine_id"),
    )
    return rows.select("page_id", envelope.alias("value"), F.col("captured_at").cast("timestamp").alias("captured_at"))


def build_capture(
    capture_id: Column, url: Column, title: Column, author: Column, markdown: Column, level: Column,
    warnings: Column, engine: Column, producer: str = "gleaner-web", producer_version: str = "1.0.0",
) -> Column:
    """Envelope of an extracted page as JSON; an empty author is left out."""
    envelope = F.struct(
        F.lit(CAPTURE_SCHEMA_VERSION).alias("schema_version"),
        capture_id.alias("capture_id"),
        F.struct(
            F.lit("web").alias("type"), url.alias("url"), title.alias("title"),
            nonempty(author).alias("author"),
        ).alias("source"),
        F.struct(
            F.lit("markdown").alias("format"), markdown.alias("text"),
            F.array().cast("array<string>").alias("units"),
        ).alias("document"),
        F.struct(
            F.lit("manual").alias("mode"),
            F.lit(producer).alias("producer"),
            F.lit(producer_version).alias("producer_version"),
            F.struct(level.alias("level"), warnings.alias("warnings")).alias("quality"),
            engine.alias("extraction_engine"),
        ).alias("capture"),
    )
    return F.to_json(envelope)
