"""Export of extracted pages as JSON documents and Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import count_matches, nonempty
from ..functions.markdown import count_tables
from ..functions.quality import content_type
from ..functions.text import safe_filename


def export_json(extractions: DataFrame) -> DataFrame:
    """``name, json``: optional keys are left out, ``adapter`` and ``capturedAt`` stay as nulls."""
    md = F.col("markdown")
    head = F.to_json(
        F.struct(
            F.col("title").alias("title"),
            nonempty(F.col("author")).alias("author"),
            F.col("url").alias("source"),
            nonempty(F.col("published_at")).alias("published_at"),
        )
    )
    kind = content_type(F.floor(count_matches(md, "```") / 2), count_tables(md))
    quality = F.to_json(F.struct(F.col("level").alias("level"), F.col("warnings").alias("warnings")))
    extraction = F.to_json(
        F.struct(
            F.col("engine_id").alias("engine"),
            F.lit(None).cast("string").alias("adapter"),
            nonempty(F.col("captured_at")).alias("capturedAt"),
        ),
        {"ignoreNullFields": "false"},
    )
    text = F.regexp_extract(F.to_json(F.struct(md.alias("markdown"))), r"\A\{([\s\S]*)\}\z", 1)
    document = F.concat(
        F.lit('{"metadata":'), head, F.lit(","), text, F.lit(',"contentType":"'), kind,
        F.lit('","quality":'), quality, F.lit(',"extraction":'), extraction, F.lit("}"),
    )
    return extractions.select(
        F.concat(safe_filename(F.col("title")), F.lit(".json")).alias("name"), document.alias("json")
    )


def export_markdown(extractions: DataFrame) -> DataFrame:
    """``name, text``: the Markdown with its front matter under a safe file name."""
    return extractions.select(
        F.concat(safe_filename(F.col("title")), F.lit(".md")).alias("name"), F.col("markdown").alias("text")
    )


def write_exports(exports: DataFrame, path: str) -> None:
    """One JSON line per export; file names stay a column, so no task writes tiny files."""
    exports.write.mode("overwrite").json(path)
