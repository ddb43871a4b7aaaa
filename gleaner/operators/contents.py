"""Captures and contents: contract, identity, deduplication, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import nonempty
from ..functions.quality import access_rule
from ..functions.text import source_hash
from ..functions.urls import normalize_url
from ..schemas import (
    CAPTURE_MODES, CAPTURE_SCHEMA_VERSION, DOCUMENT_FORMATS, QUALITY_LEVELS, SOURCE_TYPES,
)
from .keys import latest_per

_HTTP = r"(?i)\Ahttps?://[^/?#\s]+"


def capture_violations(e: Column, version: str = CAPTURE_SCHEMA_VERSION) -> Column:
    """Broken contract rules of an envelope, in field order."""

    def rule(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    source, document, capture = e["source"], e["document"], e["capture"]
    optional_url = source["canonical_url"]
    return F.array_compact(
        F.array(
            rule("schema_version", e["schema_version"] == version),
            rule("capture_id", F.length(e["capture_id"]).between(8, 64)),
            rule("source.type", source["type"].isin(SOURCE_TYPES)),
            rule("source.url", source["url"].rlike(_HTTP)),
            rule("source.canonical_url", optional_url.isNull() | optional_url.rlike(_HTTP)),
            rule("source.title", F.length(source["title"]).between(1, 1000)),
            rule("source.author", source["author"].isNull() | (F.length(source["author"]) <= 500)),
            rule("document.format", document["format"].isin(DOCUMENT_FORMATS)),
            rule("document.text", F.length(document["text"]) >= 1),
            rule("capture.mode", F.coalesce(capture["mode"], F.lit("manual")).isin(CAPTURE_MODES)),
            rule("capture.producer", capture["producer"].isNotNull()),
            rule("capture.producer_version", capture["producer_version"].isNotNull()),
            rule("capture.quality.level", capture["quality"]["level"].isin(QUALITY_LEVELS)),
            rule("capture.extraction_engine", capture["extraction_engine"].isNotNull()),
        )
    )


def validate_capture(parsed: DataFrame) -> DataFrame:
    """Adds ``violations``; a line that is no JSON object violates ``envelope``."""
    return parsed.withColumn(
        "violations",
        F.when(F.col("envelope").isNull(), F.array(F.lit("envelope"))).otherwise(capture_violations(F.col("envelope"))),
    )


def access_gate(contents: DataFrame) -> DataFrame:
    return contents.withColumn("access", access_rule(F.col("capture_quality")))


def identity_url() -> Column:
    return normalize_url(F.coalesce(nonempty(F.col("canonical_url")), F.col("source_url")))


def dedupe_contents(contents: DataFrame) -> DataFrame:
    """Newest row per (source type, identity URL); the row kept stores that URL."""
    keyed = contents.withColumn("canonical_url", identity_url())
    return latest_per(keyed, ["source_type", "canonical_url"], [F.col("created_at").desc(), F.col("content_id")])


def match_existing(captures: DataFrame, contents: DataFrame) -> DataFrame:
    """Adds the content a capture belongs to: by capture id first, then by URL.

    Two equi joins instead of one join on an OR condition.  ``captures`` carry
    the normalized ``canonical_url``; only key columns of ``contents`` are read.
    Each identity is one row before it is joined, the newest content, so that
    contents stored twice never multiply a capture.
    """
    if "created_at" in contents.columns:
        order = F.struct(-F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))), "content_id")
        newest = F.min_by("content_id", order)
    else:
        newest = F.min("content_id")
    by_id = contents.filter("capture_id IS NOT NULL").groupBy("capture_id").agg(newest.alias("id_match"))
    by_url = contents.filter("canonical_url IS NOT NULL").groupBy("source_type", "canonical_url").agg(newest.alias("url_match"))
    return (
        captures.join(by_id, "capture_id", "left")
        .join(by_url, ["source_type", "canonical_url"], "left")
        .withColumn("matched_content_id", F.coalesce("id_match", "url_match"))
        .withColumn(
            "match_kind",
            F.when(F.col("id_match").isNotNull(), "capture_id").when(F.col("url_match").isNotNull(), "url").otherwise("new"),
        )
        .drop("id_match", "url_match")
    )


def new_content_id(source_type: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", source_type, url), 256)


_LATEST = ["source_type", "source_url", "canonical_url", "title", "author", "markdown", "capture_quality"]


def latest_columns(*tables: DataFrame) -> list[str]:
    """What the last capture of a page supplies: also the whole envelope where one of the tables keeps it."""
    return [*_LATEST, *["payload"] * any("payload" in t.columns for t in tables)]


def with_payload(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("payload", F.lit(None).cast("string")) if "payload" in columns and "payload" not in df.columns else df


def resolve_captures(captures: DataFrame, contents: DataFrame) -> DataFrame:
    """Collapse a batch of captures to one row per content.

    Replays of a capture id, then captures of one page, collapse by aggregates
    with map-side combination, so a page captured very often stays cheap.  The
    last capture supplies the text, the first acceptable one the identity.
    Captures of one moment are ordered by their column ``arrival``, if there is
    one, and by a hash of what they say, so that the result never depends on the run.
    """
    latest = latest_columns(captures, contents)
    accepted = F.col("capture_quality") != "failed"
    keyed = with_payload(captures, latest).withColumn("canonical_url", identity_url())
    arrival = F.col("arrival") if "arrival" in captures.columns else F.lit("")
    keyed = keyed.withColumn("arrival", F.struct(arrival.alias("order"), F.xxhash64(*latest).alias("tie")))
    position = F.struct("captured_at", "arrival")
    per_id = keyed.groupBy("capture_id").agg(
        F.max_by(F.struct(*latest, "captured_at", "arrival"), position).alias("last"),
        F.min_by(
            F.when(accepted, F.struct("capture_id", "capture_mode", "captured_at", "arrival")),
            F.when(accepted, position),
        ).alias("first"),
    )
    flat = per_id.select(
        "capture_id", "first", F.col("last").alias("latest"),
        F.col("last.source_type").alias("source_type"), F.col("last.canonical_url").alias("canonical_url"),
    )
    matched = match_existing(flat, contents)
    content_id = F.coalesce("matched_content_id", new_content_id(F.col("source_type"), F.col("canonical_url")))
    first_at = F.struct(F.col("first.captured_at"), F.col("first.arrival.order"), F.col("first.capture_id"))
    return (
        matched.withColumn("content_id", content_id)
        .groupBy("content_id")
        .agg(
            F.max_by("latest", F.struct(F.col("latest.captured_at"), F.col("latest.arrival.order"), F.col("capture_id"))).alias("latest"),
            F.min_by("first", F.when(F.col("first").isNotNull(), first_at)).alias("first"),
            F.bool_or(F.col("matched_content_id").isNotNull()).alias("exists"),
        )
        # A page that was never extracted successfully does not become a content.
        .filter(F.col("exists") | F.col("first").isNotNull())
    )


def upsert_captures(captures: DataFrame, contents: DataFrame) -> dict[str, DataFrame]:
    """Merge a batch into the contents.

    Returns the new snapshot, and the contents, analyses and jobs to append for
    captures that are new.  The envelope of the last capture (``payload``) replaces the one before.  Existing contents keep id, capture id, mode and
    creation time; a failed re-capture overwrites too, as only new ones are refused.
    """
    resolved = resolve_captures(captures, contents)
    updates = resolved.filter("exists").select("content_id", F.col("latest").alias("u"))
    latest = latest_columns(captures, contents)
    contents = with_payload(contents, latest)
    columns = ["content_id", "capture_id", *latest, "capture_mode", "created_at", "updated_at"]
    kept = contents.join(updates, "content_id", "left")
    changed = F.col("u").isNotNull()
    updated = kept.select(
        "content_id",
        "capture_id",
        *[F.when(changed, F.col(f"u.{c}")).otherwise(contents[c]).alias(c) for c in latest],
        "capture_mode",
        "created_at",
        F.when(changed, F.col("u.captured_at")).otherwise(contents["updated_at"]).alias("updated_at"),
    )
    new = resolved.filter(~F.col("exists")).select(
        "content_id",
        F.col("first.capture_id").alias("capture_id"),
        *[F.col(f"latest.{c}").alias(c) for c in latest],
        F.col("first.capture_mode").alias("capture_mode"),
        F.col("first.captured_at").alias("created_at"),
        F.col("latest.captured_at").alias("updated_at"),
    )
    analyses, jobs = opening_work(new)
    return {
        "contents": updated.select(*columns).unionByName(new.select(*columns)),
        "new_contents": new.select(*columns),
        "new_analyses": analyses,
        "new_jobs": jobs,
    }


def opening_work(new_contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The analysis and the job that every new content starts with."""
    analysis_id = F.sha2(F.concat(F.lit("analysis|"), F.col("content_id")), 256)
    analyses = new_contents.select(
        analysis_id.alias("analysis_id"), "content_id", F.lit("pending").alias("status"), "created_at"
    )
    jobs = analyses.select(
        F.sha2(F.concat(F.lit("job|"), F.col("analysis_id")), 256).alias("job_id"),
        "analysis_id", F.lit("triage").alias("stage"), F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), F.lit(None).cast("timestamp").alias("immediate_requested_at"), "created_at",
    )
    return analyses, jobs


def integrity_report(contents: DataFrame, analyses: DataFrame, jobs: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """Broken references as ``kind, id``."""
    parts = [
        contents.join(analyses.select("content_id"), "content_id", "left_anti").select(
            F.lit("content_without_analysis").alias("kind"), F.col("content_id").alias("id")
        ),
        analyses.join(jobs.select("analysis_id"), "analysis_id", "left_anti").select(
            F.lit("analysis_without_job").alias("kind"), F.col("analysis_id").alias("id")
        ),
        analyses.join(contents.select("content_id"), "content_id", "left_anti").select(
            F.lit("analysis_without_content").alias("kind"), F.col("analysis_id").alias("id")
        ),
    ]
    if feedback is not None:
        parts.append(
            feedback.join(analyses.select("analysis_id"), "analysis_id", "left_anti").select(
                F.lit("feedback_without_analysis").alias("kind"), F.col("analysis_id").alias("id")
            )
        )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def cascade_prune(kept: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Analyses, jobs and translations of the kept contents only."""
    ids = kept.select("content_id")
    analyses = tables["analyses"].join(ids, "content_id", "left_semi")
    out = {"analyses": analyses}
    if "jobs" in tables:
        out["jobs"] = tables["jobs"].join(analyses.select("analysis_id"), "analysis_id", "left_semi")
    if "translations" in tables:
        out["translations"] = tables["translations"].join(ids, "content_id", "left_semi")
    return out


OUTPUTS = ["triage", "content_analysis", "personal_evaluation", "completed_at"]


def stale_analyses(contents: DataFrame, analyses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Analyses against the current text of their content.

    A changed text hides the section index, clears the stage outputs and sends
    open work back to triage.
    """
    current = contents.select("content_id", source_hash(F.col("markdown")).alias("current_hash"))
    rows = analyses.join(current, "content_id").join(
        jobs.select("analysis_id", "stage", F.col("status").alias("job_status")), "analysis_id"
    )
    stale = F.col("source_hash").isNotNull() & (F.col("source_hash") != F.col("current_hash"))
    restart = stale & F.col("status").isin("pending", "running")
    rows = rows.withColumn("stale", stale)
    cleared = {c: F.when(~restart, F.col(c)) for c in OUTPUTS if c in rows.columns}
    return rows.withColumns(
        {
            **cleared,
            "stage": F.when(restart, F.lit("triage")).otherwise(F.col("stage")),
            "index_visible": F.col("source_hash").eqNullSafe(F.col("current_hash")),
        }
    )


def attach_profile(contents: DataFrame, profiles: DataFrame) -> DataFrame:
    """Reader profile for the model stages; a cautious default without questionnaire.

    ``contents`` carries user_id.  Profiles are one row per reader and join by
    key, so their number may grow; Spark broadcasts them only while small.
    """
    done = profiles.filter(F.col("questionnaire_completed_at").isNotNull())
    topics = F.transform(
        F.filter("known_topics", lambda k: (F.coalesce(k["topic"], F.lit("")) != "") & (F.coalesce(k["level"], F.lit("")) != "")),
        lambda k: F.concat(k["topic"], F.lit("（"), k["level"], F.lit("）")),
    )
    ready = done.select(
        "user_id", "focus_topics", topics.alias("known_topics"), "reading_goals", "preferred_depth",
        "time_budget_minutes", "exploration_level",
    )
    empty = F.array().cast("array<string>")
    defaults = {
        "focus_topics": empty, "known_topics": empty, "reading_goals": empty,
        "preferred_depth": F.lit("balanced"), "time_budget_minutes": F.lit(20), "exploration_level": F.lit("medium"),
    }
    return contents.join(ready, "user_id", "left").withColumns(
        {c: F.coalesce(F.col(c), d) for c, d in defaults.items()}
    )
