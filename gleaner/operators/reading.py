"""Read models: inbox, detail page, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import nonempty
from ..functions.text import detect_language, source_hash
from ..schemas import LIST_LIMIT_MAX, RECOMMENDATIONS, TARGET_LANGUAGE
from .guided import guided_available
from .keys import latest_per


def clamp_limit(limit: int) -> int:
    return max(1, min(limit, LIST_LIMIT_MAX))


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """Newest analysis of every content; the id breaks ties."""
    return latest_per(analyses, ["content_id"], [F.col("created_at").desc(), F.col("analysis_id")])


def ai_recommendation(evaluation: Column, triage: Column) -> Column:
    return F.coalesce(
        nonempty(evaluation["recommendation"]), F.when(triage["decision"] == "ignore", F.lit("ignore"))
    )


def content_summary(joined: DataFrame) -> DataFrame:
    """Recommendation, correction and discovery type of joined content rows."""
    ai = ai_recommendation(F.col("personal_evaluation"), F.col("triage"))
    return (
        joined.withColumn("ai_recommendation", ai)
        .withColumn("user_recommendation", nonempty(F.col("preferred_recommendation")))
        .withColumn("recommendation", F.coalesce("user_recommendation", "ai_recommendation"))
        .withColumn(
            "discovery_type",
            F.coalesce(nonempty(F.col("personal_evaluation.discovery_type")), F.col("triage.discovery_type")),
        )
        .withColumn("one_sentence_summary", F.col("content_analysis.one_sentence_summary"))
    )


_ANALYSIS_COLUMNS = [
    "analysis_id", "content_id", "status", "triage", "content_analysis", "personal_evaluation",
]


def joined_contents(contents: DataFrame, analyses: DataFrame, jobs: DataFrame, feedback: DataFrame) -> DataFrame:
    """contents ⋈ latest analysis ⋈ job ⟕ feedback, without the article text."""
    latest = latest_analysis(analyses.select(*_ANALYSIS_COLUMNS, "created_at")).drop("created_at")
    return (
        contents.select(
            "content_id", "title", "source_url", "source_type", "capture_quality", "created_at"
        )
        .join(latest.withColumnRenamed("status", "analysis_status"), "content_id")
        .join(
            jobs.select(
                "analysis_id", "stage", F.col("status").alias("job_status"), "immediate_requested_at"
            ),
            "analysis_id",
        )
        .join(feedback.select("analysis_id", "preferred_recommendation"), "analysis_id", "left")
    )


def inbox(
    contents: DataFrame, analyses: DataFrame, jobs: DataFrame, feedback: DataFrame, limit: int = 50
) -> DataFrame:
    """Newest contents with the state of their latest analysis."""
    rows = content_summary(joined_contents(contents, analyses, jobs, feedback))
    return (
        rows.select(
            "content_id", "title", "source_url", "source_type", "capture_quality", "created_at",
            "analysis_id", "analysis_status", "one_sentence_summary", "recommendation",
            "ai_recommendation", "user_recommendation", "discovery_type", "stage",
        )
        .orderBy(F.col("created_at").desc(), "content_id")
        .limit(clamp_limit(limit))
    )


def inbox_filter(rows: DataFrame, name: str) -> DataFrame:
    """``all``, a recommendation level, or ``explore``."""
    if name == "all":
        return rows
    if name == "explore":
        return rows.filter(F.col("discovery_type") == "outside_profile_high_value")
    if name not in RECOMMENDATIONS:
        raise ValueError(f"unknown inbox filter: {name}")
    return rows.filter(F.col("recommendation") == name)


def recent_contents(contents: DataFrame, limit: int = 50) -> DataFrame:
    return contents.orderBy(F.col("created_at").desc(), "content_id").limit(clamp_limit(limit))


def content_detail(
    contents: DataFrame, analyses: DataFrame, jobs: DataFrame, feedback: DataFrame, translations: DataFrame
) -> DataFrame:
    """One detail row per content.

    A translation shows only if it was made from the current text, a section
    index only if its analysis was.  ``translations`` holds one row per content
    and language.
    """
    current = contents.withColumn("current_hash", source_hash(F.col("markdown")))
    stored = translations.filter(F.col("target_language") == TARGET_LANGUAGE).select(
        "content_id",
        F.col("source_hash").alias("current_hash"),
        F.col("status").alias("translation_status"),
        F.col("blocks").alias("translation_blocks"),
    )
    rows = (
        current.join(latest_analysis(analyses).drop("created_at").withColumnRenamed("status", "analysis_status"), "content_id")
        .join(jobs.select("analysis_id", "stage"), "analysis_id")
        .join(feedback.select("analysis_id", "preferred_recommendation"), "analysis_id", "left")
        .join(stored, ["content_id", "current_hash"], "left")
    )
    fresh = F.col("source_hash") == F.col("current_hash")
    return (
        content_summary(rows)
        .withColumn("source_language", detect_language(F.col("markdown")))
        .withColumn("guided_flow_available", guided_available())
        .withColumn("section_index", F.when(fresh, F.col("section_index")))
    )
