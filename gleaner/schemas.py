"""Data model: enums, ranks, limits and the StructTypes of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: enums of the data model ---------------------------------
SOURCE_TYPES = ["web", "pdf", "youtube", "bilibili", "podcast", "audio", "video"]
DOCUMENT_FORMATS = ["markdown", "transcript"]
QUALITY_LEVELS = ["good", "warning", "poor", "failed"]
CAPTURE_MODES = ["manual", "automatic"]
RECOMMENDATIONS = ["ignore", "summary_enough", "selective_read", "deep_read"]
SIGNAL_LEVELS = ["low", "medium", "high"]
RELEVANCE_LEVELS = ["low", "medium", "high", "very_high"]
NOVELTY_LEVELS = ["low", "medium", "high", "unknown"]
DISCOVERY_TYPES = ["profile_match", "adjacent", "outside_profile_high_value"]
TRIAGE_DECISIONS = ["ignore", "continue"]
READING_ACTIONS = ["skip", "skim", "read", "deep_read"]
DIFFICULTIES = ["introductory", "intermediate", "advanced"]
VERIFICATIONS = ["supported_in_content", "unverified", "opinion"]
STAGES = ["triage", "analyze", "evaluate", "completed"]

# --- fixed values: ranks ----------------------------------------------------
QUALITY_RANK = {"good": 3, "warning": 2, "poor": 1, "failed": 0}
ACCESS_RULES = {"good": "allow", "warning": "warn", "poor": "confirm", "failed": "forbid"}

# --- fixed values: limits ---------------------------------------------------
MIN_CALIBRATION_FEEDBACK = 20
LIST_LIMIT_MAX = 200
BATCH_MAX_BLOCKS = 12
BATCH_MAX_CHARS = 6000
TARGET_LANGUAGE = "zh-CN"

# The version literal a capture envelope must carry.  The vendor prefix is the
# deployment's own; pass another value where captures come from elsewhere.
CAPTURE_SCHEMA_VERSION = "gleaner.capture.v1"


def recommendation_rank(level: Column) -> Column:
    """Position of a recommendation in its order, NULL when it is not a level."""
    position = F.array_position(F.array(*[F.lit(v) for v in RECOMMENDATIONS]), level).cast("int")
    return F.when(position > 0, position - 1)


def quality_rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in QUALITY_RANK.items():
        rank = F.when(level == name, F.lit(value)).otherwise(rank)
    return rank


# --- fixed values: fields of the stored tables and of the data contract ------
CAPTURE_DDL = (
    "schema_version string, capture_id string, "
    "source struct<type: string, url: string, canonical_url: string, title: string, author: string>, "
    "document struct<format: string, text: string, units: array<string>>, "
    "capture struct<mode: string, producer: string, producer_version: string, "
    "quality: struct<level: string, warnings: array<string>>, extraction_engine: string>"
)

TRIAGE_DDL = (
    "relevance string, intrinsic_signal string, novelty_signal string, exploration_value string, "
    "discovery_type string, decision string, reason string, why_outside_profile string"
)

ANALYZE_DDL = (
    "one_sentence_summary string, summary string, "
    "content_profile struct<topics: array<string>, content_type: string, difficulty: string>, "
    "content_map array<struct<section_ref: string, title: string, summary: string>>, "
    "key_points array<string>, "
    "claims array<struct<claim: string, evidence: array<string>, verification: string>>, "
    "thesis string, supporting_evidence array<string>, counterarguments array<string>, "
    "author_stance string, limitations array<string>, unresolved_questions array<string>, "
    "unverified_claims array<string>"
)

EVALUATE_DDL = (
    "relevance string, knowledge_overlap string, known_or_redundant boolean, "
    "novel_information array<string>, exploration_value string, perspective_diversity string, "
    "discovery_type string, recommendation string, recommendation_reason string, "
    "why_outside_profile string, "
    "reading_plan array<struct<section_ref: string, section: string, action: string, reason: string>>"
)

SECTION_DDL = "section_ref string, level int, title string, `order` int, start_line int, end_line int"
BLOCK_DDL = (
    "id string, kind string, source_markdown string, translated_markdown string, "
    "translatable boolean, start_line int, end_line int"
)

# Columns added after the first release; older tables are read with NULLs here.
ADDED_COLUMNS = {
    "feedback": {"preferred_recommendation": "string"},
    "profiles": {"calibration_decisions": "map<string,string>"},
    "jobs": {"immediate_requested_at": "timestamp"},
    "analyses": {"source_hash": "string", "section_index": "string"},
}
