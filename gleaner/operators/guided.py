"""Guided reading: section references, per-section actions, block ranges.

Sections, plan and blocks of a document are arrays of one row (a section index
holds at most ten sections), so these operators need no join of exploded lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.core import let, lits, nonempty
from ..functions.text import plain_heading
from ..schemas import READING_ACTIONS

# Reasons why guided reading is off, in the order of the checks.
GUIDED_REASONS = [
    "缺少系统章节清单",
    "主章节数量不在 2～10 范围内",
    "缺少章节摘要（content_map）",
    "章节摘要引用缺失、重复或未知",
    "章节摘要未完整覆盖全部主章节",
    "缺少章节阅读计划（reading_plan）",
    "章节计划引用缺失、重复或未知",
    "章节计划未完整覆盖全部主章节",
    "章节计划缺少需要压缩的章节（skip/skim）",
    "章节计划缺少需要阅读的章节（read/deep_read）",
]


def guided_flow_reason(section_index: Column, content_map: Column, reading_plan: Column) -> Column:
    """First failing reference check, NULL when guided reading may be used."""

    def refs(items: Column) -> Column:
        return F.transform(items, lambda item: item["section_ref"])

    def check(s: Column) -> Column:
        def invalid(given: Column) -> Column:
            return (
                F.exists(given, lambda r: r.isNull())
                | (F.size(F.array_except(given, s["known"])) > 0)
                | (F.size(F.array_distinct(given)) < F.size(given))
            )

        def incomplete(given: Column) -> Column:
            return F.size(F.array_except(s["known"], given)) > 0

        def empty(given: Column) -> Column:
            return given.isNull() | (F.size(given) == 0)

        n = F.size(s["known"])
        conditions = [
            empty(s["known"]),
            (n < 2) | (n > md.MAX_SECTIONS),
            empty(s["map"]),
            invalid(s["map"]),
            incomplete(s["map"]),
            empty(s["plan"]),
            invalid(s["plan"]),
            incomplete(s["plan"]),
            ~F.arrays_overlap(s["actions"], lits(["skip", "skim"])),
            ~F.arrays_overlap(s["actions"], lits(["read", "deep_read"])),
        ]
        out = F.when(conditions[0], F.lit(GUIDED_REASONS[0]))
        for condition, reason in zip(conditions[1:], GUIDED_REASONS[1:]):
            out = out.when(condition, F.lit(reason))
        return out

    return let(
        F.struct(
            refs(section_index["sections"]).alias("known"),
            refs(content_map).alias("map"),
            refs(reading_plan).alias("plan"),
            F.transform(reading_plan, lambda p: p["action"]).alias("actions"),
        ),
        check,
    )


def guided_available() -> Column:
    """Detail-page condition over the joined content row."""
    reason = guided_flow_reason(
        F.col("section_index"), F.col("content_analysis.content_map"), F.col("personal_evaluation.reading_plan")
    )
    preferred = F.col("preferred_recommendation")
    ready = (
        (F.col("analysis_status") == "completed")
        & F.col("source_hash").eqNullSafe(F.col("current_hash"))
        & F.col("section_index").isNotNull()
        & F.col("content_analysis").isNotNull()
        & F.col("personal_evaluation.recommendation").eqNullSafe(F.lit("selective_read"))
        & (preferred.isNull() | (preferred == "selective_read"))
    )
    return F.coalesce(ready & reason.isNull(), F.lit(False))


def _last_with_ref(items: Column, ref: Column) -> Column:
    # A later item replaces an earlier one with the same reference.
    found = F.filter(items, lambda item: item["section_ref"] == ref)
    return F.try_element_at(found, F.lit(-1))


def guided_sections(rows: DataFrame) -> DataFrame:
    """One row per section: action, reason, summary and body.

    ``rows`` carries doc_id, markdown, section_index, reading_plan, content_map.
    """
    return rows.select(
        "doc_id", "markdown", "reading_plan", "content_map", F.inline("section_index.sections")
    ).select(
        "doc_id",
        "section_ref",
        "title",
        "order",
        F.coalesce(_last_with_ref(F.col("reading_plan"), F.col("section_ref"))["action"], F.lit("read")).alias("action"),
        F.coalesce(_last_with_ref(F.col("reading_plan"), F.col("section_ref"))["reason"], F.lit("")).alias("reason"),
        F.coalesce(_last_with_ref(F.col("content_map"), F.col("section_ref"))["summary"], F.lit("")).alias("summary"),
        md.lines_between(F.col("markdown"), F.col("start_line") + 1, F.col("end_line")).alias("body"),
    )


def action_counts(guided: DataFrame) -> DataFrame:
    return guided.groupBy("doc_id").agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in READING_ACTIONS]
    )


def context_block(markdown: Column, section_index: Column) -> Column:
    """Lines before the first section; empty text without an index."""
    first = F.get(section_index["sections"], F.lit(0))
    return F.coalesce(md.lines_between(markdown, F.lit(0), first["start_line"]), F.lit(""))


def in_range(blocks: Column, start: Column, end: Column) -> Column:
    """Blocks that start in the half-open line range."""
    return F.filter(
        blocks,
        lambda b: b["start_line"].isNotNull() & (b["start_line"] >= start) & (b["start_line"] < end),
    )


def blocks_in_section(docs: DataFrame) -> DataFrame:
    """One row per block and section.  ``docs``: doc_id, section_index, blocks."""
    sections = docs.select("doc_id", "blocks", F.inline("section_index.sections"))
    return sections.select(
        "doc_id", "section_ref", F.inline(in_range(F.col("blocks"), F.col("start_line"), F.col("end_line")))
    )


def join_blocks(blocks: Column) -> Column:
    """Translated text where there is one, else the source, with blank lines between."""
    return F.array_join(
        F.transform(blocks, lambda b: F.coalesce(nonempty(b["translated_markdown"]), b["source_markdown"])),
        "\n\n",
    )


def translated_title(blocks: Column, title: Column, start_line: Column) -> Column:
    """Plain text of the translated heading block that covers the section's first line."""
    covering = F.filter(
        blocks,
        lambda b: (b["kind"] == "heading")
        & (b["start_line"] <= start_line)
        & (start_line < b["end_line"]),
    )
    text = nonempty(F.get(covering, F.lit(0))["translated_markdown"])
    return F.coalesce(plain_heading(text), title)


def translated_titles(docs: DataFrame) -> DataFrame:
    sections = docs.select("doc_id", "blocks", F.inline("section_index.sections"))
    return sections.select(
        "doc_id",
        "section_ref",
        "title",
        translated_title(F.col("blocks"), F.col("title"), F.col("start_line")).alias("translated_title"),
    )


def comparison_view(docs: DataFrame) -> DataFrame:
    """Source and translation side by side, one row per section.

    ``docs``: doc_id, markdown, section_index, reading_plan, blocks,
    translation_status, guided_available.
    """
    ready = F.coalesce(
        (F.col("translation_status") == "completed")
        & (F.size("blocks") > 0)
        & F.forall("blocks", lambda b: b["start_line"].isNotNull() & b["end_line"].isNotNull()),
        F.lit(False),
    )
    sections = docs.withColumn("ready", ready).select(
        "doc_id", "markdown", "reading_plan", "blocks", "ready", "guided_available", F.inline("section_index.sections")
    )
    body_start = F.col("start_line") + 1
    return sections.select(
        "doc_id",
        "section_ref",
        "title",
        F.when(F.col("ready"), translated_title(F.col("blocks"), F.col("title"), F.col("start_line")))
        .otherwise(F.col("title"))
        .alias("translated_title"),
        F.coalesce(_last_with_ref(F.col("reading_plan"), F.col("section_ref"))["action"], F.lit("read")).alias("action"),
        md.lines_between(F.col("markdown"), body_start, F.col("end_line")).alias("body"),
        F.when(F.col("ready"), join_blocks(in_range(F.col("blocks"), body_start, F.col("end_line"))))
        .otherwise(F.lit(""))
        .alias("translated_body"),
        (F.col("guided_available") & F.col("ready")).alias("annotated"),
    )
