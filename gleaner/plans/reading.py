"""Queries: inbox, detail page and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import source_hash
from ..operators import feedback as fb
from ..operators import reading as rd
from .inputs import Inputs, query, stamp

_PLAN_DDL = "array<struct<section_ref: string, section: string, action: string, reason: string>>"
_MAP_DDL = "array<struct<section_ref: string, title: string, summary: string>>"


def analyses(t: Inputs) -> DataFrame:
    """The stored shape of an analysis: nested stage outputs."""
    rec, decision, discovery = F.col("evaluation_recommendation"), F.col("triage_decision"), F.col("discovery_type")
    return t.v_analyses.select(
        "analysis_id",
        "content_id",
        "status",
        F.when(decision.isNotNull(), F.struct(decision.alias("decision"), discovery.alias("discovery_type"))).alias("triage"),
        F.when(
            rec.isNotNull(),
            F.struct(
                rec.alias("recommendation"),
                discovery.alias("discovery_type"),
                F.lit(None).cast(_PLAN_DDL).alias("reading_plan"),
            ),
        ).alias("personal_evaluation"),
        F.struct(
            F.concat(F.lit("summary of "), F.col("content_id")).alias("one_sentence_summary"),
            F.lit(None).cast(_MAP_DDL).alias("content_map"),
        ).alias("content_analysis"),
        "created_at",
    )


def inbox_rows(t: Inputs, limit: int = 50) -> DataFrame:
    feedback = fb.feedback_fold(t.v_feedback_events, t.v_analyses)
    return rd.inbox(t.v_contents, analyses(t), t.v_jobs, feedback, limit)


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "content_id", "title", "source_url", "capture_quality", stamp(F.col("created_at")).alias("created"),
        "analysis_id", "analysis_status", "one_sentence_summary", "recommendation", "ai_recommendation",
        "user_recommendation", "discovery_type", "stage",
    )


_SUMMARY = """SELECT c.content_id, c.title, c.source_url, c.capture_quality, c.created_at, a.analysis_id, a.status AS analysis_status,
       'summary of ' || c.content_id AS one_sentence_summary, coalesce(f.pref, a.ai) AS recommendation, a.ai AS ai_recommendation, f.pref AS user_recommendation,
       CASE WHEN a.evaluation_recommendation IS NOT NULL OR a.triage_decision IS NOT NULL THEN a.discovery_type END AS discovery_type, j.stage
FROM v_contents c
JOIN (SELECT *, coalesce(evaluation_recommendation, CASE WHEN triage_decision = 'ignore' THEN 'ignore' END) AS ai FROM o_latest) a USING (content_id)
JOIN v_jobs j ON j.analysis_id = a.analysis_id
LEFT JOIN (SELECT * FROM o_feedback WHERE analysis_id IN (SELECT analysis_id FROM v_analyses WHERE status = 'completed')) f ON f.analysis_id = a.analysis_id"""
_SHOWN = f"SELECT * EXCLUDE (created_at), strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM ({_SUMMARY})"


@query("inbox", f"{_SHOWN} ORDER BY created DESC, content_id LIMIT 50")
def _(t):
    return shown(inbox_rows(t))


@query("content_summary", _SHOWN)
def _(t):
    feedback = fb.feedback_fold(t.v_feedback_events, t.v_analyses)
    return shown(rd.content_summary(rd.joined_contents(t.v_contents, analyses(t), t.v_jobs, feedback)))


@query(
    "inbox_filter",
    f"""SELECT 'explore' AS filter, content_id FROM ({_SHOWN}) WHERE discovery_type = 'outside_profile_high_value'
        UNION ALL SELECT 'selective_read', content_id FROM ({_SHOWN}) WHERE recommendation = 'selective_read'
        UNION ALL SELECT 'all', content_id FROM ({_SHOWN})""",
)
def _(t):
    feedback = fb.feedback_fold(t.v_feedback_events, t.v_analyses)
    rows = rd.content_summary(rd.joined_contents(t.v_contents, analyses(t), t.v_jobs, feedback))
    parts = [
        rd.inbox_filter(rows, name).select(F.lit(name).alias("filter"), "content_id")
        for name in ("explore", "selective_read", "all")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "latest_analysis",
    "SELECT content_id, analysis_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM o_latest",
)
def _(t):
    return rd.latest_analysis(t.v_analyses).select("content_id", "analysis_id", "status", stamp(F.col("created_at")).alias("created"))


@query(
    "recent_contents",
    "SELECT content_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM v_contents ORDER BY created_at DESC, content_id LIMIT 200",
)
def _(t):
    rows = rd.recent_contents(t.v_contents.select("content_id", "created_at"), 500)
    return rows.select("content_id", stamp(F.col("created_at")).alias("created"))


def article_contents(t: Inputs) -> DataFrame:
    return t.v_articles.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("content_id"), "title", "markdown", "doc_id"
    )


def article_plans(t: Inputs) -> DataFrame:
    """Articles with a section index, a content map and a reading plan for it.

    Some plans miss a section, repeat one, or never skip, so that every
    reference check has rows to find.
    """
    index = md.section_index(F.col("markdown"), F.col("title"))
    rows = t.v_articles.withColumn("section_index", index)
    n = F.col("doc_id")
    actions = F.array(*[F.lit(a) for a in ("skip", "read", "skim", "deep_read")])

    def plan_item(s):
        action = F.when(n % 7 == 1, F.lit("read")).when(n % 7 == 2, F.lit("skip")).otherwise(
            F.element_at(actions, (s["order"] % 4 + 1).cast("int"))
        )
        ref = F.when((n % 7 == 3) & (s["order"] == 2), F.lit("sec-001")).when(
            (n % 7 == 4) & (s["order"] == 1), F.lit("sec-099")
        ).otherwise(s["section_ref"])
        return F.struct(ref.alias("section_ref"), s["title"].alias("section"), action.alias("action"),
                        F.concat(F.lit("because "), s["title"]).alias("reason"))

    def map_item(s):
        return F.struct(s["section_ref"].alias("section_ref"), s["title"].alias("title"),
                        F.concat(F.lit("about "), s["title"]).alias("summary"))

    sections = F.col("section_index.sections")
    kept = F.filter(sections, lambda s: ~((n % 7 == 5) & (s["order"] == 2)))
    mapped = F.filter(sections, lambda s: ~((n % 7 == 6) & (s["order"] == 1)))
    return rows.withColumn("reading_plan", F.transform(kept, plan_item)).withColumn(
        "content_map", F.transform(mapped, map_item)
    )


def article_details(t: Inputs) -> DataFrame:
    """Detail rows of the articles: one completed analysis each, some made from older text."""
    rows = article_plans(t)
    n = F.col("doc_id")
    contents = rows.select(
        F.concat(F.lit("d"), n).alias("content_id"), "title", F.lit("web").alias("source_type"),
        F.lit("good").alias("capture_quality"), F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("timestamp").alias("created_at"), "markdown",
    )
    current = source_hash(F.col("markdown"))
    analysed = rows.select(
        F.concat(F.lit("x"), n).alias("analysis_id"), F.concat(F.lit("d"), n).alias("content_id"),
        F.when(n % 11 == 0, "failed").otherwise("completed").alias("status"),
        F.lit(None).cast("struct<decision: string, discovery_type: string>").alias("triage"),
        F.struct(F.lit("s").alias("one_sentence_summary"), F.col("content_map")).alias("content_analysis"),
        F.struct(
            F.when(n % 5 == 0, "deep_read").otherwise("selective_read").alias("recommendation"),
            F.lit("adjacent").alias("discovery_type"),
            F.col("reading_plan"),
        ).alias("personal_evaluation"),
        F.when(n % 6 == 0, "old").otherwise(current).alias("source_hash"),
        "section_index",
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    jobs = rows.select(F.concat(F.lit("x"), n).alias("analysis_id"), F.lit("completed").alias("stage"))
    feedback = rows.select(
        F.concat(F.lit("x"), n).alias("analysis_id"),
        F.when(n % 8 == 1, "deep_read").when(n % 8 == 3, "selective_read").alias("preferred_recommendation"),
    )
    translations = rows.select(
        F.concat(F.lit("d"), n).alias("content_id"), F.lit("zh-CN").alias("target_language"),
        F.when(n % 4 == 0, "old").otherwise(current).alias("source_hash"),
        F.when(n % 3 == 0, "pending").otherwise("completed").alias("status"),
        md.split_blocks(F.col("markdown")).alias("blocks"),
    )
    return rd.content_detail(contents, analysed, jobs, feedback, translations)


# The same plans, written out independently.
_PLAN = """SELECT s.doc_id, s.ord,
       CASE WHEN s.doc_id % 7 = 3 AND ord = 2 THEN 'sec-001' WHEN s.doc_id % 7 = 4 AND ord = 1 THEN 'sec-099' ELSE printf('sec-%03d', ord) END AS ref,
       CASE s.doc_id % 7 WHEN 1 THEN 'read' WHEN 2 THEN 'skip' ELSE (['skip', 'read', 'skim', 'deep_read'])[CAST(ord % 4 AS INT) + 1] END AS action
FROM o_sections s WHERE NOT (s.doc_id % 7 = 5 AND ord = 2)"""
GUIDED_REASON_SQL = f"""SELECT a.doc_id, CASE
    WHEN n IS NULL THEN '缺少系统章节清单'
    WHEN a.doc_id % 7 = 6 AND n = 1 THEN '主章节数量不在 2～10 范围内'
    WHEN a.doc_id % 7 = 6 THEN '章节摘要未完整覆盖全部主章节'
    WHEN a.doc_id % 7 IN (3, 4) THEN '章节计划引用缺失、重复或未知'
    WHEN a.doc_id % 7 = 5 THEN '章节计划未完整覆盖全部主章节'
    WHEN NOT p.compress THEN '章节计划缺少需要压缩的章节（skip/skim）'
    WHEN NOT p.keep THEN '章节计划缺少需要阅读的章节（read/deep_read）' END AS reason
FROM v_articles a LEFT JOIN (SELECT doc_id, count(*) AS n FROM o_sections GROUP BY doc_id) s ON s.doc_id = a.doc_id
LEFT JOIN (SELECT doc_id, bool_or(action IN ('skip', 'skim')) AS compress, bool_or(action IN ('read', 'deep_read')) AS keep FROM ({_PLAN}) GROUP BY doc_id) p ON p.doc_id = a.doc_id"""
_AVAILABLE = f"""SELECT doc_id, reason IS NULL AND doc_id % 11 <> 0 AND doc_id % 6 <> 0 AND doc_id % 5 <> 0 AND doc_id % 8 <> 1 AS available FROM ({GUIDED_REASON_SQL})"""


@query(
    "content_detail",
    f"""SELECT 'd' || v.doc_id AS content_id, CASE WHEN v.doc_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS analysis_status,
           CASE WHEN length(regexp_replace(v.markdown, '[^A-Za-z]', '', 'g')) >= 200 THEN 'en' WHEN length(regexp_replace(v.markdown, '[^A-Za-z]', '', 'g')) >= 40 THEN 'en' ELSE 'unknown' END AS source_language,
           CASE WHEN v.doc_id % 4 <> 0 THEN CASE WHEN v.doc_id % 3 = 0 THEN 'pending' ELSE 'completed' END END AS translation_status,
           CASE WHEN v.doc_id % 6 <> 0 THEN s.n END AS sections,
           CASE WHEN v.doc_id % 8 = 1 THEN 'deep_read' WHEN v.doc_id % 8 = 3 THEN 'selective_read' WHEN v.doc_id % 5 = 0 THEN 'deep_read' ELSE 'selective_read' END AS recommendation,
           g.available AS guided
    FROM v_articles v LEFT JOIN (SELECT doc_id, CAST(count(*) AS INT) AS n FROM o_sections GROUP BY doc_id) s ON s.doc_id = v.doc_id JOIN ({_AVAILABLE}) g ON g.doc_id = v.doc_id""",
)
def _(t):
    return article_details(t).select(
        "content_id", "analysis_status", "source_language", "translation_status",
        F.when(F.col("section_index").isNotNull(), F.size("section_index.sections")).alias("sections"),
        "recommendation", F.col("guided_flow_available").alias("guided"),
    )


@query("guided_available", f"SELECT 'd' || doc_id AS content_id, available AS guided FROM ({_AVAILABLE})")
def _(t):
    return article_details(t).select("content_id", F.col("guided_flow_available").alias("guided"))
