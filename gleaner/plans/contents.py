"""Queries: captures, identity, deduplication, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_hash
from ..functions.urls import normalize_url
from ..operators import contents as ct
from ..operators import feedback as fb
from ..schemas import CAPTURE_SCHEMA_VERSION
from ..sources import captures as cap
from ..sources import pages as pg
from ..sources import tables as tb
from .inputs import Inputs, query, stamp


def raw_envelopes(t: Inputs) -> DataFrame:
    """Envelope lines of all captures; some break the contract, some are no JSON."""
    c = t.v_captures
    n = F.length("capture_id") + F.length("url") * 7 + F.length("title")
    envelope = F.to_json(
        F.struct(
            F.when(n % 17 == 0, "other.v2").otherwise(CAPTURE_SCHEMA_VERSION).alias("schema_version"),
            F.when(n % 19 == 0, "short").otherwise(F.col("capture_id")).alias("capture_id"),
            F.struct(
                F.when(n % 23 == 0, "fax").otherwise(F.col("source_type")).alias("type"),
                F.when(n % 13 == 0, F.concat(F.lit("ftp://x/"), "title")).otherwise(F.col("url")).alias("url"),
                F.when(n % 29 == 0, "").otherwise(F.col("title")).alias("title"),
                F.when(n % 31 == 0, F.repeat(F.lit("x"), 501)).alias("author"),
            ).alias("source"),
            F.struct(
                F.lit("markdown").alias("format"),
                F.col("text").alias("text"),
                F.array().cast("array<string>").alias("units"),
            ).alias("document"),
            F.struct(
                F.when(n % 3 == 0, "automatic").when(n % 37 == 0, "robot").alias("mode"),
                F.lit("gleaner-web").alias("producer"),
                F.lit("1.0.0").alias("producer_version"),
                F.struct(F.col("quality").alias("level"), F.array().cast("array<string>").alias("warnings")).alias("quality"),
                F.lit("readability").alias("extraction_engine"),
            ).alias("capture"),
        )
    )
    return c.select(
        F.col("capture_id").alias("key"),
        F.when(n % 11 == 0, F.substring(envelope, 1, 40)).otherwise(envelope).alias("value"),
    )


_N = "(length(capture_id) + length(url) * 7 + length(title))"
_RULES = f"""concat_ws(',', CASE WHEN {_N} % 17 = 0 THEN 'schema_version' END, CASE WHEN {_N} % 19 = 0 THEN 'capture_id' END,
    CASE WHEN {_N} % 23 = 0 THEN 'source.type' END, CASE WHEN {_N} % 13 = 0 THEN 'source.url' END,
    CASE WHEN {_N} % 29 = 0 THEN 'source.title' END, CASE WHEN {_N} % 31 = 0 THEN 'source.author' END,
    CASE WHEN text = '' THEN 'document.text' END, CASE WHEN {_N} % 3 <> 0 AND {_N} % 37 = 0 THEN 'capture.mode' END)"""


@query(
    "read_captures",
    f"SELECT capture_id AS key, {_N} % 11 = 0 AS quarantined, CASE WHEN {_N} % 11 <> 0 THEN text END AS text FROM v_captures",
)
def _(t):
    parsed = cap.parse_captures(raw_envelopes(t))
    return parsed.select("key", F.col("corrupt").isNotNull().alias("quarantined"), F.col("envelope.document.text").alias("text"))


@query(
    "validate_capture",
    f"SELECT capture_id AS key, CASE WHEN {_N} % 11 = 0 THEN 'envelope' ELSE {_RULES} END AS violations FROM v_captures",
)
def _(t):
    checked = ct.validate_capture(cap.parse_captures(raw_envelopes(t)))
    return checked.select("key", F.array_join("violations", ",").alias("violations"))


@query("read_pages", "SELECT page_id, url, length(html) AS html_length FROM pages")
def _(t):
    pages = pg.read_pages(t.spark, t.folder)
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("html_length"))


@query("normalize_url", "SELECT p.page_id, u.norm AS identity FROM pages p JOIN o_page_urls u USING (url)")
def _(t):
    return t.pages.select("page_id", normalize_url(F.col("url")).alias("identity"))


@query("source_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", source_hash(F.col("text")).alias("hash"))


@query(
    "access_gate",
    "SELECT content_id, CASE capture_quality WHEN 'good' THEN 'allow' WHEN 'warning' THEN 'warn' WHEN 'poor' THEN 'confirm' ELSE 'forbid' END AS access FROM v_contents",
)
def _(t):
    return ct.access_gate(t.v_contents).select("content_id", "access")


@query(
    "schema_upgrade",
    "SELECT analysis_id, status, CAST(NULL AS VARCHAR) AS source_hash, CAST(NULL AS VARCHAR) AS section_index FROM v_analyses",
)
def _(t):
    return tb.upgrade(t.v_analyses.select("analysis_id", "status"), "analyses")


def stored_contents(t: Inputs) -> DataFrame:
    """Contents as stored before identity URLs existed: every capture of a page is a row."""
    return t.v_captures.select(
        F.concat(F.lit("k-"), "capture_id").alias("content_id"), "capture_id", "source_type",
        F.col("url").alias("source_url"), F.lit(None).cast("string").alias("canonical_url"), "title",
        F.col("text").alias("markdown"), F.col("captured_at").alias("created_at"),
    )


_DEDUPED = """SELECT 'k-' || capture_id AS content_id, source_type, norm AS canonical_url FROM v_captures JOIN o_capture_urls USING (url)
    QUALIFY row_number() OVER (PARTITION BY source_type, norm ORDER BY captured_at DESC, capture_id) = 1"""


@query("dedupe_contents", _DEDUPED)
def _(t):
    return ct.dedupe_contents(stored_contents(t)).select("content_id", "source_type", "canonical_url")


def batch(t: Inputs) -> DataFrame:
    return t.v_captures.select(
        "capture_id", "source_type", F.col("url").alias("source_url"), F.lit(None).cast("string").alias("canonical_url"),
        "title", F.lit(None).cast("string").alias("author"), F.col("text").alias("markdown"),
        F.lit("manual").alias("capture_mode"), F.col("quality").alias("capture_quality"), "captured_at",
    )


def base_contents(t: Inputs) -> DataFrame:
    """Stored snapshot with unique identities, as deduplication leaves it."""
    rows = t.v_contents.select(
        "content_id", "capture_id", "source_type", "source_url", F.lit(None).cast("string").alias("canonical_url"),
        "title", F.lit(None).cast("string").alias("author"), "markdown", "capture_mode", "capture_quality",
        "created_at", F.col("created_at").alias("updated_at"),
    )
    return ct.dedupe_contents(rows)


_BASE = """SELECT c.content_id, c.capture_id, c.source_type, u.norm, c.created_at FROM v_contents c JOIN o_page_urls u ON u.url = c.source_url
    QUALIFY row_number() OVER (PARTITION BY c.source_type, u.norm ORDER BY c.created_at DESC, c.content_id) = 1"""
_MATCHED = f"""SELECT v.*, coalesce(i.content_id, k.content_id) AS matched_content_id,
       CASE WHEN i.content_id IS NOT NULL THEN 'capture_id' WHEN k.content_id IS NOT NULL THEN 'url' ELSE 'new' END AS match_kind
FROM (SELECT c.*, u.norm FROM v_captures c JOIN o_capture_urls u USING (url)) v
LEFT JOIN ({_BASE}) i ON i.capture_id = v.capture_id LEFT JOIN ({_BASE}) k ON k.source_type = v.source_type AND k.norm = v.norm"""


@query("match_existing", f"SELECT capture_id, matched_content_id, match_kind FROM ({_MATCHED})")
def _(t):
    captures = batch(t).withColumn("canonical_url", ct.identity_url())
    return ct.match_existing(captures, base_contents(t)).select("capture_id", "matched_content_id", "match_kind")


_GROUPED = f"""SELECT coalesce(matched_content_id, sha256(source_type || '|' || norm)) AS content_id, max(captured_at) AS updated_at,
       arg_max(text, (captured_at, capture_id)) AS text, arg_max(quality, (captured_at, capture_id)) AS quality,
       arg_min(capture_id, (captured_at, capture_id)) FILTER (quality <> 'failed') AS first_id, min(captured_at) FILTER (quality <> 'failed') AS first_at,
       bool_or(matched_content_id IS NOT NULL) AS found
FROM ({_MATCHED}) GROUP BY 1 HAVING found OR first_id IS NOT NULL"""


@query(
    "upsert_captures",
    f"""SELECT b.content_id, b.capture_id, coalesce(sha256(g.text), sha256(c.markdown)) AS text_hash, coalesce(g.quality, c.capture_quality) AS capture_quality,
               strftime(b.created_at, '%Y-%m-%d %H:%M:%S') AS created, strftime(coalesce(g.updated_at, b.created_at), '%Y-%m-%d %H:%M:%S') AS updated
        FROM ({_BASE}) b JOIN v_contents c USING (content_id) LEFT JOIN ({_GROUPED}) g ON g.content_id = b.content_id
        UNION ALL SELECT content_id, first_id, sha256(text), quality, strftime(first_at, '%Y-%m-%d %H:%M:%S'), strftime(updated_at, '%Y-%m-%d %H:%M:%S')
        FROM ({_GROUPED}) WHERE NOT found""",
)
def _(t):
    merged = ct.upsert_captures(batch(t), base_contents(t))["contents"]
    return merged.select(
        "content_id", "capture_id", source_hash(F.col("markdown")).alias("text_hash"), "capture_quality",
        stamp(F.col("created_at")).alias("created"), stamp(F.col("updated_at")).alias("updated"),
    )


@query(
    "integrity_report",
    f"""SELECT 'content_without_analysis' AS kind, content_id AS id FROM ({_DEDUPED}) WHERE content_id NOT IN (SELECT content_id FROM v_analyses)
        UNION ALL SELECT 'analysis_without_content', analysis_id FROM v_analyses WHERE content_id NOT IN (SELECT content_id FROM ({_DEDUPED}))
        UNION ALL SELECT 'feedback_without_analysis', analysis_id FROM o_feedback WHERE analysis_id NOT IN (SELECT analysis_id FROM v_analyses)""",
)
def _(t):
    kept = ct.dedupe_contents(stored_contents(t))
    return ct.integrity_report(kept, t.v_analyses, t.v_jobs, fb.feedback_fold(t.v_feedback_events))


def old_links(t: Inputs) -> DataFrame:
    """Analyses of the contents stored before deduplication."""
    return t.v_captures.select(
        F.concat(F.lit("an-"), "capture_id").alias("analysis_id"), F.concat(F.lit("k-"), "capture_id").alias("content_id")
    )


@query(
    "cascade_prune",
    f"""SELECT 'analyses' AS table_name, 'an-' || substr(content_id, 3) AS id FROM ({_DEDUPED})
        UNION ALL SELECT 'jobs', 'jo-' || substr(content_id, 3) FROM ({_DEDUPED})
        UNION ALL SELECT 'translations', 'tr-' || substr(content_id, 3) FROM ({_DEDUPED})""",
)
def _(t):
    analyses = old_links(t)
    jobs = analyses.select(F.concat(F.lit("jo-"), F.substring("analysis_id", 4, 100)).alias("job_id"), "analysis_id")
    translations = analyses.select(F.concat(F.lit("tr-"), F.substring("analysis_id", 4, 100)).alias("translation_id"), "content_id")
    out = ct.cascade_prune(
        ct.dedupe_contents(stored_contents(t)), {"analyses": analyses, "jobs": jobs, "translations": translations}
    )
    ids = {"analyses": "analysis_id", "jobs": "job_id", "translations": "translation_id"}
    parts = [out[name].select(F.lit(name).alias("table_name"), F.col(c).alias("id")) for name, c in ids.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def hashed_analyses(t: Inputs) -> DataFrame:
    """Analyses that remember the text they were made from; every third text has changed since."""
    n = F.substring("content_id", 2, 20).cast("bigint")
    hashed = t.v_analyses.join(t.v_contents.select("content_id", source_hash(F.col("markdown")).alias("h")), "content_id")
    return hashed.select(
        "analysis_id", "content_id", "status",
        F.when(n % 3 == 0, "old").when(n % 7 != 0, F.col("h")).alias("source_hash"),
        F.col("triage_decision").alias("triage"), F.col("evaluation_recommendation").alias("personal_evaluation"),
    )


@query(
    "stale_analyses",
    """SELECT a.analysis_id, n % 3 = 0 AS stale, n % 3 <> 0 AND n % 7 <> 0 AS index_visible,
              CASE WHEN n % 3 = 0 AND a.status IN ('pending', 'running') THEN 'triage' ELSE j.stage END AS stage,
              CASE WHEN NOT (n % 3 = 0 AND a.status IN ('pending', 'running')) THEN a.triage_decision END AS triage,
              CASE WHEN NOT (n % 3 = 0 AND a.status IN ('pending', 'running')) THEN a.evaluation_recommendation END AS evaluation
       FROM (SELECT *, CAST(substr(content_id, 2) AS BIGINT) AS n FROM v_analyses) a JOIN v_jobs j USING (analysis_id) JOIN v_contents c ON c.content_id = a.content_id""",
)
def _(t):
    rows = ct.stale_analyses(t.v_contents, hashed_analyses(t), t.v_jobs)
    return rows.select(
        "analysis_id", "stale", "index_visible", "stage", "triage", F.col("personal_evaluation").alias("evaluation")
    )


def profiles(t: Inputs) -> DataFrame:
    return t.v_profiles.select(
        "user_id", F.array("focus").alias("focus_topics"),
        F.array(
            F.struct(F.col("topic").alias("topic"), F.col("topic_level").alias("level")),
            F.struct(F.lit("spark").alias("topic"), F.lit("expert").alias("level")),
        ).alias("known_topics"),
        F.array("goal").alias("reading_goals"), "preferred_depth", "time_budget_minutes", "exploration_level",
        "questionnaire_completed_at",
    )


@query(
    "attach_profile",
    """SELECT o.o_orderkey AS item, coalesce(p.focus, '') AS focus_topics,
              CASE WHEN p.user_id IS NULL THEN '' WHEN p.topic_level = '' THEN 'spark（expert）' ELSE p.topic || '（' || p.topic_level || '）,spark（expert）' END AS known_topics,
              coalesce(p.goal, '') AS reading_goals, coalesce(p.preferred_depth, 'balanced') AS preferred_depth,
              coalesce(p.time_budget_minutes, 20) AS time_budget_minutes, coalesce(p.exploration_level, 'medium') AS exploration_level
       FROM orders o LEFT JOIN (SELECT * FROM v_profiles WHERE questionnaire_completed_at IS NOT NULL) p ON p.user_id = 'u' || o.o_custkey""",
)
def _(t):
    items = t.orders.select(F.col("o_orderkey").alias("item"), F.concat(F.lit("u"), "o_custkey").alias("user_id"))
    rows = ct.attach_profile(items, profiles(t))
    return rows.select(
        "item", *[F.array_join(c, ",").alias(c) for c in ("focus_topics", "known_topics", "reading_goals")],
        "preferred_depth", "time_budget_minutes", "exploration_level",
    )
