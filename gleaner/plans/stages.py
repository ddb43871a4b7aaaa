"""Queries: model stages with a deterministic provider, contracts, transitions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..operators import contents as ct
from ..operators import contracts as cn
from ..operators import scheduling as sc
from ..operators import stage_job as sj
from ..operators import stages as st
from ..schemas import ANALYZE_DDL, TRIAGE_DDL
from .contents import profiles
from .inputs import Inputs, query, stamp
from .reading import article_plans
from .scheduling import now
from .text import hashed


class EchoProvider:
    """Deterministic stand-in for a model: answers from the payload alone."""

    model = "echo-1"

    def complete(self, system_prompt: str, user_prompt: str, stage: str) -> tuple[str, str]:
        body = json.loads(user_prompt)
        size = len(user_prompt)
        if size % 13 == 0:
            raise TimeoutError("no answer")
        if size % 7 == 0 and "short" not in system_prompt:
            return '{"relevance": "high"', "length"
        markdown = body["content"]["markdown"]
        answer = {
            "relevance": "high" if len(markdown) > 500 else "low",
            "intrinsic_signal": "low",
            "novelty_signal": "unknown",
            "exploration_value": "low",
            "discovery_type": "adjacent",
            "decision": "ignore" if size % 5 == 0 else "continue",
            "reason": f"{len(markdown)} characters" if size % 11 else "",
            "why_outside_profile": None,
        }
        return json.dumps(answer), "stop"


def stage_inputs(t: Inputs) -> DataFrame:
    """Contents with section index and reader profile."""
    index = md.section_index(F.col("markdown"), F.col("title"))
    rows = t.v_contents.withColumn("section_index", index).withColumn(
        "user_id", F.concat(F.lit("u"), F.expr("substring(content_id, 2)"))
    )
    return ct.attach_profile(rows, profiles(t))


_FOCUS = """(SELECT c.*, p.focus, p.goal, p.preferred_depth, p.time_budget_minutes, p.exploration_level, p.topic, p.topic_level, p.user_id AS uid FROM v_contents c
    LEFT JOIN (SELECT * FROM v_profiles WHERE questionnaire_completed_at IS NOT NULL) p ON p.user_id = 'u' || substr(c.content_id, 2))"""


@query(
    "triage_requests",
    f"""SELECT content_id, sha256('{{"content":{{"title":' || to_json(title) || ',"source_url":' || to_json(source_url) || ',"source_type":"web","capture_mode":"' || capture_mode || '","capture_quality":"' || capture_quality
           || '","markdown":' || to_json(markdown) || ',"section_index":null}},"focus_topics":' || CASE WHEN focus IS NULL THEN '[]' ELSE '["' || focus || '"]' END || '}}') AS payload FROM {_FOCUS}""",
)
def _(t):
    return st.triage_requests(stage_inputs(t)).select("content_id", hashed(F.col("payload")).alias("payload"))


@query(
    "analyze_requests",
    f"""SELECT content_id, sha256('{{"content":{{"title":' || to_json(title) || ',"source_url":' || to_json(source_url) || ',"source_type":"web","capture_mode":"' || capture_mode || '","capture_quality":"' || capture_quality
           || '","markdown":' || to_json(markdown) || ',"section_index":null}},"triage":{{"decision":"continue","why_outside_profile":null}}}}') AS payload FROM v_contents""",
)
def _(t):
    triage = F.struct(F.lit("continue").alias("decision"), F.lit(None).cast("string").alias("why_outside_profile"))
    rows = stage_inputs(t).withColumn("triage", triage)
    return st.analyze_requests(rows).select("content_id", hashed(F.col("payload")).alias("payload"))


@query(
    "evaluate_requests",
    f"""SELECT content_id, '{{"content_analysis":{{"summary":"about ' || content_id || '","thesis":null}},"user_profile":{{"focus_topics":' || CASE WHEN uid IS NULL THEN '[]' ELSE '["' || focus || '"]' END
           || ',"known_topics":' || CASE WHEN uid IS NULL THEN '[]' WHEN topic_level = '' THEN '["spark（expert）"]' ELSE '["' || topic || '（' || topic_level || '）","spark（expert）"]' END
           || ',"reading_goals":' || CASE WHEN uid IS NULL THEN '[]' ELSE '["' || goal || '"]' END || ',"preferred_depth":"' || coalesce(preferred_depth, 'balanced')
           || '","time_budget_minutes":' || coalesce(time_budget_minutes, 20) || ',"exploration_level":"' || coalesce(exploration_level, 'medium') || '"}}}}' AS payload FROM {_FOCUS}""",
)
def _(t):
    analysis = F.struct(F.concat(F.lit("about "), "content_id").alias("summary"), F.lit(None).cast("string").alias("thesis"))
    return st.evaluate_requests(stage_inputs(t).withColumn("content_analysis", analysis)).select("content_id", "payload")


def triage_payloads(t: Inputs) -> DataFrame:
    rows = t.documents.select(
        F.col("doc_id").alias("id"), F.col("text").alias("markdown"), *[F.lit("x").alias(c) for c in ("title", "source_url", "source_type", "capture_mode", "capture_quality")],
        F.lit(None).cast("string").alias("section_index"), F.array().cast("array<string>").alias("focus_topics"),
    )
    return st.triage_requests(rows).select("id", "payload")


# The stand-in answers from the length of the payload and of the text alone.
_CALLS = """(SELECT doc_id AS id, length(text) AS chars, length('{"content":{"title":"x","source_url":"x","source_type":"x","capture_mode":"x","capture_quality":"x","markdown":' || to_json(text)
    || ',"section_index":null},"focus_topics":[]}') AS size FROM documents)"""
_ANSWER = """'{"relevance": "' || CASE WHEN chars > 500 THEN 'high' ELSE 'low' END || '", "intrinsic_signal": "low", "novelty_signal": "unknown", "exploration_value": "low", "discovery_type": "adjacent", "decision": "'
    || CASE WHEN size % 5 = 0 THEN 'ignore' ELSE 'continue' END || '", "reason": "' || CASE WHEN size % 11 > 0 THEN chars || ' characters' ELSE '' END || '", "why_outside_profile": null}'"""


@query(
    "run_stage",
    f"""SELECT id, CASE WHEN size % 13 = 0 THEN NULL WHEN size % 7 = 0 THEN '{{"relevance": "high"' ELSE {_ANSWER} END AS raw,
               CASE WHEN size % 13 = 0 THEN NULL WHEN size % 7 = 0 THEN 'length' ELSE 'stop' END AS finish_reason,
               CASE WHEN size % 13 = 0 THEN 'TimeoutError: no answer' END AS error FROM {_CALLS}""",
)
def _(t):
    return st.run_stage(triage_payloads(t), EchoProvider(), "triage")


@query(
    "provider",
    f"""SELECT id, CASE WHEN size % 13 > 0 THEN {_ANSWER} END AS raw, CASE WHEN size % 13 > 0 THEN 'stop' END AS finish_reason, CASE WHEN size % 13 = 0 THEN 'TimeoutError: no answer' END AS error,
               CASE WHEN size % 13 = 0 THEN 'json' WHEN size % 11 = 0 THEN 'reason' ELSE '' END AS violations,
               CASE WHEN size % 13 = 0 THEN 'call' WHEN size % 11 = 0 THEN 'contract' END AS problem FROM {_CALLS}""",
)
def _(t):
    rows = st.complete_stage(triage_payloads(t), EchoProvider(), "triage", retry_prompt="short")
    return rows.select("id", "raw", "finish_reason", "error", F.array_join("violations", ",").alias("violations"), "problem")


# --- contracts: documents supply texts, ids decide which rule a row breaks --
def _text(name, broken, at):
    return F.when(F.col("doc_id") % 29 == at, broken).otherwise(name)


def triage_answers(t: Inputs) -> DataFrame:
    n = F.col("doc_id")
    reason = F.concat(F.lit("r "), "text")
    base = F.struct(
        F.when(n % 29 == 1, "huge").otherwise("high").alias("relevance"),
        F.when(n % 2 == 0, "low").otherwise("medium").alias("intrinsic_signal"),
        F.lit("unknown").alias("novelty_signal"),
        F.lit("low").alias("exploration_value"),
        F.when(n % 3 == 0, "outside_profile_high_value").otherwise("adjacent").alias("discovery_type"),
        F.when(n % 5 == 0, "ignore").otherwise("continue").alias("decision"),
        F.when(n % 29 == 2, F.concat(reason, F.repeat(F.lit("x"), 400))).when(n % 29 == 3, "").otherwise(reason).alias("reason"),
        F.when(n % 4 == 0, "because").alias("why_outside_profile"),
        F.when(n % 29 == 4, "surplus").alias("note"),
    )
    full = F.to_json(base, {"ignoreNullFields": "false"})
    full = F.when(n % 29 == 4, full).otherwise(F.replace(full, F.lit(',"note":null'), F.lit("")))
    raw = (
        F.when(n % 29 == 5, F.substring(full, 1, 50))
        .when(n % 29 == 6, F.lit("[1]"))
        .when(n % 29 == 7, F.regexp_replace(full, '"why_outside_profile":(null|"because")', '"dropped":1'))
        .when(n % 29 == 8, F.replace(full, F.lit('"decision":"'), F.lit('"decision":7,"x":"')))
        .otherwise(full)
    )
    return t.documents.select("doc_id", raw.alias("raw"))


_TRIAGE_RULES = """CASE WHEN r IN (5, 6) THEN 'json' ELSE concat_ws(',', CASE r WHEN 1 THEN 'relevance' WHEN 8 THEN 'decision' END,
       CASE WHEN r IN (2, 3) OR length(text) > 398 THEN 'reason' END, CASE r WHEN 7 THEN 'why_outside_profile' END,
       CASE r WHEN 4 THEN 'extra:note' WHEN 7 THEN 'extra:dropped' WHEN 8 THEN 'extra:x' END,
       CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 1 AND r <> 8 THEN 'rule:ignore' END,
       CASE WHEN doc_id % 3 = 0 AND (doc_id % 4 <> 0 OR r = 7) THEN 'rule:outside_profile' END) END"""


@query("parse_triage", f"SELECT doc_id, {_TRIAGE_RULES} AS violations FROM (SELECT doc_id, text, doc_id % 29 AS r FROM documents)")
def _(t):
    return cn.parse_triage(triage_answers(t)).select("doc_id", F.array_join("violations", ",").alias("violations"))


def analyze_answers(t: Inputs) -> DataFrame:
    n = F.col("doc_id")
    r = n % 29

    def texts(at_long, at_many, limit):
        many = F.array_repeat(F.lit("p"), limit + 1)
        return F.when(r == at_many, many).when(r == at_long, F.array(F.repeat(F.lit("y"), 401))).otherwise(F.array(F.lit("one"), F.lit("two")))

    body = F.struct(
        F.when(r == 1, F.repeat(F.lit("s"), 241)).otherwise(F.lit("one line")).alias("one_sentence_summary"),
        F.concat(F.lit("s "), "text").alias("summary"),
        F.struct(
            F.when(r == 2, F.array_repeat(F.lit("t"), 9)).otherwise(F.array("lang")).alias("topics"),
            F.lit("essay").alias("content_type"),
            F.when(r == 3, "hard").otherwise("advanced").alias("difficulty"),
        ).alias("content_profile"),
        F.array(
            F.struct(F.lit("sec-001").alias("section_ref"), F.when(r == 4, "").otherwise("t").alias("title"), F.lit("m").alias("summary"))
        ).alias("content_map"),
        texts(5, 6, 10).alias("key_points"),
        F.array(
            F.struct(
                F.lit("c").alias("claim"),
                F.when(r == 7, F.array_repeat(F.lit("e"), 5)).otherwise(F.array(F.lit("e"))).alias("evidence"),
                F.when(r == 8, "maybe").otherwise("opinion").alias("verification"),
            )
        ).alias("claims"),
        F.when(r == 9, "").alias("thesis"),
        texts(10, 11, 8).alias("supporting_evidence"),
        texts(12, 13, 6).alias("counterarguments"),
        F.when(n % 2 == 0, "calm").alias("author_stance"),
        texts(14, 15, 6).alias("limitations"),
        texts(16, 17, 6).alias("unresolved_questions"),
        texts(18, 19, 6).alias("unverified_claims"),
    )
    full = F.to_json(body, {"ignoreNullFields": "false"})
    raw = (
        F.when(r == 20, F.replace(full, F.lit('"claim":"c"'), F.lit('"claim":"c","by":"me"')))
        .when(r == 21, F.replace(full, F.lit('"key_points":["one","two"]'), F.lit('"key_points":"one"')))
        .when(r == 22, F.replace(full, F.lit('"key_points":["one","two"]'), F.lit('"key_points":["one",2]')))
        .when(r == 23, F.replace(full, F.lit('"section_ref":"sec-001",'), F.lit("")))
        .when(r == 24, F.replace(full, F.lit('"content_map":[{"section_ref":"sec-001","title":"t","summary":"m"}]'), F.lit('"content_map":[]')))
        .otherwise(full)
    )
    return t.documents.select("doc_id", raw.alias("raw"))


@query(
    "parse_analyze",
    """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 29 = 1 THEN 'one_sentence_summary' END, CASE WHEN length(text) > 1598 THEN 'summary' END, ([NULL, 'content_profile', 'content_profile', 'content_map', 'key_points', 'key_points', 'claims', 'claims', 'thesis', 'supporting_evidence', 'supporting_evidence',
        'counterarguments', 'counterarguments', 'limitations', 'limitations', 'unresolved_questions', 'unresolved_questions', 'unverified_claims', 'unverified_claims', 'claims', 'key_points', 'key_points'])[CAST(doc_id % 29 AS INT)]) AS violations FROM documents""",
)
def _(t):
    return cn.parse_analyze(analyze_answers(t)).select("doc_id", F.array_join("violations", ",").alias("violations"))


def evaluate_answers(t: Inputs) -> DataFrame:
    n = F.col("doc_id")
    r = n % 29
    item = F.struct(
        F.lit("sec-001").alias("section_ref"), F.lit("s").alias("section"),
        F.when(r == 1, "burn").otherwise("skim").alias("action"), F.lit("why").alias("reason"),
    )
    body = F.struct(
        F.lit("very_high").alias("relevance"),
        F.when(r == 2, "extreme").otherwise("low").alias("knowledge_overlap"),
        (n % 2 == 0).alias("known_or_redundant"),
        F.when(r == 3, F.array_repeat(F.lit("n"), 9)).otherwise(F.array(F.lit("n"))).alias("novel_information"),
        F.when(n % 3 == 0, "high").otherwise("low").alias("exploration_value"),
        F.lit("low").alias("perspective_diversity"),
        F.when(n % 7 == 0, "outside_profile_high_value").otherwise("adjacent").alias("discovery_type"),
        F.element_at(F.array(*[F.lit(x) for x in ("ignore", "summary_enough", "selective_read", "deep_read")]), (n % 4 + 1).cast("int")).alias("recommendation"),
        F.concat(F.lit("s "), "text").alias("recommendation_reason"),
        F.when(n % 2 == 1, "different").alias("why_outside_profile"),
        F.when(r == 4, F.array_repeat(item, 11)).otherwise(F.array(item)).alias("reading_plan"),
    )
    full = F.to_json(body, {"ignoreNullFields": "false"})
    raw = F.when(r == 5, F.regexp_replace(full, '"known_or_redundant":(true|false)', '"known_or_redundant":"perhaps"')).when(
        r == 6, F.concat(F.lit("answer: "), full)
    ).otherwise(full)
    return t.documents.select("doc_id", raw.alias("raw"))


@query(
    "parse_evaluate",
    """SELECT doc_id, CASE WHEN r = 6 THEN 'json' ELSE concat_ws(',', CASE r WHEN 2 THEN 'knowledge_overlap' WHEN 3 THEN 'novel_information' WHEN 5 THEN 'known_or_redundant' END,
              CASE WHEN length(text) > 1598 THEN 'recommendation_reason' END, CASE WHEN r IN (1, 4) THEN 'reading_plan' END,
              CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 0 THEN 'rule:exploration' END, CASE WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN 'rule:outside_profile' END) END AS violations
       FROM (SELECT doc_id, text, doc_id % 29 AS r FROM documents)""",
)
def _(t):
    return cn.parse_evaluate(evaluate_answers(t)).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query(
    "retry_rows",
    f"""SELECT 'json_object' AS mode, doc_id FROM (SELECT doc_id, doc_id % 10 AS k, {_TRIAGE_RULES} AS v FROM (SELECT doc_id, text, doc_id % 29 AS r FROM documents)) WHERE k <> 1 AND (k IN (2, 3) OR v <> '')
        UNION ALL SELECT 'json_schema', doc_id FROM documents WHERE doc_id % 10 = 3""",
)
def _(t):
    n = F.col("doc_id")
    answered = triage_answers(t).withColumn("raw", F.when(n % 10 == 2, "  ").otherwise(F.col("raw")))
    results = cn.parse_triage(answered).withColumns(
        {
            "error": F.when(n % 10 == 1, "HTTP 500"),
            "finish_reason": F.when(n % 10 == 3, "length").otherwise("stop"),
        }
    )
    return st.retry_modes(results, ["json_object", "json_schema"]).select(F.col("retry_mode").alias("mode"), "doc_id")


@query(
    "manual_override",
    "SELECT content_id, CASE WHEN capture_mode = 'manual' AND capture_quality <> 'poor' THEN 'continue' ELSE 'ignore' END AS decision FROM v_contents",
)
def _(t):
    rows = t.v_contents.withColumn("capture_quality", F.when(F.col("capture_quality") == "poor", "failed").otherwise(F.col("capture_quality")))
    out = st.manual_override(rows.withColumn("triage", F.struct(F.lit("ignore").alias("decision"))))
    return out.select("content_id", "triage.decision")


def running_jobs(t: Inputs) -> DataFrame:
    """Jobs as a worker holds them: all open ones claimed, some with an earlier error."""
    stages = F.array(*[F.lit(s) for s in ("triage", "analyze", "evaluate")])
    n = F.length("analysis_id") + F.unix_seconds("created_at") / 60
    return t.v_jobs.select(
        "job_id", "analysis_id",
        F.element_at(stages, (F.pmod(n, F.lit(3)) + 1).cast("int")).alias("stage"),
        F.when(F.col("status") == "pending", "running").otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "pending", "earlier").alias("last_error"), "immediate_requested_at",
    )


_RUNNING = """(SELECT job_id, analysis_id, (['triage', 'analyze', 'evaluate'])[CAST((length(analysis_id) + epoch(created_at) // 60) % 3 AS INT) + 1] AS stage,
    CASE WHEN status = 'pending' THEN 'running' ELSE status END AS status, CASE WHEN status = 'pending' THEN 'earlier' END AS last_error, immediate_requested_at, CAST(substr(split_part(analysis_id, '-', 1), 2) AS BIGINT) AS n FROM v_jobs)"""


@query(
    "advance_stage",
    f"""SELECT job_id, CASE WHEN status <> 'running' OR n % 4 = 1 THEN stage WHEN n % 4 = 3 THEN stage WHEN stage = 'triage' AND n % 3 = 0 THEN 'completed' WHEN stage = 'triage' THEN 'analyze' WHEN stage = 'analyze' THEN 'evaluate' ELSE 'completed' END AS stage,
               CASE WHEN status <> 'running' OR n % 4 = 1 THEN status WHEN n % 4 = 3 THEN 'failed' WHEN stage = 'evaluate' OR (stage = 'triage' AND n % 3 = 0) THEN 'completed' ELSE status END AS status,
               CASE WHEN status <> 'running' OR n % 4 = 1 THEN last_error WHEN n % 4 = 3 THEN 'boom' WHEN stage = 'evaluate' OR (stage = 'triage' AND n % 3 = 0) THEN NULL ELSE last_error END AS last_error
        FROM {_RUNNING}""",
)
def _(t):
    n = F.regexp_extract("analysis_id", r"a(\d+)-", 1).cast("bigint")
    results = t.v_analyses.filter(n % 4 != 1).select(
        "analysis_id", F.when(n % 3 == 0, "ignore").otherwise("continue").alias("decision"), F.when(n % 4 == 3, "boom").alias("error")
    )
    return st.advance_stage(running_jobs(t), results).select("job_id", "stage", "status", "last_error")


@query(
    "pause_running",
    f"SELECT job_id, CASE WHEN status = 'running' AND immediate_requested_at IS NULL THEN 'pending' ELSE status END AS status FROM {_RUNNING}",
)
def _(t):
    paused = st.pause_running(running_jobs(t), sc.gate_open(True, t.v_schedule_windows, now()))
    return paused.select("job_id", "status")


@query(
    "retry_failed",
    """SELECT a.analysis_id, CASE WHEN c THEN 'pending' ELSE a.status END AS status, CASE WHEN NOT c THEN a.triage_decision END AS triage, CASE WHEN NOT c THEN 'h' END AS source_hash,
              CASE WHEN c THEN 'triage' ELSE j.stage END AS stage, CASE WHEN c THEN 'pending' ELSE j.status END AS job_status
       FROM (SELECT *, status = 'failed' AND length(analysis_id) % 2 = 0 AS c FROM v_analyses) a JOIN v_jobs j USING (analysis_id)""",
)
def _(t):
    analyses = t.v_analyses.select("analysis_id", "status", F.col("triage_decision").alias("triage"), F.lit("h").alias("source_hash"))
    ids = t.v_analyses.filter(F.length("analysis_id") % 2 == 0).select("analysis_id")
    new_analyses, new_jobs = st.retry_failed(analyses, t.v_jobs, ids)
    return new_analyses.join(new_jobs.select("analysis_id", "stage", F.col("status").alias("job_status")), "analysis_id")


@query(
    "run_now",
    """SELECT j.job_id, strftime(CASE WHEN a.status IN ('pending', 'running') AND length(a.analysis_id) % 2 = 0 THEN coalesce(j.immediate_requested_at, TIMESTAMP '2024-01-05 04:20:00') ELSE j.immediate_requested_at END, '%Y-%m-%d %H:%M:%S') AS requested
       FROM v_jobs j JOIN v_analyses a USING (analysis_id)""",
)
def _(t):
    ids = t.v_analyses.filter(F.length("analysis_id") % 2 == 0).select("analysis_id")
    rows = st.run_now(t.v_analyses, t.v_jobs, ids, F.lit("2024-01-05 04:20:00").cast("timestamp"))
    return rows.select("job_id", stamp(F.col("immediate_requested_at")).alias("requested"))


class StageProvider:
    """Deterministic stand-in for all three stages: what it does depends on a length in the payload."""

    model = "echo-2"

    def complete(self, system_prompt: str, user_prompt: str, stage: str) -> tuple[str, str]:
        body = json.loads(user_prompt)
        if stage == "triage":
            size = len(body["content"]["title"])
            if size % 7 == 0:
                raise TimeoutError("no answer")
            answer = dict.fromkeys(("intrinsic_signal", "exploration_value"), "low") | {
                "relevance": "low", "novelty_signal": "unknown", "discovery_type": "adjacent",
                "decision": "ignore" if size % 3 == 0 else "continue", "reason": "r", "why_outside_profile": None,
            }
        elif stage == "analyze":
            size = len(body["content"]["source_url"])
            if size % 5 == 0 and "refused: length" not in system_prompt:
                return "{", "length"
            answer = {"one_sentence_summary": "" if size % 11 == 0 else "one", "summary": body["content"]["title"] or "none"}
            answer |= {"content_profile": {"topics": [], "content_type": "essay", "difficulty": "advanced"}, "content_map": [{"title": "t", "summary": "s"}], "thesis": None, "author_stance": None}
            answer |= {c: [] for c in ("key_points", "claims", "supporting_evidence", "counterarguments", "limitations", "unresolved_questions", "unverified_claims")}
        else:
            size = len(body["content_analysis"]["summary"])
            answer = dict.fromkeys(("knowledge_overlap", "exploration_value", "perspective_diversity"), "low") | {
                "relevance": "low", "known_or_redundant": False, "novel_information": [], "discovery_type": "adjacent",
                "recommendation": "perhaps" if size % 5 == 0 else ["ignore", "summary_enough", "selective_read", "deep_read"][size % 4],
                "recommendation_reason": "r", "why_outside_profile": None, "reading_plan": [],
            }
        return json.dumps(answer), "stop"


def stored_analyses(t: Inputs) -> DataFrame:
    """Analyses with what earlier runs left: those under way have a triage, most of them an analysis too."""
    under_way = F.col("status") == "running"
    body = F.to_json(F.struct(F.col("content_id").alias("summary")))
    return t.v_analyses.select(
        "analysis_id", "content_id", "status",
        F.from_json(F.when(under_way, F.lit('{"decision":"continue"}')), TRIAGE_DDL).alias("triage"),
        F.from_json(F.when(under_way & ~F.col("content_id").endswith("1"), body), ANALYZE_DDL).alias("content_analysis"),
    )


_FATES = """(SELECT *, CASE WHEN job_was <> 'pending' THEN 'none' WHEN was = 'running' AND bare THEN 'bare' WHEN was = 'running' AND id_chars % 5 = 0 THEN 'vague'
                        WHEN was = 'running' THEN 'done' WHEN title % 7 = 0 THEN 'call' WHEN title % 3 = 0 AND NOT manual THEN 'ignored' WHEN NOT asked THEN 'paused'
                        WHEN url % 11 = 0 THEN 'blank' WHEN greatest(title, CASE WHEN title = 0 THEN 4 ELSE 0 END) % 5 = 0 THEN 'vague' ELSE 'done' END AS fate FROM (
         SELECT j.job_id, a.analysis_id, a.status AS was, j.stage AS stood, j.status AS job_was, j.immediate_requested_at IS NOT NULL AS asked, length(c.title) AS title, length(c.source_url) AS url,
                length(c.content_id) AS id_chars, c.content_id LIKE '%1' AS bare, c.capture_mode = 'manual' AS manual
         FROM v_analyses a JOIN v_jobs j USING (analysis_id) JOIN v_contents c USING (content_id)))"""


@query(
    "run_pipeline",
    f"""SELECT analysis_id, CASE WHEN fate = 'none' THEN was WHEN fate IN ('bare', 'vague', 'call', 'blank') THEN 'failed' WHEN fate = 'paused' THEN 'running' ELSE 'completed' END AS status,
              CASE fate WHEN 'none' THEN stood WHEN 'call' THEN 'triage' WHEN 'ignored' THEN 'completed' WHEN 'paused' THEN 'analyze' WHEN 'blank' THEN 'analyze' WHEN 'done' THEN 'completed' ELSE 'evaluate' END AS stage,
              CASE WHEN fate = 'none' THEN job_was WHEN fate IN ('bare', 'vague', 'call', 'blank') THEN 'failed' WHEN fate = 'paused' THEN 'pending' ELSE 'completed' END AS job_status,
              CASE WHEN fate = 'none' THEN 0 ELSE 1 END AS attempts,
              CASE fate WHEN 'bare' THEN 'stage data is incomplete' WHEN 'vague' THEN 'contract: recommendation' WHEN 'call' THEN 'TimeoutError: no answer' WHEN 'blank' THEN 'contract: one_sentence_summary' END AS last_error,
              CASE WHEN fate IN ('none', 'call') THEN CASE WHEN was = 'running' THEN 'continue' END WHEN fate = 'ignored' THEN 'ignore' ELSE 'continue' END AS decision,
              CASE WHEN fate = 'done' THEN (['ignore', 'summary_enough', 'selective_read', 'deep_read'])[CAST(CASE WHEN was = 'running' THEN id_chars WHEN title = 0 THEN 4 ELSE title END % 4 AS INT) + 1] END AS recommendation
       FROM {_FATES}""",
)
def _(t):
    jobs = t.v_jobs.withColumns({"attempts": F.lit(0), "last_error": F.lit(None).cast("string")})
    contents = t.v_contents.withColumn("user_id", F.expr("concat('u', substring(content_id, 2))"))
    # The window closes after triage; only what was asked for at once goes on.
    analyses, jobs = sj.run_pipeline(
        stored_analyses(t), jobs, contents, profiles(t), StageProvider(), now(), gate=lambda stage: F.lit(stage == "triage")
    )
    state = jobs.select("analysis_id", "stage", F.col("status").alias("job_status"), "attempts", "last_error")
    return analyses.select(
        "analysis_id", "status", F.col("triage.decision").alias("decision"), F.col("personal_evaluation.recommendation").alias("recommendation")
    ).join(state, "analysis_id")
