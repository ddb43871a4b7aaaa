"""Queries: feedback folding and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as fb
from .inputs import Inputs, query, stamp


def folded(t: Inputs):
    return fb.feedback_fold(t.v_feedback_events)


def decisions(t: Inputs):
    """Reader decisions on suggestions, one log row per event."""
    names = F.array(*[F.lit(n) for n in fb.SUGGESTIONS])
    return t.events.select(
        "event_id",
        "ts",
        F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("suggestion_id"),
        F.when(F.col("event_type") == "view", "accepted").otherwise("rejected").alias("decision"),
    )


@query(
    "feedback_fold",
    """SELECT analysis_id, ai AS ai_recommendation, model, prompt_version, pref AS preferred_recommendation, worthwhile AS time_worthwhile,
              summary_quality, accuracy AS recommendation_accuracy, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us
       FROM o_ranked WHERE analysis_id IN (SELECT analysis_id FROM v_analyses WHERE status = 'completed')""",
)
def _(t):
    rows = fb.feedback_fold(t.v_feedback_events, t.v_analyses)
    return rows.select(
        "analysis_id", "ai_recommendation", "model", "prompt_version", "preferred_recommendation", "time_worthwhile",
        "summary_quality", "recommendation_accuracy",
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"),
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"),
    )


_STATS = """SELECT count(*) AS feedback_count, count(*) FILTER (accuracy = 'accurate') AS accurate_count,
       count(*) FILTER (accuracy = 'too_high') AS too_high_count, count(*) FILTER (accuracy = 'too_low') AS too_low_count,
       round_even(count(*) FILTER (accuracy = 'accurate') / count(*) * 100, 1) AS accuracy_rate,
       count(*) FILTER (summary_quality IN ('omission', 'misleading')) AS summary_issue_count,
       count(*) FILTER (ai = 'ignore' AND (accuracy = 'too_low' OR worthwhile = 'yes')) AS high_value_miss_count,
       greatest(0, 20 - count(*) FILTER (ai_rank IS NOT NULL AND pref_rank IS NOT NULL)) AS feedback_needed,
       count(*) FILTER (abs(ai_rank - pref_rank) = 1) AS adjacent_error_count,
       count(*) FILTER (abs(ai_rank - pref_rank) >= 2) AS major_error_count,
       (SELECT count(*) FROM v_analyses WHERE status = 'completed') AS completed_analyses
FROM o_ranked"""


@query("calibration_stats", _STATS)
def _(t):
    return fb.calibration_stats(folded(t), t.v_analyses)


@query(
    "accuracy_rate",
    "SELECT round_even(count(*) FILTER (accuracy = 'accurate') / count(*) * 100, 1) AS accuracy_rate FROM o_ranked",
)
def _(t):
    return fb.accuracy_rate(folded(t))


@query(
    "confusion_matrix",
    """SELECT ai AS ai_recommendation, pref AS user_recommendation, count(*) AS "count" FROM o_ranked
       WHERE ai_rank IS NOT NULL AND pref_rank IS NOT NULL GROUP BY ALL""",
)
def _(t):
    return fb.confusion_matrix(folded(t))


@query(
    "confusion_grid",
    """SELECT l.level AS ai_recommendation, count(*) FILTER (pref = 'ignore') AS ignore, count(*) FILTER (pref = 'summary_enough') AS summary_enough,
              count(*) FILTER (pref = 'selective_read') AS selective_read, count(*) FILTER (pref = 'deep_read') AS deep_read
       FROM (SELECT unnest(['ignore', 'summary_enough', 'selective_read', 'deep_read']) AS level) l LEFT JOIN o_ranked r ON r.ai = l.level GROUP BY l.level""",
)
def _(t):
    return fb.confusion_grid(folded(t))


_COUNTS = """(SELECT count(*) AS n, count(*) FILTER (accuracy = 'too_high') AS high, count(*) FILTER (accuracy = 'too_low') AS low,
        count(*) FILTER (ai = 'ignore' AND pref <> 'ignore') AS miss, count(*) FILTER (summary_quality IN ('omission', 'misleading')) AS issues
        FROM o_ranked WHERE ai_rank IS NOT NULL AND pref_rank IS NOT NULL)"""
_ACTIVE = f"""SELECT suggestion_id, evidence FROM (
    SELECT CASE WHEN high >= thr AND low >= thr THEN 'split_recommendation_context' WHEN high >= thr AND high >= 1.5 * low THEN 'reduce_over_recommendation'
                WHEN low >= thr AND low >= 1.5 * high THEN 'protect_under_recommendation' END AS suggestion_id,
           CASE WHEN high >= thr AND low >= thr THEN high || ' 次建议偏高，同时有 ' || low || ' 次建议偏低。'
                WHEN high >= thr AND high >= 1.5 * low THEN n || ' 条有效反馈中有 ' || high || ' 次建议偏高。'
                ELSE n || ' 条有效反馈中有 ' || low || ' 次建议偏低。' END AS evidence, n
    FROM (SELECT *, greatest(5, ceil(n * CAST(0.25 AS DOUBLE))) AS thr FROM {_COUNTS})
    UNION ALL SELECT 'protect_ignore_boundary', '有 ' || miss || ' 篇被建议忽略的内容被用户修正为值得阅读。', n FROM {_COUNTS} WHERE miss >= greatest(3, ceil(n * CAST(0.15 AS DOUBLE)))
    UNION ALL SELECT 'preserve_summary_evidence', '有 ' || issues || ' 条反馈指出摘要存在遗漏或误导。', n FROM {_COUNTS} WHERE issues >= greatest(5, ceil(n * CAST(0.25 AS DOUBLE)))
) WHERE suggestion_id IS NOT NULL AND n >= 20"""
_LAST = """SELECT suggestion_id, arg_max(decision, (ts, event_id)) AS decision FROM (
    SELECT event_id, ts, ['split_recommendation_context', 'reduce_over_recommendation', 'protect_under_recommendation', 'protect_ignore_boundary', 'preserve_summary_evidence'][CAST(event_id % 5 AS INT) + 1] AS suggestion_id,
           CASE WHEN event_type = 'view' THEN 'accepted' ELSE 'rejected' END AS decision FROM events) GROUP BY suggestion_id"""


@query(
    "calibration_suggestions",
    f"SELECT a.suggestion_id, a.evidence, coalesce(l.decision, 'pending') AS status FROM ({_ACTIVE}) a LEFT JOIN ({_LAST}) l USING (suggestion_id)",
)
def _(t):
    suggestions = fb.calibration_suggestions(folded(t))
    decided = fb.decide_suggestions(suggestions, decisions(t))
    return fb.calibration_suggestions(folded(t), decided).select("suggestion_id", "evidence", "status")


@query(
    "decide_suggestions",
    f"SELECT suggestion_id, decision FROM ({_LAST}) WHERE suggestion_id IN (SELECT suggestion_id FROM ({_ACTIVE}))",
)
def _(t):
    return fb.decide_suggestions(fb.calibration_suggestions(folded(t)), decisions(t))
