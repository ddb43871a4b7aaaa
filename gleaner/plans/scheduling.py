"""Queries: daily windows, job selection, queue state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import minute_of_day
from ..operators import scheduling as sc
from .inputs import query, stamp

_NOW = "2024-01-05 04:20:00"  # 12:20 local: outside the windows


def now():
    return F.lit(_NOW).cast("timestamp_ntz")


_LOCAL = "(hour(ts + INTERVAL 8 HOUR) * 60 + minute(ts + INTERVAL 8 HOUR))"


@query(
    "minute_of_day",
    "SELECT owner_id, window_no, CAST(split_part(start_at, ':', 1) AS INT) * 60 + CAST(split_part(start_at, ':', 2) AS INT) AS start_minute FROM v_owner_windows",
)
def _(t):
    return t.v_owner_windows.select("owner_id", "window_no", minute_of_day(F.col("start_at")).alias("start_minute"))


@query(
    "in_window",
    f"SELECT event_id, ({_LOCAL} >= 60 AND {_LOCAL} < 480) OR {_LOCAL} >= 1380 OR {_LOCAL} < 30 AS in_window FROM events",
)
def _(t):
    return sc.in_window(t.events.select("event_id", "ts"), t.v_schedule_windows).select("event_id", "in_window")


@query(
    "next_window_start",
    f"""SELECT event_id, strftime(date_trunc('day', ts + INTERVAL 8 HOUR) + CASE WHEN {_LOCAL} < 60 THEN INTERVAL 60 MINUTE WHEN {_LOCAL} < 1380 THEN INTERVAL 1380 MINUTE ELSE INTERVAL 1500 MINUTE END - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS next_start
        FROM events""",
)
def _(t):
    rows = sc.next_window_start(t.events.select("event_id", "ts"), t.v_schedule_windows)
    return rows.select("event_id", stamp(F.col("next_start")).alias("next_start"))


_SPANS = """SELECT owner_id, window_no, m.s, m.e FROM (SELECT *, CAST(split_part(start_at, ':', 1) AS INT) * 60 + CAST(split_part(start_at, ':', 2) AS INT) AS s,
        CAST(split_part(end_at, ':', 1) AS INT) * 60 + CAST(split_part(end_at, ':', 2) AS INT) AS e FROM v_owner_windows) m"""
_PIECES = f"""SELECT owner_id, window_no, s AS a, e AS b FROM ({_SPANS}) WHERE s < e UNION ALL SELECT owner_id, window_no, s, 1440 FROM ({_SPANS}) WHERE s > e
        UNION ALL SELECT owner_id, window_no, 0, e FROM ({_SPANS}) WHERE s > e AND e > 0"""


@query(
    "validate_windows",
    f"""SELECT DISTINCT owner_id, 'empty_window' AS violation FROM ({_SPANS}) WHERE s = e
        UNION ALL SELECT DISTINCT x.owner_id, 'overlap' FROM ({_PIECES}) x JOIN ({_PIECES}) y ON x.owner_id = y.owner_id AND x.a < y.b AND y.a < x.b AND (x.window_no, x.a) < (y.window_no, y.a)""",
)
def _(t):
    return sc.validate_windows(t.v_owner_windows)


@query(
    "queue_state",
    """SELECT a.analysis_id, j.stage, CASE WHEN j.immediate_requested_at IS NOT NULL THEN 'immediate' ELSE 'scheduled' END AS execution_mode,
              w AS waiting_for_schedule, CASE WHEN w THEN '2024-01-05 15:00:00' END AS next_eligible
       FROM (SELECT a.analysis_id, a.status IN ('pending', 'running') AND j.status = 'pending' AND j.immediate_requested_at IS NULL AS w
             FROM v_analyses a JOIN v_jobs j USING (analysis_id)) a JOIN v_jobs j USING (analysis_id)""",
)
def _(t):
    rows = sc.queue_state(t.v_analyses, t.v_jobs, t.v_schedule_windows, now())
    return rows.select(
        "analysis_id", "stage", "execution_mode", "waiting_for_schedule", stamp(F.col("next_eligible_at")).alias("next_eligible")
    )


_COUNTS = "count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'pending' AND immediate_requested_at IS NULL) AS scheduled"


@query("job_counts", f"SELECT {_COUNTS} FROM v_jobs")
def _(t):
    return sc.job_counts(t.v_jobs)


@query(
    "schedule_summary",
    f"SELECT false AS currently_allowed, '2024-01-05 15:00:00' AS next_start, scheduled AS scheduled_job_count FROM (SELECT {_COUNTS} FROM v_jobs)",
)
def _(t):
    rows = sc.schedule_summary(t.v_jobs, t.v_schedule_windows, now())
    return rows.select("currently_allowed", stamp(F.col("next_window_start")).alias("next_start"), "scheduled_job_count")


@query(
    "eligible_jobs",
    """SELECT 'open' AS gate, job_id FROM (SELECT job_id FROM v_jobs WHERE status = 'pending'
           ORDER BY CASE WHEN immediate_requested_at IS NOT NULL THEN 0 ELSE 1 END, immediate_requested_at NULLS FIRST, created_at, job_id LIMIT 100)
       UNION ALL SELECT 'closed', job_id FROM (SELECT job_id FROM v_jobs WHERE status = 'pending' AND immediate_requested_at IS NOT NULL
           ORDER BY immediate_requested_at, created_at, job_id LIMIT 100)""",
)
def _(t):
    opened = sc.eligible_jobs(t.v_jobs, True, 100).select(F.lit("open").alias("gate"), "job_id")
    closed = sc.eligible_jobs(t.v_jobs, sc.gate_open(True, t.v_schedule_windows, now()), 100)
    return opened.unionByName(closed.select(F.lit("closed").alias("gate"), "job_id"))
