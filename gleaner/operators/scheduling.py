"""Daily windows: membership, next start, validation, queue state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import SCHEDULE_ZONE, local_minute, local_time, minute_of_day

MINUTES_PER_DAY = 1440
MAX_WINDOWS = 8


def window_minutes() -> tuple[Column, Column]:
    return minute_of_day(F.col("start_at")), minute_of_day(F.col("end_at"))


def covered_minutes(windows: DataFrame) -> DataFrame:
    """Minutes of the day inside any window: at most 1,440 rows, whatever the input.

    Window bounds are whole minutes and half-open, so a time lies in a window
    exactly when its minute does.
    """
    start, end = window_minutes()
    parts = windows.select(start.alias("s"), end.alias("e")).distinct()
    spans = F.when(
        F.col("s") < F.col("e"), F.sequence(F.col("s"), F.col("e") - 1)
    ).when(
        F.col("s") > F.col("e"),
        F.concat(
            F.sequence(F.col("s"), F.lit(MINUTES_PER_DAY - 1)),
            F.when(F.col("e") > 0, F.sequence(F.lit(0), F.greatest(F.col("e") - 1, F.lit(0)))).otherwise(
                F.array().cast("array<int>")
            ),
        ),
    )
    return parts.select(F.explode(spans).alias("minute")).distinct()


def in_window(df: DataFrame, windows: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``in_window``.  The broadcast side has at most one row per minute of the day."""
    minutes = covered_minutes(windows).withColumn("in_window", F.lit(True))
    return (
        df.withColumn("minute", local_minute(F.col(ts)))
        .join(F.broadcast(minutes), "minute", "left")
        .withColumn("in_window", F.coalesce("in_window", F.lit(False)))
        .drop("minute")
    )


def start_at(ts: Column, minutes: Column) -> Column:
    """UTC time of a minute counted from the local midnight before ``ts``."""
    midnight = F.date_trunc("DAY", local_time(ts)).cast("timestamp_ntz")
    start = midnight + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.convert_timezone(F.lit(SCHEDULE_ZONE), F.lit("UTC"), start)


def next_start_of(now: Column, windows: DataFrame) -> Column:
    """First window start strictly after one instant, as a scalar; NULL without windows."""
    start, _ = window_minutes()
    later = F.min(F.when(start > local_minute(now), start))
    return start_at(now, windows.agg(F.coalesce(later, F.min(start) + MINUTES_PER_DAY).alias("minutes")).scalar())


def next_start_minutes(windows: DataFrame) -> DataFrame:
    """For each of the 1,440 minutes of a day, the next start counted from its midnight."""
    start, _ = window_minutes()
    starts = windows.agg(F.array_sort(F.collect_set(start)).alias("starts"))
    later = F.get(F.filter("starts", lambda s: s > F.col("minute")), F.lit(0))
    return (
        starts.select("starts", F.explode(F.sequence(F.lit(0), F.lit(MINUTES_PER_DAY - 1))).alias("minute"))
        .select("minute", F.coalesce(later, F.get("starts", F.lit(0)) + MINUTES_PER_DAY).alias("start_minutes"))
    )


def next_window_start(df: DataFrame, windows: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``next_start``.  The broadcast side has exactly one row per minute of the day."""
    return (
        df.withColumn("minute", local_minute(F.col(ts)))
        .join(F.broadcast(next_start_minutes(windows)), "minute", "left")
        .withColumn("next_start", start_at(F.col(ts), F.col("start_minutes")))
        .drop("minute", "start_minutes")
    )


def validate_windows(windows: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Violations per owner: ``empty_window``, ``overlap``, ``too_many``.

    Equal windows are counted before the sort, so an owner sorts at most one
    row per distinct pair of minutes, however often a window is repeated.
    """
    start, end = window_minutes()
    counted = windows.groupBy(owner, start.alias("s"), end.alias("e")).agg(F.count("*").alias("n"))
    sizes = counted.groupBy(owner).agg(
        F.sum("n").alias("windows"), F.bool_or(F.col("s") == F.col("e")).alias("empty")
    )
    pieces = F.when(
        F.col("s") < F.col("e"), F.array(F.struct(F.col("s").alias("a"), F.col("e").alias("b")))
    ).when(
        F.col("s") > F.col("e"),
        F.array_compact(
            F.array(
                F.struct(F.col("s").alias("a"), F.lit(MINUTES_PER_DAY).alias("b")),
                F.when(F.col("e") > 0, F.struct(F.lit(0).alias("a"), F.col("e").alias("b"))),
            )
        ),
    )
    spans = counted.select(owner, "n", F.inline(pieces))
    order = Window.partitionBy(owner).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    overlapping = (
        spans.withColumn("clash", (F.col("n") > 1) | F.coalesce(F.col("a") < before, F.lit(False)))
        .groupBy(owner)
        .agg(F.bool_or("clash").alias("overlap"))
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("windows") > MAX_WINDOWS, F.lit("too_many")),
            F.when(F.col("empty"), F.lit("empty_window")),
            F.when(F.col("overlap"), F.lit("overlap")),
        )
    )
    return (
        sizes.join(overlapping, owner, "left")
        .select(owner, F.explode(found).alias("violation"))
    )


def gate_open(schedule_enabled: bool, windows: DataFrame, now: Column) -> Column:
    """Scalar condition: the schedule is off, or ``now`` is inside a window."""
    if not schedule_enabled:
        return F.lit(True)
    minute = F.max(F.col("minute") == local_minute(now))
    return F.coalesce(covered_minutes(windows).agg(minute.alias("open")).scalar(), F.lit(False))


def queue_state(
    analyses: DataFrame, jobs: DataFrame, windows: DataFrame, now: Column, schedule_enabled: bool = True
) -> DataFrame:
    """Why an analysis waits and when it may run."""
    rows = analyses.select("analysis_id", "status").join(
        jobs.select("analysis_id", "stage", F.col("status").alias("job_status"), "immediate_requested_at"),
        "analysis_id",
    )
    immediate = F.col("immediate_requested_at").isNotNull()
    waiting = (
        F.col("status").isin("pending", "running")
        & (F.col("job_status") == "pending")
        & ~immediate
        & ~gate_open(schedule_enabled, windows, now)
    )
    return rows.select(
        "analysis_id",
        "stage",
        F.when(immediate, F.lit("immediate")).otherwise(F.lit("scheduled")).alias("execution_mode"),
        waiting.alias("waiting_for_schedule"),
        F.when(waiting, next_start_of(now, windows)).alias("next_eligible_at"),
    )


def job_counts(jobs: DataFrame) -> DataFrame:
    pending = F.col("status") == "pending"
    return jobs.agg(
        F.count_if(pending).alias("pending"),
        F.count_if(pending & F.col("immediate_requested_at").isNull()).alias("scheduled"),
    )


def schedule_summary(jobs: DataFrame, windows: DataFrame, now: Column, schedule_enabled: bool = True) -> DataFrame:
    """Gate, next start while closed, and number of jobs that wait for it."""
    allowed = gate_open(schedule_enabled, windows, now)
    return job_counts(jobs).select(
        allowed.alias("currently_allowed"),
        F.when(~allowed, next_start_of(now, windows)).alias("next_window_start"),
        F.col("scheduled").alias("scheduled_job_count"),
    )


def eligible_jobs(jobs: DataFrame, gate_is_open: bool | Column, k: int) -> DataFrame:
    """Next ``k`` pending jobs: requested ones first, then by age."""
    gate = gate_is_open if isinstance(gate_is_open, Column) else F.lit(gate_is_open)
    immediate = F.col("immediate_requested_at").isNotNull()
    return (
        jobs.filter((F.col("status") == "pending") & (gate | immediate))
        .orderBy(
            F.when(immediate, 0).otherwise(1),
            F.col("immediate_requested_at").asc_nulls_first(),
            "created_at",
            "job_id",
        )
        .limit(k)
    )
