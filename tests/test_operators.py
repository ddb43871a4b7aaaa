import pytest
from pyspark.sql import functions as F

from gleaner.operators import contents as ct
from gleaner.operators import feedback as fb
from gleaner.operators import scheduling as sc
from gleaner.operators import translation as tr


def rows(spark, n):
    data = [(f"a{k}", "selective_read", "summary_enough", "too_high", "accurate", "yes") for k in range(n)]
    return spark.createDataFrame(
        data, "analysis_id string, ai_recommendation string, preferred_recommendation string, recommendation_accuracy string, summary_quality string, time_worthwhile string"
    )


def test_suggestions_need_twenty_rows(spark):
    assert fb.calibration_suggestions(rows(spark, 19)).count() == 0
    decided = spark.createDataFrame([("reduce_over_recommendation", "accepted")], "suggestion_id string, decision string")
    (found,) = fb.calibration_suggestions(rows(spark, 20), decided).collect()
    assert (found.suggestion_id, found.status) == ("reduce_over_recommendation", "accepted")


def test_feedback_freezes_the_first_advice(spark):
    events = spark.createDataFrame(
        [(1, "a", "2024-01-01", "ignore", "ignore"), (2, "a", "2024-01-02", "deep_read", "deep_read")],
        "event_id long, analysis_id string, ts string, ai_recommendation string, preferred_recommendation string",
    )
    (row,) = fb.feedback_fold(events).collect()
    assert (row.ai_recommendation, row.preferred_recommendation, row.recommendation_accuracy) == ("ignore", "deep_read", "too_low")


def test_empty_feedback(spark):
    analyses = spark.createDataFrame([], "analysis_id string, status string")
    (row,) = fb.calibration_stats(rows(spark, 0), analyses).collect()
    assert row.accuracy_rate is None and row.feedback_needed == 20 and row.completed_analyses == 0


@pytest.mark.parametrize(
    "now, open_, start",
    [("2026-08-13 17:00:00", True, "2026-08-13 17:00:00"), ("2026-08-14 00:00:00", False, "2026-08-14 17:00:00")],
)
def test_windows_in_local_time(spark, now, open_, start):
    windows = spark.createDataFrame([("01:00", "08:00")], "start_at string, end_at string")
    df = spark.createDataFrame([(now,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert sc.in_window(df, windows).first().in_window is open_
    later = sc.next_window_start(df, windows).first().next_start
    assert str(later) >= start and str(later)[11:] == "17:00:00"


def test_window_rules(spark):
    data = [(1, "23:00", "06:00"), (1, "05:00", "07:00"), (2, "08:00", "08:00"), (3, "22:00", "00:00"), (3, "00:00", "01:00")]
    found = sc.validate_windows(spark.createDataFrame(data, "owner_id int, start_at string, end_at string")).collect()
    assert {tuple(r) for r in found} == {(1, "overlap"), (2, "empty_window")}
    many = spark.createDataFrame([(9, "01:00", "02:00")] * 9, "owner_id int, start_at string, end_at string")
    assert {r.violation for r in sc.validate_windows(many).collect()} == {"too_many", "overlap"}


def test_batches_keep_order_and_limits(spark):
    lengths = [5000, 900, 200, 7000, 10] + [1] * 30
    df = spark.createDataFrame([(lengths,)], "ls array<int>").select(
        F.transform("ls", lambda n: F.struct(F.repeat(F.lit("x"), n).alias("source_markdown"))).alias("blocks")
    )
    (row,) = df.select(tr.batch_bounds(F.col("blocks")).alias("b")).collect()
    bounds = [(b.start, b.n) for b in row.b]
    assert bounds == [(1, 2), (3, 1), (4, 1), (5, 12), (17, 12), (29, 7)]


CAPTURES = "capture_id string, source_type string, source_url string, canonical_url string, title string, author string, markdown string, capture_mode string, capture_quality string, captured_at timestamp"
CONTENTS = "content_id string, capture_id string, source_type string, source_url string, canonical_url string, title string, author string, markdown string, capture_quality string, capture_mode string, created_at timestamp, updated_at timestamp"


def test_upsert_follows_the_order_of_captures(spark):
    def capture(cid, url, text, quality, minute):
        return (cid, "web", url, None, "t", None, text, "manual", quality, f"2024-01-01 00:{minute:02d}:00")

    batch = spark.createDataFrame(
        [
            capture("new-first", "https://e.org/n", "bad", "failed", 1), capture("new-second", "https://e.org/n?utm_a=1", "ok", "good", 2),
            capture("new-third", "https://e.org/n#x", "last", "failed", 3), capture("only-fail", "https://e.org/f", "x", "failed", 1),
            capture("old-capture", "https://e.org/moved", "moved", "good", 1),
        ],
        CAPTURES.replace("captured_at timestamp", "captured_at string"),
    ).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    stored = spark.createDataFrame(
        [("c1", "old-capture", "web", "https://e.org/o", "https://e.org/o", "t", None, "old", "good", "automatic", None, None)], CONTENTS
    )
    out = ct.upsert_captures(batch, stored)
    got = {r.canonical_url: r for r in out["contents"].collect()}
    assert set(got) == {"https://e.org/n", "https://e.org/moved"}
    new, moved = got["https://e.org/n"], got["https://e.org/moved"]
    assert (new.capture_id, new.markdown, new.capture_quality) == ("new-second", "last", "failed")
    assert (moved.content_id, moved.capture_mode, moved.markdown) == ("c1", "automatic", "moved")
    assert out["new_analyses"].count() == out["new_jobs"].count() == 1
