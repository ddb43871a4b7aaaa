"""The stage job on small tables: pauses, retries with a reason, changed texts, and a second run that asks nothing."""

import json
import os
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.operators import stage_job as sj
from gleaner.plans.stages import StageProvider

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTENTS = [
    # id, title, url (lengths decide), mode, markdown
    ("c1", "ab", "u" * 4, "automatic", "# ab\n\ntext"),
    ("c2", "abcd", "u" * 5, "automatic", "# abcd\n\ntext"),  # first analysis cut off
    ("c3", "abc", "u" * 4, "automatic", "x"),  # ignored
    ("c4", "abc", "u" * 4, "manual", ""),  # would be ignored, but was captured by hand
    ("c5", "abcdefg", "u" * 4, "automatic", "x"),  # call fails
]


def now():
    return F.lit("2024-01-05 04:20:00").cast("timestamp_ntz")


class Noting(StageProvider):
    """Writes a line for every call."""

    def __init__(self, path):
        self.path = str(path)

    def complete(self, system_prompt, user_prompt, stage):
        with open(self.path, "a") as log:
            log.write(json.dumps([stage, system_prompt]) + "\n")
        return super().complete(system_prompt, user_prompt, stage)


def calls(path):
    return [json.loads(line) for line in open(path)] if os.path.exists(path) else []


def tables(spark, asked=()):
    contents = spark.createDataFrame(
        [(i, title, url, "web", mode, "good", text, "u1") for i, title, url, mode, text in CONTENTS],
        "content_id string, title string, source_url string, source_type string, capture_mode string, capture_quality string, markdown string, user_id string",
    )
    analyses = spark.createDataFrame([(f"a{i[1]}", i, "pending") for i, *_ in CONTENTS], "analysis_id string, content_id string, status string")
    jobs = spark.createDataFrame(
        [(f"j{i[1]}", f"a{i[1]}", "triage", "pending", 0, None, "2024-01-01" if i in asked else None, "2024-01-01") for i, *_ in CONTENTS],
        "job_id string, analysis_id string, stage string, status string, attempts int, last_error string, immediate_requested_at string, created_at string",
    )
    profiles = spark.createDataFrame(
        [], "user_id string, focus_topics array<string>, known_topics array<struct<topic: string, level: string>>, reading_goals array<string>, preferred_depth string, time_budget_minutes int, exploration_level string, questionnaire_completed_at timestamp"
    )
    return analyses, jobs, contents, profiles


def states(jobs):
    return {r.analysis_id: (r.stage, r.status, r.attempts, r.last_error) for r in jobs.collect()}


def test_all_stages_and_nothing_twice(spark, tmp_path):
    analyses, jobs, contents, profiles = tables(spark)
    first, second = Noting(tmp_path / "first"), Noting(tmp_path / "second")
    analyses, jobs = sj.run_pipeline(analyses, jobs, contents, profiles, first, now())
    found = states(jobs)
    assert found["a1"] == found["a2"] == found["a3"] == found["a4"] == ("completed", "completed", 1, None)
    assert found["a5"] == ("triage", "failed", 1, "TimeoutError: no answer")
    rows = {r.analysis_id: r for r in analyses.collect()}
    assert {a: r.status for a, r in rows.items()} == {"a1": "completed", "a2": "completed", "a3": "completed", "a4": "completed", "a5": "failed"}
    assert rows["a1"].personal_evaluation.recommendation == "selective_read" and rows["a1"].content_analysis.summary == "ab"
    assert rows["a3"].triage.decision == "ignore" and rows["a3"].content_analysis is None
    assert rows["a4"].triage.decision == "continue" and rows["a4"].completed_at is not None and rows["a5"].completed_at is None
    made = calls(first.path)
    assert sorted(s for s, _ in made) == ["analyze"] * 4 + ["evaluate"] * 3 + ["triage"] * 5
    assert [p for _, p in made if p] == ["\nThe previous answer was refused: length json"]
    again, jobs2 = sj.run_pipeline(analyses, jobs, contents, profiles, second, now())
    assert states(jobs2) == found and {r.analysis_id: r for r in again.collect()} == rows and not calls(second.path)


def test_closed_gate_pauses_and_a_later_run_goes_on(spark, tmp_path):
    analyses, jobs, contents, profiles = tables(spark, asked=("c1",))
    analyses, jobs = sj.run_pipeline(analyses, jobs, contents, profiles, StageProvider(), now(), gate=lambda s: F.lit(s == "triage"))
    found = states(jobs)
    assert found["a1"][:2] == ("completed", "completed") and found["a2"] == ("analyze", "pending", 1, None)
    assert {r.analysis_id: r.status for r in analyses.collect()}["a2"] == "running"
    later = Noting(tmp_path / "later")
    _, jobs = sj.run_pipeline(analyses, jobs, contents, profiles, later, now())
    assert states(jobs)["a2"] == ("completed", "completed", 2, None) and "triage" not in {s for s, _ in calls(later.path)}
    # A text captured anew meanwhile begins again.
    analyses, jobs, contents, profiles = tables(spark)
    analyses, jobs = sj.run_pipeline(analyses, jobs, contents, profiles, StageProvider(), now(), gate=lambda s: F.lit(s == "triage"))
    changed, last = contents.withColumn("markdown", F.concat("markdown", F.lit("!"))), Noting(tmp_path / "last")
    sj.run_pipeline(analyses, jobs, changed, profiles, last, now(), k=2)[1].collect()
    assert [s for s, _ in calls(last.path)].count("triage") == 2


def test_no_open_jobs(spark):
    analyses, jobs, contents, profiles = tables(spark)
    done = jobs.withColumn("status", F.lit("completed"))
    assert states(sj.run_pipeline(analyses, done, contents, profiles, StageProvider(), now())[1]) == states(done)
