"""The model stages as one batch job: claim, triage, analyze, evaluate, write back."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as sc
from ..functions import markdown as md
from ..functions.text import source_hash
from ..session import cut_lineage
from . import stages as st
from .contents import attach_profile
from .scheduling import eligible_jobs

#: Stage, the request it sends, and the column that keeps its answer.
STEPS = [
    ("triage", st.triage_requests, "triage"),
    ("analyze", st.analyze_requests, "content_analysis"),
    ("evaluate", st.evaluate_requests, "personal_evaluation"),
]
INCOMPLETE = "stage data is incomplete"

_ANALYSIS = {
    "triage": sc.TRIAGE_DDL, "content_analysis": sc.ANALYZE_DDL, "personal_evaluation": sc.EVALUATE_DDL,
    "source_hash": None, "section_index": None, "model": None, "prompt_version": None, "completed_at": None,
}


def with_results(analyses: DataFrame) -> DataFrame:
    """Analyses with all result columns; those that are missing are NULL."""
    added = {}
    for name, ddl in _ANALYSIS.items():
        if name not in analyses.columns:
            empty = F.lit(None).cast("string")
            added[name] = F.from_json(empty, ddl) if ddl else empty.cast("timestamp" if name == "completed_at" else "string")
    return analyses.withColumns(added)


def claim(analyses: DataFrame, jobs: DataFrame, contents: DataFrame, gate: Column, k: int | None) -> DataFrame:
    """One narrow row per claimed job: its state and what earlier runs left, without texts.

    A content whose text changed since the stored results begins again at triage.
    """
    open_ = jobs.filter((F.col("status") == "pending") & (gate | F.col("immediate_requested_at").isNotNull()))
    chosen = open_ if k is None else eligible_jobs(jobs, gate, k)
    stored = analyses.select("analysis_id", "content_id", "triage", "content_analysis", F.col("source_hash").alias("old_hash"))
    texts = contents.select("content_id", source_hash(F.col("markdown")).alias("source_hash"), F.to_json(md.section_index(F.col("markdown"), F.col("title"))).alias("section_index"))
    rows = chosen.select("job_id", "analysis_id", "stage", "attempts", "last_error", "immediate_requested_at").join(stored, "analysis_id").join(texts, "content_id")
    again = F.col("old_hash").isNotNull() & (F.col("old_hash") != F.col("source_hash"))
    return rows.withColumns(
        {
            "stage": F.when(again, "triage").otherwise(F.col("stage")),
            "status": F.lit("running"),
            "worked": F.lit(False),
            "attempts": F.col("attempts") + 1,
            "triage": F.when(~again, F.col("triage")),
            "content_analysis": F.when(~again, F.col("content_analysis")),
            "personal_evaluation": F.from_json(F.lit(None).cast("string"), sc.EVALUATE_DDL),
        }
    ).drop("old_hash")


def run_step(state: DataFrame, articles: DataFrame, provider: st.Provider, step: tuple, prompts: Mapping[str, str], retry_prompt: str, mode: str, ledger: str | None = None) -> DataFrame:
    """Ask for one stage of all running jobs that stand at it, keep the answers and advance the jobs."""
    stage, build, column = step
    here = (F.col("status") == "running") & (F.col("stage") == stage)
    needed = {"triage": F.lit(True), "analyze": F.col("triage").isNotNull(), "evaluate": F.col("content_analysis").isNotNull()}[stage]
    asked = build(state.filter(here & needed).drop("section_index").join(articles, "content_id"))
    done = st.complete_stage(asked.select(F.col("analysis_id").alias("id"), "payload"), provider, stage, mode, prompts.get(stage, ""), retry_prompt, ledger)
    fine = F.col("problem").isNull()
    answers = done.select(
        F.col("id").alias("analysis_id"),
        F.when(fine, F.col("parsed")).alias("answer"),
        F.when(~fine, F.coalesce("error", F.concat_ws(": ", "problem", F.array_join("violations", ", ")))).alias("error"),
    )
    rows = state.join(answers, "analysis_id", "left").withColumn("error", F.when(here & ~needed, F.lit(INCOMPLETE)).otherwise(F.col("error")))
    answered = F.col("answer").isNotNull() | F.col("error").isNotNull()
    worked = here & answered
    rows = rows.withColumns({"answered": worked, "worked": F.col("worked") | worked, column: F.coalesce("answer", column)}).drop("answer")
    if stage == "triage":
        modes = articles.select("content_id", "capture_mode", "capture_quality")
        rows = st.manual_override(rows.join(modes, "content_id")).drop("capture_mode", "capture_quality")
    rows = cut_lineage(rows)
    results = rows.filter("answered").select("analysis_id", F.col("triage.decision").alias("decision"), "error")
    return st.advance_stage(rows.drop("error", "answered"), results)


def run_pipeline(
    analyses: DataFrame, jobs: DataFrame, contents: DataFrame, profiles: DataFrame, provider: st.Provider, now: Column,
    gate: Callable[[str], Column] = lambda stage: F.lit(True), k: int | None = None, prompts: Mapping[str, str] | None = None,
    retry_prompt: str = "", mode: str = "json_object", prompt_version: str = "unversioned", ledger: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New analyses and jobs after one run over all eligible jobs, or the first ``k`` of them.

    ``gate`` tells, for the name of the stage that comes next, whether work may go
    on; jobs asked for at once go on anyway, the others are released between stages
    and a later run continues them with the results they have. Finished and failed
    jobs are never asked again. Between stages only the narrow state is written;
    texts are joined to it when a request is made. An answer is asked for once
    per stage and run, and once more where it may be retried.  With a ``ledger`` folder
    answers outlive the run: one that was stopped anywhere asks only for what it lacks.
    """
    analyses = with_results(analyses)
    state = cut_lineage(claim(analyses, jobs, contents, gate("triage"), k))
    index = md.section_index(F.col("markdown"), F.col("title"))
    articles = attach_profile(contents.withColumn("section_index", index), profiles)
    for number, step in enumerate(STEPS):
        if number:
            # What was claimed at a later stage begins with it under the gate of the claim.
            state = st.pause_running(state, gate(step[0]) | ~F.col("worked"))
        state = run_step(state, articles, provider, step, prompts or {}, retry_prompt, mode, ledger)
    return write_back(analyses, jobs, state, provider.model, prompt_version, now)


def write_back(analyses: DataFrame, jobs: DataFrame, state: DataFrame, model: str, prompt_version: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Stored tables with the state of the claimed jobs; all other rows stay as they are."""
    kept = ["stage", "status", "attempts", "last_error"]
    worked = state.select("job_id", F.struct(*kept).alias("new"))
    new_jobs = jobs.join(worked, "job_id", "left").withColumns({c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in kept}).drop("new")
    done = F.col("stage") == "completed"
    failed = F.col("status") == "failed"
    columns = {
        "status": F.when(failed, "failed").when(done, "completed").otherwise("running"),
        **{c: F.col(c) for c in ("triage", "content_analysis", "personal_evaluation", "source_hash", "section_index")},
        "model": F.lit(model), "prompt_version": F.lit(prompt_version), "completed_at": F.when(done & ~failed, now.cast("timestamp")),
    }
    results = state.select("analysis_id", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("new"))
    new_analyses = analyses.join(results, "analysis_id", "left").withColumns({c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in columns}).drop("new")
    return new_analyses, new_jobs
