"""Model stages: requests, batched calls, retries and state transitions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import source_hash
from ..session import cut_lineage
from .contracts import PARSERS


class Provider(Protocol):
    """What a model binding must offer.  It is pickled to the executors."""

    model: str

    def complete(self, system_prompt: str, user_prompt: str, stage: str) -> tuple[str, str]:
        """Return the raw answer and its finish reason, or raise."""


_KEEP_NULLS = {"ignoreNullFields": "false"}


def _content() -> Column:
    return F.struct(
        "title", "source_url", "source_type", "capture_mode", "capture_quality", "markdown", "section_index"
    )


def _profile() -> Column:
    return F.struct(
        "focus_topics", "known_topics", "reading_goals", "preferred_depth", "time_budget_minutes", "exploration_level"
    )


def triage_requests(rows: DataFrame) -> DataFrame:
    """Adds ``payload``: content and focus topics, nothing else of the profile."""
    body = F.struct(_content().alias("content"), F.col("focus_topics"))
    return rows.withColumn("payload", F.to_json(body, _KEEP_NULLS))


def analyze_requests(rows: DataFrame) -> DataFrame:
    """Adds ``payload``: content and triage result, no profile at all."""
    body = F.struct(_content().alias("content"), F.col("triage"))
    return rows.withColumn("payload", F.to_json(body, _KEEP_NULLS))


def evaluate_requests(rows: DataFrame) -> DataFrame:
    """Adds ``payload``: content analysis and profile, no raw content."""
    body = F.struct(F.col("content_analysis"), _profile().alias("user_profile"))
    return rows.withColumn("payload", F.to_json(body, _KEEP_NULLS))


_ANSWER = "raw string, finish_reason string, error string"
_LEDGER = f"request_id string, {_ANSWER}, asked_at timestamp"


def run_stage(
    requests: DataFrame, provider: Provider, stage: str, system_prompt: str = "", ledger: str | None = None, concurrency: int = 4,
    wave: int = 10_000,
) -> DataFrame:
    """Send every request to the provider, up to ``concurrency`` at once in a task.

    ``requests``: id, payload, and ``note`` if a row adds something of its own to
    the system prompt.  A failing row becomes a row with ``error``.

    ``ledger`` is a shared folder of answers by request.  With it, a request (same
    model, prompt and payload) is asked once, whatever number of rows or runs ask it.
    Open requests go out in waves of about ``wave`` of them, each kept before the next
    one starts; a run that was stopped goes on with what is open, at most one wave of
    answers is lost.  Within a wave a lost executor costs the tasks it was running, as
    answers of a task are written when it ends.  Calls that failed stay open.
    """
    note = F.col("note") if "note" in requests.columns else F.lit("")
    rows = requests.select("id", "payload", F.coalesce(note, F.lit("")).alias("note"))
    if ledger is None:
        return _ask(rows, "id", provider, stage, system_prompt, concurrency)
    folder = f"{ledger}/stage={stage}"
    keyed = rows.withColumn("request_id", request_key(provider.model, stage, system_prompt))
    spark = keyed.sparkSession
    known = read_answers(spark, folder).filter("error IS NULL").select("request_id")
    # Fixed before the first answer is written, as the ledger is read here and appended to below.
    open_ = cut_lineage(keyed.drop("id").dropDuplicates(["request_id"]).join(known, "request_id", "left_anti"))
    waves = -(-open_.count() // wave)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(waves):
        # A given number of partitions is not merged into fewer.
        part = open_.filter(F.pmod(F.xxhash64("request_id"), F.lit(waves)) == k).repartition(tasks, "request_id")
        answers = _ask(part, "request_id", provider, stage, system_prompt, concurrency).withColumn("asked_at", F.current_timestamp())
        answers.write.mode("append").parquet(folder)
    told = F.struct(*[c.split()[0] for c in _ANSWER.split(", ")])
    best = read_answers(spark, folder).groupBy("request_id").agg(
        F.max_by(told, F.struct(F.col("error").isNull(), "asked_at", "raw")).alias("answer")
    )
    return keyed.select("id", "request_id").join(best, "request_id").select("id", "answer.*")


def request_key(model: str, stage: str, system_prompt: str) -> Column:
    """Digest of all that the provider is told in a request."""
    told = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(stage).alias("stage"), F.lit(system_prompt).alias("prompt"), "note", "payload"))
    return F.sha2(told, 256)


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a ledger folder, none where it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(_LEDGER).parquet(folder) if there else spark.createDataFrame([], _LEDGER)


#: Bytes of answers that a task holds before it hands them on.
ANSWER_BYTES = 4 << 20


def _ask(rows: DataFrame, key: str, provider: Provider, stage: str, system_prompt: str, concurrency: int) -> DataFrame:
    names = [key, "raw", "finish_reason", "error"]

    def one(row) -> tuple:
        try:
            raw, finish = provider.complete(system_prompt + row[2], row[1], stage)
            return row[0], raw, finish, None
        except Exception as error:  # one bad call must not fail the task
            return row[0], None, None, f"{type(error).__name__}: {error}"

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        waiting: deque[Future] = deque()
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                # Only the requests that are out leave Arrow; a batch as Python strings is several times as large.
                for k in range(batch.num_rows):
                    waiting.append(pool.submit(one, tuple(column[k].as_py() for column in batch.columns)))
                    if len(waiting) < concurrency:
                        continue
                    done.append(waiting.popleft().result())
                    size += len(done[-1][1] or "")
                    if size >= ANSWER_BYTES:
                        yield answers(done)
                        done, size = [], 0
            done += [w.result() for w in waiting]
        if done:
            yield answers(done)

    kind = dict(rows.dtypes)[key]
    types = to_arrow_schema(rows.select(key, *[F.lit(None).cast("string").alias(n) for n in names[1:]]).schema)

    def answers(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), field.type) for column, field in zip(zip(*done), types)], schema=types)

    return rows.select(key, "payload", "note").mapInArrow(call, f"{key} {kind}, {_ANSWER}")


def answer_problem() -> Column:
    """Why an answer is unusable, NULL when it meets its contract."""
    return (
        F.when(F.col("error").isNotNull(), F.lit("call"))
        .when(F.trim(F.coalesce("raw", F.lit(""))) == "", F.lit("empty"))
        .when(F.col("finish_reason") == "length", F.lit("length"))
        .when(F.size("violations") > 0, F.lit("contract"))
    )


#: Problems that earn a second attempt, by mode.
RETRIED = {"json_object": ["empty", "length", "contract"], "json_schema": ["length"]}


def retry_modes(results: DataFrame, modes: list[str]) -> DataFrame:
    """Adds ``retry_mode``: a row for each of the modes in which an answer earns a second attempt.

    Failed calls do not.  ``json_object`` retries any unusable answer,
    ``json_schema`` only a truncated one.
    """
    problem = answer_problem()
    earned = F.array(*[F.when(problem.isin(RETRIED[m]), F.lit(m)) for m in modes])
    # A filter on the problem itself would be moved below the contract and parse the answer again for each of its checks.
    return results.withColumn("retry_mode", F.explode_outer(earned)).filter("retry_mode IS NOT NULL")


def retry_rows(results: DataFrame, mode: str = "json_object") -> DataFrame:
    """Rows that earn a second attempt in one mode (see ``retry_modes``)."""
    return retry_modes(results, [mode]).drop("retry_mode")


def complete_stage(
    requests: DataFrame, provider: Provider, stage: str, mode: str = "json_object", system_prompt: str = "",
    retry_prompt: str = "", ledger: str | None = None,
) -> DataFrame:
    """Run a stage with one retry and check the answers against the contract.

    Answers are checkpointed before they are read twice: a call to a model is
    neither free nor repeatable, so it must not run again for a filter.  A retry
    tells the model what was wrong with the first answer.
    """
    parse = PARSERS[stage]
    first = parse(cut_lineage(run_stage(requests, provider, stage, system_prompt, ledger)))
    reason = F.concat_ws(" ", F.lit("\nThe previous answer was refused:"), answer_problem(), F.array_join("violations", ", "))
    again = requests.join(retry_rows(first, mode).select("id", reason.alias("note")), "id")
    second = parse(cut_lineage(run_stage(again, provider, stage, system_prompt + retry_prompt, ledger)))
    kept = first.join(second.select("id"), "id", "left_anti")
    return kept.unionByName(second).withColumn("problem", answer_problem())


def manual_override(rows: DataFrame) -> DataFrame:
    """A manual capture that was extracted is never ignored."""
    protected = (F.col("capture_mode") == "manual") & (F.col("capture_quality") != "failed")
    return rows.withColumn(
        "triage",
        F.when(protected & F.col("triage").isNotNull(), F.col("triage").withField("decision", F.lit("continue"))).otherwise(F.col("triage")),
    )


def advance_stage(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Apply stage results to running jobs.

    ``results``: analysis_id, decision (triage only), error.  An error fails
    the job and keeps its stage; an ignored content completes at once.
    """
    rows = jobs.join(
        results.select("analysis_id", "decision", F.col("error").alias("new_error"), F.lit(True).alias("has_result")),
        "analysis_id", "left",
    )
    active = (F.col("status") == "running") & F.coalesce("has_result", F.lit(False))
    failed = active & F.col("new_error").isNotNull()
    passed = active & F.col("new_error").isNull()
    next_stage = (
        F.when((F.col("stage") == "triage") & (F.col("decision") == "ignore"), "completed")
        .when(F.col("stage") == "triage", "analyze")
        .when(F.col("stage") == "analyze", "evaluate")
        .otherwise("completed")
    )
    stage = F.when(passed, next_stage).otherwise(F.col("stage"))
    done = passed & (stage == "completed")
    return rows.withColumns(
        {
            "stage": stage,
            "status": F.when(failed, "failed").when(done, "completed").otherwise(F.col("status")),
            "last_error": F.when(failed, F.col("new_error")).when(~done, F.col("last_error")),
        }
    ).drop("new_error", "decision", "has_result")


def pause_running(jobs: DataFrame, gate_is_open: Column) -> DataFrame:
    """Between stages: release jobs that may not go on; the analysis stays running."""
    stop = (
        (F.col("status") == "running") & (F.col("stage") != "completed")
        & F.col("immediate_requested_at").isNull() & ~gate_is_open
    )
    return jobs.withColumn("status", F.when(stop, F.lit("pending")).otherwise(F.col("status")))


def claim_jobs(jobs: DataFrame, claimed: DataFrame) -> DataFrame:
    """Mark the selected jobs as running and count the attempt."""
    rows = jobs.join(claimed.select("job_id", F.lit(True).alias("claimed")), "job_id", "left")
    return (
        rows.withColumn("attempts", F.col("attempts") + F.when(F.col("claimed"), 1).otherwise(0))
        .withColumn("status", F.when(F.col("claimed"), F.lit("running")).otherwise(F.col("status")))
        .drop("claimed")
    )


_RESET = ["triage", "content_analysis", "personal_evaluation", "source_hash", "section_index", "model", "completed_at"]


def retry_failed(analyses: DataFrame, jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put failed analyses back to the start; others are left as they are."""
    chosen = (
        analyses.filter(F.col("status") == "failed")
        .select("analysis_id")
        .join(ids.select("analysis_id").distinct(), "analysis_id", "left_semi")
        .withColumn("again", F.lit(True))
    )
    rows = analyses.join(chosen, "analysis_id", "left")
    again = F.coalesce("again", F.lit(False))
    cleared = {c: F.when(~again, F.col(c)) for c in _RESET if c in analyses.columns}
    if "prompt_version" in analyses.columns:
        cleared["prompt_version"] = F.when(again, F.lit("unimplemented")).otherwise(F.col("prompt_version"))
    new_analyses = rows.withColumns(
        {**cleared, "status": F.when(again, F.lit("pending")).otherwise(F.col("status"))}
    ).drop("again")
    queued = jobs.join(chosen, "analysis_id", "left")
    new_jobs = queued.withColumns(
        {
            "stage": F.when(again, F.lit("triage")).otherwise(F.col("stage")),
            "status": F.when(again, F.lit("pending")).otherwise(F.col("status")),
            "immediate_requested_at": F.when(~again, F.col("immediate_requested_at")),
            **({"last_error": F.when(~again, F.col("last_error"))} if "last_error" in jobs.columns else {}),
        }
    ).drop("again")
    return new_analyses, new_jobs


def run_now(analyses: DataFrame, jobs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Ask for immediate work on pending or running analyses; repeating it changes nothing."""
    chosen = (
        analyses.filter(F.col("status").isin("pending", "running"))
        .select("analysis_id")
        .join(ids.select("analysis_id").distinct(), "analysis_id", "left_semi")
        .withColumn("asked", F.lit(True))
    )
    asked = F.coalesce("asked", F.lit(False))
    return jobs.join(chosen, "analysis_id", "left").withColumn(
        "immediate_requested_at", F.when(asked, F.coalesce("immediate_requested_at", now)).otherwise(F.col("immediate_requested_at"))
    ).drop("asked")


def request_id(markdown: Column, stage: str) -> Column:
    """Deterministic id of a stage request: the same text is never asked twice."""
    return F.sha2(F.concat(F.lit(f"{stage}|"), source_hash(markdown)), 256)
