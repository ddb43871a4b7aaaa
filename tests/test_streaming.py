import json
import os
import random
import sys
import tempfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.functions import markdown as md
from gleaner.operators.feedback import confusion_matrix, feedback_fold
from gleaner.schemas import CAPTURE_SCHEMA_VERSION
from gleaner.sources.tables import read_snapshot
from gleaner.streaming import calibration, captures, stages, translation

# The providers below live in this file, which the workers cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="gleaner-test-")


def envelope(capture_id, url, text, quality="good"):
    return json.dumps({
        "schema_version": CAPTURE_SCHEMA_VERSION, "capture_id": capture_id,
        "source": {"type": "web", "url": url, "title": "T"}, "document": {"format": "markdown", "text": text, "units": []},
        "capture": {"mode": "manual", "producer": "p", "producer_version": "1", "quality": {"level": quality, "warnings": []}, "extraction_engine": "e"},
    })


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_capture_feed(spark, folder):
    source, log, bad, ckpt, contents = (f"{folder}/{n}" for n in ("in", "log", "bad", "ckpt", "contents"))
    write_lines(source, "1.txt", [
        envelope("capture-1", "https://e.org/a?utm_source=x", "one"),
        envelope("capture-1", "https://e.org/a?utm_source=x", "one"),
        envelope("capture-2", "https://e.org/b", "two", "failed"),
        envelope("short", "https://e.org/c", "three"),
        "{broken",
    ])
    captures.capture_stream(spark, source, log, bad, ckpt).awaitTermination()
    assert spark.read.parquet(log).count() == 2
    assert spark.read.parquet(bad).count() == 2
    captures.fold_captures(spark, log, contents)
    rows = {r.canonical_url: r for r in captures.read_contents(spark, contents).collect()}
    assert set(rows) == {"https://e.org/a"}, "a failed new capture is refused"
    first_id = rows["https://e.org/a"].content_id

    # The same page under another id and address updates the content, also when it failed.
    write_lines(source, "2.txt", [envelope("capture-9", "https://e.org/a/?from=inbox#top", "newer", "failed")])
    captures.capture_stream(spark, source, log, bad, ckpt).awaitTermination()
    captures.fold_captures(spark, log, contents)
    (row,) = captures.read_contents(spark, contents).collect()
    assert (row.content_id, row.capture_id, row.markdown, row.capture_quality) == (first_id, "capture-1", "newer", "failed")
    assert json.loads(row.payload)["document"]["text"] == "newer", "the envelope is replaced with the text"
    # Nothing new to fold: no new version.
    held = captures.fold_captures(spark, log, contents)
    assert captures.read_contents(spark, contents).select("content_id", "markdown").collect() == [(first_id, "newer")]
    assert held.version == 2


def test_capture_feed_keeps_changes_and_refused_lines(spark, folder):
    source, log, bad, ckpt, contents = (f"{folder}/{n}" for n in ("in", "log", "bad", "ckpt", "contents"))
    line = envelope("capture-1", "https://e.org/a", "one")
    write_lines(source, "1.txt", [line, line, envelope("capture-2", "https://e.org/b", "two"), "{broken", "{broken", "[]"])
    captures.capture_stream(spark, source, log, bad, ckpt).awaitTermination()
    assert spark.read.parquet(log).count() == 2
    assert spark.read.parquet(bad).count() == 3, "refused lines are not collapsed"
    # The same text under a new title is no replay.
    write_lines(source, "2.txt", [line.replace('"title": "T"', '"title": "New"')])
    captures.capture_stream(spark, source, log, bad, ckpt).awaitTermination()
    os.makedirs(f"{log}/batch=000000000099")  # a batch that was never finished
    seen = []
    for _ in range(2):
        captures.fold_captures(spark, log, contents)
        stored = captures.read_contents(spark, contents).orderBy("canonical_url")
        seen.append([(r.title, r.markdown) for r in stored.collect()])
        analyses, jobs = captures.read_opened(spark, contents)
        assert (analyses.join(stored, "content_id").count(), jobs.join(analyses, "analysis_id").count()) == (2, 2)
    assert seen[0] == seen[1] == [("New", "one"), ("T", "two")]


def test_two_versions_of_one_capture_in_one_batch(spark, folder):
    source, log, bad, ckpt, contents = (f"{folder}/{n}" for n in ("in", "log", "bad", "ckpt", "contents"))
    for number, text in ((1, "older"), (2, "newer")):
        write_lines(source, f"{number}.txt", [envelope("capture-1", "https://e.org/a", text)])
        os.utime(f"{source}/{number}.txt", (1_700_000_000 + number,) * 2)
    captures.capture_stream(spark, source, log, bad, ckpt).awaitTermination()
    captures.fold_captures(spark, log, contents)
    assert [r.markdown for r in captures.read_contents(spark, contents).collect()] == ["newer"]


EVENTS = "analysis_id string, event_id long, kind string, stage string, decision string, source_hash string"


def feed_stages(spark, folder, rows, **options):
    """One batch of events through the stage stream; all transitions so far, in order of their events."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stages.ROCKSDB)
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    events = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
    stream = stages.stage_stream(events, **options).writeStream.format("parquet").option("path", f"{folder}/out")
    stream.option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r.analysis_id, r.event_id, r.stage, r.status, r.source_hash, r.note) for r in found)


def test_late_event_is_noted(spark, folder):
    feed_stages(spark, folder, [("a", 1, "capture", None, None, "h"), ("a", 3, "result", "triage", "continue", "h")], skip_gaps=True)
    got = feed_stages(spark, folder, [("a", 2, "pause", None, None, None)], skip_gaps=True)
    assert [(n, stage, note) for _, n, stage, _, _, note in got] == [(1, "triage", "created"), (2, "analyze", "late"), (3, "analyze", "advanced")]


def test_events_in_any_order(spark, folder):
    rng = random.Random(6)
    kinds = [("capture", None, None), ("result", "triage", "continue"), ("result", "analyze", None), ("pause", None, None), ("error", None, None), ("retry", None, None)]
    rows = [(key, n + 1, *rng.choice(kinds), rng.choice(["h1", "h1", "h2"])) for key in "abc" for n in range(60)]
    state, want = {}, []
    for key, n, kind, stage, decision, source_hash in rows:
        state[key], note = stages.apply_event(state.get(key, ("triage", "pending", None)), stages.Event(kind, stage, decision, source_hash))
        want.append((key, n, *state[key], note))
    rng.shuffle(rows)
    for part in (rows[:70], rows[70:120], rows[120:]):
        got = feed_stages(spark, folder, part)
    assert got == sorted(want), "the transitions of the ordered events"


def test_calibration_feed(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stages.ROCKSDB)
    schema = "event_id long, analysis_id string, ts timestamp, ai_recommendation string, preferred_recommendation string"
    source, every = f"{folder}/in", []

    def add(rows):
        every.extend(rows)
        df = spark.createDataFrame(rows, "event_id long, analysis_id string, ts string, ai_recommendation string, preferred_recommendation string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        calibration.calibration_stream(spark, events, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
        found = {tuple(r) for r in read_snapshot(spark, f"{folder}/out").collect()}
        whole = confusion_matrix(feedback_fold(spark.read.schema(schema).parquet(source)))
        assert found == {tuple(r) for r in whole.collect()}, "the batch result"
        return found

    add([(1, "a", "2024-01-01 00:00:00", "ignore", "ignore"), (2, "b", "2024-01-01 00:00:01", "deep_read", "ignore")])
    assert run() == {("ignore", "ignore", 1), ("deep_read", "ignore", 1)}
    # A correction moves the count; the model's side stays frozen.
    add([(3, "a", "2024-01-01 00:00:02", "deep_read", "selective_read")])
    assert run() == {("ignore", "selective_read", 1), ("deep_read", "ignore", 1)}
    # Replays change nothing; a late first event changes the model's side; an unknown level leaves the matrix.
    add([(3, "a", "2024-01-01 00:00:02", "deep_read", "selective_read"), (1, "a", "2024-01-01 00:00:00", "ignore", "ignore")])
    assert run() == {("ignore", "selective_read", 1), ("deep_read", "ignore", 1)}
    add([(0, "b", "2023-12-31 00:00:00", "summary_enough", "deep_read"), (9, "a", "2024-01-02 00:00:00", "ignore", None), (4, None, None, "ignore", "ignore")])
    assert run() == {("summary_enough", "ignore", 1), ("ignore", "ignore", 1)}
    rng, levels = random.Random(3), ["ignore", "summary_enough", "selective_read", "deep_read", "odd", None]
    for part in range(2):
        add([(100 * part + k, rng.choice("abcdefgh"), f"2024-02-0{rng.randrange(1, 9)} 00:00:00", rng.choice(levels), rng.choice(levels)) for k in range(60)])
    run()
    assert not os.path.exists(f"{folder}/state")


def test_stage_machine(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stages.ROCKSDB)
    rows = [
        ("a", 1, "capture", None, None, "h1"), ("a", 2, "result", "triage", "continue", "h1"), ("a", 3, "capture", None, None, "h2"),
        ("a", 4, "result", "analyze", None, "h1"), ("a", 5, "result", "triage", "continue", "h2"), ("a", 6, "pause", None, None, None),
        ("a", 7, "result", "analyze", None, "h2"), ("a", 8, "result", "evaluate", None, "h2"), ("a", 9, "error", None, None, "h2"),
        ("b", 1, "capture", None, None, "x"), ("b", 2, "result", "triage", "ignore", "x"),
        ("c", 1, "capture", None, None, "y"), ("c", 2, "error", None, None, "y"), ("c", 3, "retry", None, None, None),
    ]
    schema = "analysis_id string, event_id long, kind string, stage string, decision string, source_hash string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    events = spark.readStream.schema(schema).parquet(f"{folder}/in")
    query = (
        stages.stage_stream(events).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.analysis_id, r.event_id): (r.stage, r.status, r.note) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got[("a", 3)] == ("triage", "pending", "restarted")
    assert got[("a", 4)] == ("triage", "pending", "stale result")
    assert got[("a", 6)] == ("analyze", "pending", "paused")
    assert got[("a", 8)] == ("completed", "completed", "advanced")
    assert got[("a", 9)] == ("completed", "completed", "ignored")
    assert got[("b", 2)] == ("completed", "completed", "advanced")
    assert got[("c", 3)] == ("triage", "pending", "retried")


class Flaky(translation.UpperProvider):
    def complete(self, system_prompt, user_prompt, stage):
        if "fail here" in user_prompt:
            raise TimeoutError("slow")
        return super().complete(system_prompt, user_prompt, stage)


def test_translation_feed(spark, folder):
    text = "\n\n".join(f"paragraph {k}" for k in range(30))
    rows = [("good", text), ("bad", text + "\n\nfail here")]
    docs = spark.createDataFrame(rows, "content_id string, markdown string").select(
        "content_id", F.lit("pending").alias("status"), md.split_blocks(F.col("markdown")).alias("blocks")
    )
    docs.write.parquet(f"{folder}/in")
    pending = spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
    translation.translation_stream(spark, pending, Flaky(), f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    got = {r.content_id: r for r in spark.read.parquet(f"{folder}/out").collect()}
    assert (got["good"].status, got["good"].completed_blocks, got["good"].last_error) == ("completed", 30, None)
    assert got["bad"].status == "failed" and got["bad"].last_error.startswith("TimeoutError")
    assert got["bad"].completed_blocks == 24, "the two finished batches stay"
