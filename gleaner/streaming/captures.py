"""Capture feed: files → checked captures → append-only log → current contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import source_hash
from ..operators.contents import identity_url, opening_work, upsert_captures, validate_capture
from ..operators.extraction.pages import extract_pages
from ..session import cut_lineage
from ..sources.captures import capture_extractions, flatten_captures, parse_captures
from ..sources.store import Manifest, append, bucket, commit, read_appended, read_buckets, read_manifest, write_buckets
from ..sources.tables import complete_numbers

CAPTURE_COLUMNS = [
    "capture_id", "source_type", "source_url", "canonical_url", "title", "author", "markdown", "capture_mode",
    "capture_quality", "payload", "captured_at", "arrival",
]


def capture_stream(
    spark: SparkSession, source: str, log: str, quarantine: str, checkpoint: str, watermark: str = "1 hour"
) -> StreamingQuery:
    """Append every new capture to a log, refused lines to a quarantine folder.

    An identical replay (the same whole line) within the watermark is dropped,
    refused lines are all kept.  ``arrival`` orders captures of one batch by the
    time and path of their file, then by the line's hash.  A batch writes its own folder in overwrite mode, so a batch that runs again
    after a failure replaces its output instead of doubling it.
    """
    digest = source_hash(F.col("value"))
    lines = spark.readStream.format("text").load(source).select(
        "value", F.current_timestamp().alias("captured_at"), digest.alias("_hash"),
        F.concat_ws("|", F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSS"), "_metadata.file_path", digest).alias("arrival"),
    )
    checked = validate_capture(parse_captures(lines))
    # Refused lines go past the deduplication: they are all kept and leave nothing in its state.
    good = checked.filter(F.size("violations") == 0).withWatermark("captured_at", watermark).dropDuplicatesWithinWatermark(["_hash"])
    keyed = good.unionByName(checked.filter(F.size("violations") > 0)).drop("_hash")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good = batch.filter(F.size("violations") == 0).drop("violations")
            flatten_captures(good).select(*CAPTURE_COLUMNS).write.mode("overwrite").parquet(f"{log}/batch={batch_id:012d}")
            bad = batch.filter(F.size("violations") > 0).select(
                F.coalesce("corrupt", F.to_json("envelope")).alias("line"), "violations", "captured_at"
            )
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id:012d}")
        finally:
            batch.unpersist()

    return (
        keyed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


CONTENTS = (
    "content_id string, capture_id string, source_type string, source_url string, canonical_url string, title string, "
    "author string, markdown string, capture_quality string, payload string, capture_mode string, created_at timestamp, updated_at timestamp"
)
CAPTURE_IDS = "capture_id string, home int"
ANALYSES = "analysis_id string, content_id string, status string, created_at timestamp"
JOBS = (
    "job_id string, analysis_id string, stage string, status string, attempts int, immediate_requested_at timestamp, created_at timestamp"
)


def fold_captures(spark: SparkSession, log: str, store: str, buckets: int = 64) -> Manifest:
    """Merge the logged batches that the store does not hold yet; returns the manifest that is current then.

    Contents lie in buckets of their page identity. A second table, in buckets of the
    capture id, names the bucket in which a capture's content lives. A merge opens and
    rewrites the buckets of the captured pages and ids only. Contents, ids, new analyses
    and jobs and the number of the last batch become current in one commit, so nothing is
    half folded after a failure, and a batch is never folded twice.
    """
    held = read_manifest(spark, store, buckets)
    numbers = [n for n in complete_numbers(spark, log, "batch") if n > held.folded]
    if not numbers:
        return held
    logged = spark.read.parquet(*[f"{log}/batch={n:012d}" for n in numbers])
    return merge_captures(logged, store, held, numbers[-1])


def merge_captures(captures: DataFrame, store: str, held: Manifest, folded: int) -> Manifest:
    """One merge of captures into the store over the manifest ``held``."""
    spark, count = captures.sparkSession, held.count
    page, id_bucket = bucket(count, "source_type", "canonical_url"), bucket(count, "capture_id")
    keys = captures.select("capture_id", "source_type", identity_url().alias("canonical_url")).select("capture_id", page.alias("page"), id_bucket.alias("ids"))
    # At most ``count`` numbers each.
    ids = {r[0] for r in keys.select("ids").distinct().collect()}
    known = read_buckets(spark, store, held, "capture_ids", CAPTURE_IDS, ids)
    homes = {r[0] for r in known.join(keys.select("capture_id"), "capture_id", "left_semi").select("home").distinct().collect()}
    pages = homes | {r[0] for r in keys.select("page").distinct().collect()}
    current = read_buckets(spark, store, held, "contents", CONTENTS, pages)
    merged = upsert_captures(captures, current)["contents"]
    filled = write_buckets(merged, store, held, "contents", page)
    written = read_buckets(spark, store, Manifest(held.version + 1, count, {"contents": dict.fromkeys(filled, held.version + 1)}), "contents", CONTENTS)

    placed = written.select("capture_id", page.alias("home")).filter(id_bucket.isin(sorted(ids)))
    placed = placed.groupBy("capture_id").agg(F.max("home").alias("home"))
    index = known.join(placed, "capture_id", "left_anti").unionByName(placed)
    filled_ids = write_buckets(index, store, held, "capture_ids", id_bucket)
    analyses, jobs = opening_work(written.join(current.select("content_id"), "content_id", "left_anti"))
    appended = [append(analyses, store, held, "analyses"), append(jobs, store, held, "jobs")]
    after = held.after(folded, {"contents": (pages, filled), "capture_ids": (ids, filled_ids)}, appended)
    commit(spark, store, after)
    return after


def read_contents(spark: SparkSession, store: str) -> DataFrame:
    return read_buckets(spark, store, read_manifest(spark, store), "contents", CONTENTS)


def read_opened(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Analyses and jobs as they were opened, one for each content."""
    held = read_manifest(spark, store)
    return read_appended(spark, store, held, "analyses", ANALYSES), read_appended(spark, store, held, "jobs", JOBS)


def capture_pages(
    pages: DataFrame, contents: DataFrame, rules: DataFrame | None = None, captured_at: Column | None = None, whole_page: bool = False
) -> dict[str, DataFrame]:
    """Pages → extraction → envelopes → contract check → contents, as one job.

    Gives what ``upsert_captures`` gives, and ``refused``: envelopes that break the
    contract, with their violations. Pages without a text are no captures.
    """
    lines = cut_lineage(capture_extractions(extract_pages(pages, rules, captured_at, whole_page)))  # extraction is dear, and read twice
    checked = validate_capture(parse_captures(lines))
    good = flatten_captures(checked.filter(F.size("violations") == 0).drop("violations"))
    refused = checked.filter(F.size("violations") > 0).select("page_id", F.coalesce("corrupt", F.to_json("envelope")).alias("line"), "violations")
    return upsert_captures(good, contents) | {"refused": refused}
