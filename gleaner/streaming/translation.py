"""Pending translations, worked off per micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stages import Provider, run_stage
from ..operators.translation import (
    RESULT_DDL, batch_payload, check_batch, finish_translation, merge_translations, pack_batches,
)
from ..session import cut_lineage


def translate(translations: DataFrame, provider: Provider) -> DataFrame:
    """Translate the open blocks of running translations and close them.

    A refused or failed batch fails its translation; accepted batches stay, so
    the next attempt sends only what is still open.
    """
    batches = batch_payload(pack_batches(translations)).withColumn("id", F.concat_ws("#", "content_id", "batch_no"))
    # A model call must not run again for a second reader of the answers.
    answers = cut_lineage(run_stage(batches.select("id", "payload"), provider, "translate"))
    parsed = F.from_json("raw", RESULT_DDL)["translations"]
    joined = batches.select("id", "content_id", "batch_no", "blocks").join(answers, "id")
    checked = check_batch(joined.withColumn("result", parsed))
    checked = checked.withColumn("problem", F.coalesce("error", "problem"))
    errors = checked.groupBy("content_id").agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("batch_no"))).alias("error"))
    merged = merge_translations(translations, checked).join(errors, "content_id", "left")
    return finish_translation(merged)


def translation_stream(
    spark: SparkSession, pending: DataFrame, provider: Provider, out: str, checkpoint: str
) -> StreamingQuery:
    """Write the finished state of each micro-batch of pending translations."""

    def write(batch: DataFrame, batch_id: int) -> None:
        running = batch.filter(F.col("status") == "pending").withColumn("status", F.lit("running"))
        translate(running, provider).write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    return pending.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class UpperProvider:
    """Deterministic stand-in: answers each block with its text behind a mark."""

    model = "upper-1"

    def complete(self, system_prompt: str, user_prompt: str, stage: str) -> tuple[str, str]:
        blocks = json.loads(user_prompt)["blocks"]
        done = [{"id": b["id"], "translated_markdown": "T: " + b["markdown"]} for b in blocks]
        return json.dumps({"translations": done}, ensure_ascii=False), "stop"
