"""Block-wise translation: requests, batches, checks, progress.

A translation is one row per content and language with its blocks as an array,
so batches are cut inside the row and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.core import let, nonempty
from ..functions.text import detect_language, missing_tokens, source_hash
from ..schemas import BATCH_MAX_BLOCKS, BATCH_MAX_CHARS, TARGET_LANGUAGE
from .guided import join_blocks


def count_translatable(blocks: Column) -> Column:
    return F.size(F.filter(blocks, lambda b: b["translatable"]))


def count_completed(blocks: Column) -> Column:
    return F.size(
        F.filter(blocks, lambda b: b["translatable"] & nonempty(b["translated_markdown"]).isNotNull())
    )


def translation_requests(contents: DataFrame, translations: DataFrame) -> DataFrame:
    """What a translation request does to each content: ``action`` and the resulting row.

    ``already_chinese``, ``unsupported`` and ``nothing_to_translate`` refuse;
    ``create`` and ``reset`` start from fresh blocks; ``resume`` keeps the done
    blocks of a failed one; ``unchanged`` leaves the row alone.
    """
    stored = translations.filter(F.col("target_language") == TARGET_LANGUAGE).select(
        "content_id",
        F.col("source_hash").alias("stored_hash"),
        F.col("status").alias("stored_status"),
        F.col("blocks").alias("stored_blocks"),
    )
    rows = (
        contents.select("content_id", "markdown")
        .withColumn("source_language", detect_language(F.col("markdown")))
        .withColumn("current_hash", source_hash(F.col("markdown")))
        .withColumn("fresh_blocks", md.split_blocks(F.col("markdown")))
        .withColumn("fresh_total", count_translatable(F.col("fresh_blocks")))
        .join(stored, "content_id", "left")
    )
    language = F.lower("source_language")
    missing = F.col("stored_hash").isNull()
    changed = F.col("stored_hash") != F.col("current_hash")
    action = (
        F.when(F.startswith(language, F.lit("zh")), "already_chinese")
        .when(~F.startswith(language, F.lit("en")), "unsupported")
        .when((missing | changed) & (F.col("fresh_total") == 0), "nothing_to_translate")
        .when(missing, "create")
        .when(changed, "reset")
        .when(F.col("stored_status") == "failed", "resume")
        .otherwise("unchanged")
    )
    rows = rows.withColumn("action", action)
    fresh = F.col("action").isin("create", "reset")
    blocks = F.when(fresh, F.col("fresh_blocks")).otherwise(F.col("stored_blocks"))
    status = F.when(fresh | (F.col("action") == "resume"), F.lit("pending")).otherwise(F.col("stored_status"))
    return rows.select(
        "content_id",
        "action",
        "source_language",
        F.lit(TARGET_LANGUAGE).alias("target_language"),
        F.when(fresh, F.col("current_hash")).otherwise(F.col("stored_hash")).alias("source_hash"),
        status.alias("status"),
        blocks.alias("blocks"),
    ).withColumns(
        {
            "total_blocks": count_translatable(F.col("blocks")),
            "completed_blocks": count_completed(F.col("blocks")),
        }
    )


def translation_queue(translations: DataFrame, k: int) -> DataFrame:
    return (
        translations.filter(F.col("status") == "pending").orderBy("created_at", "content_id").limit(k)
    )


def batch_bounds(blocks: Column, max_blocks: int = BATCH_MAX_BLOCKS, max_chars: int = BATCH_MAX_CHARS) -> Column:
    """Greedy cut of the open blocks: ``array<struct<start,n>>``, positions from 1.

    The fold keeps the open batch in scalars and appends once per closed batch.
    """
    lengths = F.transform(blocks, lambda b: F.length(b["source_markdown"]))
    state = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(1).alias("start"),
        F.array().cast("array<struct<start: int, n: int>>").alias("done"),
    )

    def step(acc: Column, length: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] >= max_blocks) | (acc["chars"] + length > max_chars))
        closed = F.array(F.struct(acc["start"].alias("start"), acc["n"].alias("n")))
        return F.struct(
            F.when(full, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
            F.when(full, length).otherwise(acc["chars"] + length).alias("chars"),
            F.when(full, acc["start"] + acc["n"]).otherwise(acc["start"]).alias("start"),
            F.when(full, F.concat(acc["done"], closed)).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["start"].alias("start"), acc["n"].alias("n")))
        return F.when(acc["n"] > 0, F.concat(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(lengths, state, step, finish)


def pack_batches(translations: DataFrame, key: str = "content_id") -> DataFrame:
    """One row per batch: key, batch_no, blocks (in order)."""
    open_blocks = F.filter(
        "blocks", lambda b: b["translatable"] & nonempty(b["translated_markdown"]).isNull()
    )
    opened = translations.select(key, open_blocks.alias("open"))
    cut = opened.select(key, "open", F.posexplode(batch_bounds(F.col("open"))).alias("position", "bound"))
    return cut.select(
        key,
        (F.col("position") + 1).alias("batch_no"),
        F.slice("open", F.col("bound.start"), F.col("bound.n")).alias("blocks"),
    )


def batch_payload(batches: DataFrame) -> DataFrame:
    """Adds ``payload``: the JSON a translation model receives."""
    blocks = F.transform(
        "blocks", lambda b: F.struct(b["id"].alias("id"), b["source_markdown"].alias("markdown"))
    )
    return batches.withColumn(
        "payload", F.to_json(F.struct(F.lit(TARGET_LANGUAGE).alias("target_language"), blocks.alias("blocks")))
    )


RESULT_DDL = "translations array<struct<id: string, translated_markdown: string>>"


def check_batch(answered: DataFrame) -> DataFrame:
    """Adds ``problem``: why a batch answer is refused, NULL when it is accepted.

    ``answered``: blocks, result (array of id and translated_markdown).
    """
    def judge(s: Column) -> Column:
        changed = F.exists(
            F.zip_with("blocks", "result", lambda b, r: F.size(missing_tokens(b["source_markdown"], r["translated_markdown"]))),
            lambda n: n > 0,
        )
        bad_text = F.exists("result", lambda r: nonempty(r["translated_markdown"]).isNull())
        bad_id = F.exists("result", lambda r: F.coalesce(F.length(r["id"]), F.lit(0)).between(1, 32) == F.lit(False))
        size = F.size(s["given"])
        return (
            F.when(F.col("result").isNull() | (size == 0) | (size > BATCH_MAX_BLOCKS), "size")
            .when(bad_text | bad_id, "field")
            .when(F.size(F.array_distinct(s["given"])) < size, "duplicate_id")
            .when(s["given"] != s["wanted"], "id_mismatch")
            .when(changed, "protected_tokens")
        )

    ids = F.struct(
        F.transform("result", lambda r: r["id"]).alias("given"),
        F.transform("blocks", lambda b: b["id"]).alias("wanted"),
    )
    return answered.withColumn("problem", let(ids, judge))


def _map_of(result: Column) -> Column:
    return F.map_from_entries(
        F.transform(result, lambda r: F.struct(r["id"].alias("k"), r["translated_markdown"].alias("v")))
    )


def merge_translations(translations: DataFrame, answered: DataFrame, key: str = "content_id") -> DataFrame:
    """Write accepted answers into the blocks by id and count progress again.

    ``answered``: key, result, problem.  A translation's answers are at most as
    long as its own blocks, which already live in one row.
    """
    accepted = (
        answered.filter(F.col("problem").isNull())
        .groupBy(key)
        .agg(F.flatten(F.collect_list("result")).alias("answers"))
    )
    blocks = let(
        _map_of(F.coalesce("answers", F.array().cast("array<struct<id: string, translated_markdown: string>>"))),
        lambda answers: F.transform(
            "blocks",
            lambda b: b.withField(
                "translated_markdown", F.coalesce(F.try_element_at(answers, b["id"]), b["translated_markdown"])
            ),
        ),
    )
    return (
        translations.join(accepted, key, "left")
        .withColumn("blocks", blocks)
        .withColumn("completed_blocks", count_completed(F.col("blocks")))
        .withColumn("total_blocks", count_translatable(F.col("blocks")))
        .drop("answers")
    )


def finish_translation(translations: DataFrame) -> DataFrame:
    """Close running translations: completed only when every block is done.

    ``error`` holds the message of a refused batch or NULL.  Done blocks stay.
    """
    running = F.col("status") == "running"
    whole = F.col("completed_blocks") == F.col("total_blocks")
    message = F.coalesce(
        F.col("error"), F.format_string("翻译块未全部完成：%d/%d", "completed_blocks", "total_blocks")
    )
    success = F.col("error").isNull() & whole
    return translations.withColumn(
        "last_error", F.when(running & ~success, message)
    ).withColumn(
        "status",
        F.when(running & success, F.lit("completed")).when(running, F.lit("failed")).otherwise(F.col("status")),
    )


def translation_progress(translations: DataFrame, key: str = "content_id") -> DataFrame:
    return translations.select(
        key,
        count_translatable(F.col("blocks")).alias("total_blocks"),
        count_completed(F.col("blocks")).alias("completed_blocks"),
    )


def align_blocks(rows: DataFrame) -> DataFrame:
    """Give stored blocks the line ranges of the current text, if all of them match it.

    ``rows``: markdown, blocks.  Adds ``shared`` to every block.
    """
    current = md.split_blocks(F.col("markdown"))

    def merge(fresh: Column) -> Column:
        same = (F.size(fresh) == F.size("blocks")) & F.forall(
            F.zip_with(
                "blocks", fresh,
                lambda b, f: b["id"].eqNullSafe(f["id"]) & b["source_markdown"].eqNullSafe(f["source_markdown"]),
            ),
            lambda hit: hit,
        )

        def shown(b: Column, start: Column, end: Column) -> Column:
            return F.struct(
                b["id"].alias("id"), b["kind"].alias("kind"), b["source_markdown"].alias("source_markdown"),
                b["translated_markdown"].alias("translated_markdown"), (~b["translatable"]).alias("shared"),
                start.alias("start_line"), end.alias("end_line"),
            )

        aligned = F.zip_with("blocks", fresh, lambda b, f: shown(b, f["start_line"], f["end_line"]))
        return F.when(same, aligned).otherwise(
            F.transform("blocks", lambda b: shown(b, b["start_line"], b["end_line"]))
        )

    return rows.withColumn("blocks", let(current, merge))


def assemble_document(translations: DataFrame) -> DataFrame:
    return translations.withColumn("document", join_blocks(F.col("blocks")))
