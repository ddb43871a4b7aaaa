"""Feedback folding and calibration statistics.

All are aggregates with map-side combination; the largest group state is one
struct, however many events a single analysis or level pair receives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MIN_CALIBRATION_FEEDBACK, RECOMMENDATIONS, recommendation_rank

SUMMARY_ISSUES = ["omission", "misleading"]

# Candidate rules (id, title, proposed rule), in reporting order.
SUGGESTIONS = {
    "split_recommendation_context": (
        "按场景拆分阅读投入标准",
        "不要整体调高或调低阅读投入；分别检查知识重复、证据强度和探索价值。",
    ),
    "reduce_over_recommendation": (
        "降低过度投入建议",
        "知识重叠高且没有明确新增信息时，阅读投入最高为“摘要即可”。",
    ),
    "protect_under_recommendation": (
        "减少低估高价值内容",
        "存在关键新知识、强反方观点或高探索价值时，不应仅因主题低相关而降低投入。",
    ),
    "protect_ignore_boundary": (
        "收紧“可以忽略”的边界",
        "只有低内在价值且低探索价值时才建议忽略；不确定时至少保留为摘要即可。",
    ),
    "preserve_summary_evidence": (
        "加强摘要的证据与限制保留",
        "摘要必须保留原文的重要限制、反方观点和未验证主张。",
    ),
}
EVIDENCE = {
    "split_recommendation_context": "%2$d 次建议偏高，同时有 %3$d 次建议偏低。",
    "reduce_over_recommendation": "%1$d 条有效反馈中有 %2$d 次建议偏高。",
    "protect_under_recommendation": "%1$d 条有效反馈中有 %3$d 次建议偏低。",
    "protect_ignore_boundary": "有 %4$d 篇被建议忽略的内容被用户修正为值得阅读。",
    "preserve_summary_evidence": "有 %5$d 条反馈指出摘要存在遗漏或误导。",
}


def accuracy(ai: Column, preferred: Column) -> Column:
    """Direction of the advice against the reader's choice."""
    a, p = recommendation_rank(ai), recommendation_rank(preferred)
    return F.when(a > p, F.lit("too_high")).when(a < p, F.lit("too_low")).when(a == p, F.lit("accurate"))


FROZEN = ["ai_recommendation", "model", "prompt_version", "snapshot"]
EDITABLE = [
    "preferred_recommendation", "time_worthwhile", "new_knowledge", "summary_quality", "key_takeaway",
]


def feedback_fold(events: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """One feedback row per analysis out of an append-only log of edits.

    The first event freezes what the model said, the last one supplies the
    reader's answers.  With ``analyses``, only completed ones take feedback.
    """
    if analyses is not None:
        done = analyses.filter(F.col("status") == "completed").select("analysis_id")
        events = events.join(done, "analysis_id", "left_semi")
    frozen = [c for c in FROZEN if c in events.columns]
    editable = [c for c in EDITABLE if c in events.columns]
    position = F.struct("ts", "event_id")
    folded = events.groupBy("analysis_id").agg(
        F.min_by(F.struct(*frozen, F.col("ts").alias("created_at")), position).alias("first"),
        F.max_by(F.struct(*editable, F.col("ts").alias("updated_at")), position).alias("last"),
    )
    rows = folded.select(
        "analysis_id",
        *[F.col(f"first.{c}").alias(c) for c in [*frozen, "created_at"]],
        *[F.col(f"last.{c}").alias(c) for c in [*editable, "updated_at"]],
    )
    return rows.withColumn(
        "recommendation_accuracy", accuracy(F.col("ai_recommendation"), F.col("preferred_recommendation"))
    )


def is_eligible() -> Column:
    return F.col("ai_recommendation").isin(RECOMMENDATIONS) & F.col("preferred_recommendation").isin(RECOMMENDATIONS)


def calibration_stats(feedback: DataFrame, analyses: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One row of counts; distances count eligible rows only."""
    ok = is_eligible()
    distance = F.abs(
        recommendation_rank(F.col("ai_recommendation")) - recommendation_rank(F.col("preferred_recommendation"))
    )
    direction = F.col("recommendation_accuracy")
    missed = (F.col("ai_recommendation") == "ignore") & (
        (direction == "too_low") | (F.col("time_worthwhile") == "yes")
    )
    needed = F.greatest(F.lit(0).cast("bigint"), F.lit(MIN_CALIBRATION_FEEDBACK) - F.count_if(ok))
    completed = analyses.filter(F.col("status") == "completed").agg(F.count("*").alias("n"))
    stats = feedback.agg(
        F.count("*").alias("feedback_count"),
        F.count_if(direction == "accurate").alias("accurate_count"),
        F.count_if(direction == "too_high").alias("too_high_count"),
        F.count_if(direction == "too_low").alias("too_low_count"),
        accuracy_rate_of(direction).alias("accuracy_rate"),
        F.count_if(F.col("summary_quality").isin(SUMMARY_ISSUES)).alias("summary_issue_count"),
        F.count_if(missed).alias("high_value_miss_count"),
        needed.alias("feedback_needed"),
        F.count_if(ok & (distance == 1)).alias("adjacent_error_count"),
        F.count_if(ok & (distance >= 2)).alias("major_error_count"),
    ).withColumn("completed_analyses", completed.scalar())
    if profile is None:
        return stats
    # One reader's row: Spark refuses a second one instead of taking either.
    return stats.withColumn("evaluation_mode", profile.select("evaluation_mode").scalar()).withColumn(
        "questionnaire_completed",
        profile.select(F.col("questionnaire_completed_at").isNotNull()).scalar(),
    )


def accuracy_rate_of(direction: Column) -> Column:
    """Percentage with one decimal, half to even; NULL without feedback."""
    n = F.count("*")
    rate = F.try_divide(F.count_if(direction == "accurate").cast("double"), n.cast("double")) * 100
    return F.bround(rate, 1)


def accuracy_rate(feedback: DataFrame) -> DataFrame:
    return feedback.agg(accuracy_rate_of(F.col("recommendation_accuracy")).alias("accuracy_rate"))


def confusion_matrix(feedback: DataFrame) -> DataFrame:
    """Counts of (model, reader) level pairs, non-zero cells only, in rank order."""
    return (
        feedback.filter(is_eligible())
        .groupBy("ai_recommendation", F.col("preferred_recommendation").alias("user_recommendation"))
        .agg(F.count("*").alias("count"))
        .orderBy(
            recommendation_rank(F.col("ai_recommendation")), recommendation_rank(F.col("user_recommendation"))
        )
    )


def confusion_grid(feedback: DataFrame) -> DataFrame:
    """Full four by four grid: one row per model level, one column per reader level."""
    spark = feedback.sparkSession
    levels = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(v) for v in RECOMMENDATIONS])).alias("rank", "ai_recommendation")
    )
    counted = (
        feedback.filter(is_eligible())
        .groupBy("ai_recommendation")
        .pivot("preferred_recommendation", RECOMMENDATIONS)
        .agg(F.count(F.lit(1)))
    )
    return (
        levels.join(counted, "ai_recommendation", "left")
        .na.fill(0, RECOMMENDATIONS)
        .select("ai_recommendation", *RECOMMENDATIONS)
    )


def calibration_suggestions(feedback: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Candidate rules backed by enough feedback, with the recorded decision.

    ``decisions``: suggestion_id, decision.  The rules are the five of
    ``SUGGESTIONS``, so everything after the aggregate is at most five rows.
    """
    direction = F.col("recommendation_accuracy")
    counts = feedback.filter(is_eligible()).agg(
        F.count("*").alias("n"),
        F.count_if(direction == "too_high").alias("high"),
        F.count_if(direction == "too_low").alias("low"),
        F.count_if(
            (F.col("ai_recommendation") == "ignore") & (F.col("preferred_recommendation") != "ignore")
        ).alias("miss"),
        F.count_if(F.col("summary_quality").isin(SUMMARY_ISSUES)).alias("issues"),
    )
    high, low = F.col("high"), F.col("low")
    threshold = F.greatest(F.lit(5), F.ceil(F.col("n") * F.lit(0.25)))
    miss_threshold = F.greatest(F.lit(3), F.ceil(F.col("n") * F.lit(0.15)))

    def candidate(name: str) -> Column:
        title, rule = SUGGESTIONS[name]
        order = list(SUGGESTIONS).index(name) + 1
        return F.struct(
            F.lit(order).alias("position"),
            F.lit(name).alias("suggestion_id"),
            F.lit(title).alias("title"),
            F.format_string(EVIDENCE[name], "n", "high", "low", "miss", "issues").alias("evidence"),
            F.lit(rule).alias("proposed_rule"),
        )

    direction_rule = (
        F.when((high >= threshold) & (low >= threshold), candidate("split_recommendation_context"))
        .when((high >= threshold) & (high >= low * F.lit(1.5)), candidate("reduce_over_recommendation"))
        .when((low >= threshold) & (low >= high * F.lit(1.5)), candidate("protect_under_recommendation"))
    )
    active = F.array_compact(
        F.array(
            direction_rule,
            F.when(F.col("miss") >= miss_threshold, candidate("protect_ignore_boundary")),
            F.when(F.col("issues") >= threshold, candidate("preserve_summary_evidence")),
        )
    )
    found = counts.filter(F.col("n") >= MIN_CALIBRATION_FEEDBACK).select(F.inline(active))
    if decisions is None:
        return found.withColumn("status", F.lit("pending")).orderBy("position")
    return (
        found.join(decisions.select("suggestion_id", "decision"), "suggestion_id", "left")
        .withColumn("status", F.coalesce("decision", F.lit("pending")))
        .drop("decision")
        .orderBy("position")
    )


def decide_suggestions(suggestions: DataFrame, log: DataFrame) -> DataFrame:
    """Last decision per suggestion that is active; others are refused.

    ``log``: suggestion_id, decision, ts, event_id.
    """
    return (
        log.join(suggestions.select("suggestion_id"), "suggestion_id", "left_semi")
        .groupBy("suggestion_id")
        .agg(F.max_by("decision", F.struct("ts", "event_id")).alias("decision"))
    )
