"""Contracts of the three model stages, checked as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as sc

SHORT, COMPACT, LONG = 240, 400, 1600  # fixed values: text limits

# Field rules.  ("enum", values), ("text", max), ("text?", max) for a
# key that must exist but may be null, ("bool",), ("texts", max items, max length),
# ("object", fields), ("objects", max items, fields, optional keys).
TRIAGE = {
    "relevance": ("enum", sc.RELEVANCE_LEVELS),
    "intrinsic_signal": ("enum", sc.SIGNAL_LEVELS),
    "novelty_signal": ("enum", sc.NOVELTY_LEVELS),
    "exploration_value": ("enum", sc.SIGNAL_LEVELS),
    "discovery_type": ("enum", sc.DISCOVERY_TYPES),
    "decision": ("enum", sc.TRIAGE_DECISIONS),
    "reason": ("text", COMPACT),
    "why_outside_profile": ("text?", COMPACT),
}
ANALYZE = {
    "one_sentence_summary": ("text", SHORT),
    "summary": ("text", LONG),
    "content_profile": (
        "object",
        {"topics": ("texts", 8, SHORT), "content_type": ("text", SHORT), "difficulty": ("enum", sc.DIFFICULTIES)},
    ),
    "content_map": ("objects", 10, {"title": ("text", SHORT), "summary": ("text", COMPACT)}, ["section_ref"]),
    "key_points": ("texts", 10, COMPACT),
    "claims": (
        "objects", 8,
        {"claim": ("text", COMPACT), "evidence": ("texts", 4, COMPACT), "verification": ("enum", sc.VERIFICATIONS)}, [],
    ),
    "thesis": ("text?", LONG),
    "supporting_evidence": ("texts", 8, COMPACT),
    "counterarguments": ("texts", 6, COMPACT),
    "author_stance": ("text?", COMPACT),
    "limitations": ("texts", 6, COMPACT),
    "unresolved_questions": ("texts", 6, COMPACT),
    "unverified_claims": ("texts", 6, COMPACT),
}
EVALUATE = {
    "relevance": ("enum", sc.RELEVANCE_LEVELS),
    "knowledge_overlap": ("enum", sc.SIGNAL_LEVELS),
    "known_or_redundant": ("bool",),
    "novel_information": ("texts", 8, COMPACT),
    "exploration_value": ("enum", sc.SIGNAL_LEVELS),
    "perspective_diversity": ("enum", sc.SIGNAL_LEVELS),
    "discovery_type": ("enum", sc.DISCOVERY_TYPES),
    "recommendation": ("enum", sc.RECOMMENDATIONS),
    "recommendation_reason": ("text", LONG),
    "why_outside_profile": ("text?", COMPACT),
    "reading_plan": (
        "objects", 10,
        {"section": ("text", SHORT), "action": ("enum", sc.READING_ACTIONS), "reason": ("text", COMPACT)}, ["section_ref"],
    ),
}

_NOT_TEXT = r"BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN|VARIANT"


def _value_ok(value: Column, rule: tuple) -> Column:
    """Rule on an already typed value."""
    kind = rule[0]
    if kind == "enum":
        ok = value.isin(rule[1])
    elif kind == "text":
        ok = F.length(value).between(1, rule[1])
    elif kind == "text?":
        ok = value.isNull() | F.length(value).between(1, rule[1])
    elif kind == "texts":
        ok = (F.size(value) <= rule[1]) & F.forall(
            value, lambda x: F.coalesce(F.length(x).between(1, rule[2]), F.lit(False))
        )
    elif kind == "bool":
        ok = value.isNotNull()
    elif kind == "object":
        ok = F.lit(True)
        for name, inner in rule[1].items():
            ok = ok & F.coalesce(_value_ok(value[name], inner), F.lit(False))
    else:
        def item_ok(item: Column) -> Column:
            good = F.lit(True)
            for name, inner in rule[2].items():
                good = good & F.coalesce(_value_ok(item[name], inner), F.lit(False))
            return good

        ok = (F.size(value) <= rule[1]) & F.forall(value, item_ok)
    return F.coalesce(ok, F.lit(False))


def _type_ok(shape: Column, rule: tuple) -> Column:
    """Rule on the JSON type; ``shape`` is NULL where the key is missing."""
    kind = rule[0]
    if kind in ("enum", "text"):
        ok = shape == "STRING"
    elif kind == "text?":
        ok = shape.isin("STRING", "VOID")
    elif kind == "bool":
        ok = shape == "BOOLEAN"
    elif kind == "texts":
        ok = shape.isin("ARRAY<STRING>", "ARRAY<VOID>")
    elif kind == "object":
        ok = F.startswith(shape, F.lit("OBJECT<")) & ~shape.rlike(_NOT_TEXT)
    else:
        ok = (F.startswith(shape, F.lit("ARRAY<OBJECT<")) & ~shape.rlike(_NOT_TEXT)) | (shape == "ARRAY<VOID>")
    return F.coalesce(ok, F.lit(False))


def _known_keys(raw: Column, name: str, rule: tuple) -> Column:
    """No keys beyond the contract inside nested objects."""
    part = F.get_json_object(raw, f"$.{name}")
    if rule[0] == "object":
        known = F.array(*[F.lit(k) for k in rule[1]])
        return F.size(F.array_except(F.coalesce(F.json_object_keys(part), F.array().cast("array<string>")), known)) == 0
    known = F.array(*[F.lit(k) for k in [*rule[2], *rule[3]]])
    maps = F.from_json(part, "array<map<string,string>>")
    return F.coalesce(F.forall(maps, lambda m: F.size(F.array_except(F.map_keys(m), known)) == 0), F.lit(True))


def _parse(df: DataFrame, contract: dict, ddl: str, rules: dict[str, Column], raw: str) -> DataFrame:
    text = F.col(raw)
    variant = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    shaped = df.withColumn("_v", variant).withColumn("_keys", F.when(F.col("_v").isNotNull(), keys))
    shaped = shaped.withColumn("parsed", F.when(F.col("_keys").isNotNull(), F.from_json(text, ddl)))
    checks = []
    for name, rule in contract.items():
        shape = F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{name}", "variant"))
        ok = _type_ok(shape, rule) & _value_ok(F.col(f"parsed.{name}"), rule)
        if rule[0] in ("object", "objects"):
            ok = ok & _known_keys(text, name, rule)
        checks.append(F.when(~ok, F.lit(name)))
    known = F.array(*[F.lit(k) for k in contract])
    extra = F.transform(F.array_except(F.col("_keys"), known), lambda k: F.concat(F.lit("extra:"), k))
    broken = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    found = F.concat(F.array_compact(F.array(*checks)), extra, F.array_compact(F.array(*broken)))
    return shaped.withColumn(
        "violations", F.when(F.col("_keys").isNull(), F.array(F.lit("json"))).otherwise(found)
    ).drop("_v", "_keys")


def _outside_needs_reason() -> Column:
    return (F.col("parsed.discovery_type") == "outside_profile_high_value") & (
        F.coalesce(F.col("parsed.why_outside_profile"), F.lit("")) == ""
    )


def parse_triage(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``parsed`` and ``violations``; ignoring needs low signal and low exploration."""
    low = (F.col("parsed.intrinsic_signal") == "low") & (F.col("parsed.exploration_value") == "low")
    rules = {
        "rule:ignore": (F.col("parsed.decision") == "ignore") & ~low,
        "rule:outside_profile": _outside_needs_reason(),
    }
    return _parse(df, TRIAGE, sc.TRIAGE_DDL, rules, raw)


def parse_analyze(df: DataFrame, raw: str = "raw") -> DataFrame:
    return _parse(df, ANALYZE, sc.ANALYZE_DDL, {}, raw)


def parse_evaluate(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``parsed`` and ``violations``; high exploration may not be ignored."""
    rules = {
        "rule:exploration": (F.col("parsed.exploration_value") == "high") & (F.col("parsed.recommendation") == "ignore"),
        "rule:outside_profile": _outside_needs_reason(),
    }
    return _parse(df, EVALUATE, sc.EVALUATE_DDL, rules, raw)


PARSERS = {"triage": parse_triage, "analyze": parse_analyze, "evaluate": parse_evaluate}
