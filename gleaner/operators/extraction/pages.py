"""Content engines, choice between them, and the whole extraction job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.quality import quality_report
from ...functions.text import frontmatter_build
from ...schemas import quality_rank
from ...session import cut_lineage
from .filters import match_site_rule, remove_by_rules, remove_noise, rule_steps
from .markdown import absolutize_links, to_markdown
from .metadata import jsonld_metadata, page_metadata, rule_metadata
from .scoring import main_content
from .selectors import MAX_STEPS, flag_selectors, programs
from .tree import attr, by_page, html_tokens, inside, is_tag, subtree_sums

# Engine ids and messages.
READABILITY, SEMANTIC, FULL_PAGE, RULE = "readability", "semantic-dom", "full-page", "adapter"
ERROR_EMPTY = "页面没有可转换的正文内容（可能为空白页、纯 JS 渲染或登录墙）"
WARN_NOTHING = "转换为空内容"
MIN_RULE_CHARS = 100


def _inner_of_first(nodes: DataFrame, flag: Column) -> DataFrame:
    """Nodes strictly inside the first flagged node of each page."""
    page = Window.partitionBy("page_id")
    rows = nodes.withColumn("_pos", F.min(F.when(flag, F.col("pos"))).over(page))
    rows = rows.withColumn("_in", inside(F.col("pos") == F.col("_pos"), or_self=False))
    return rows.filter("_in").select(*nodes.columns)


def semantic_content(nodes: DataFrame) -> DataFrame:
    """Content of the first ``article``, ``main`` or ``role=main`` element."""
    return _inner_of_first(nodes, is_tag("article", "main") | (attr("role") == "main"))


def full_page(nodes: DataFrame) -> DataFrame:
    """Content of the body; only where the user asked for the whole page."""
    return _inner_of_first(nodes, is_tag("body"))


def _with_trimmed_length(nodes: DataFrame) -> DataFrame:
    """Adds ``_len``, the characters of each subtree's text as they stand, without the white space at its two ends."""
    size = F.length("text")
    solid = F.col("text").rlike(r"(?U)\S")
    before = F.coalesce(F.sum(size).over(by_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = nodes.withColumns(
        {
            "_from": F.when(solid, before + size - F.length(F.regexp_replace("text", r"(?U)\A\s+", ""))),
            "_to": F.when(solid, before + F.length(F.regexp_replace("text", r"(?U)\s++\z", ""))),
        }
    )
    end = F.coalesce(F.last("_to", ignorenulls=True).over(by_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # From the end of one text to the end of the next; of a subtree's first text the white space before it does not count.
    rows = rows.withColumns({"_step": F.col("_to") - end, "_gap": F.col("_from") - end}).drop("_from", "_to")
    onward = Window.partitionBy("page_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_gap", F.last("_gap", ignorenulls=True).over(onward))
    rows = subtree_sums(rows, {"_len": F.col("_step")})
    return rows.withColumn("_len", F.when(F.col("_len") > 0, F.col("_len") - F.col("_gap")).otherwise(0)).drop("_step", "_gap")


def rule_content(nodes: DataFrame, rules: DataFrame, steps: int = MAX_STEPS) -> DataFrame:
    """Content of the first site-rule selector whose first match has enough text.

    ``rules``: page_id, rule (struct with content selectors).  Pages without a
    rule never enter the job.
    """
    chosen = rules.filter(F.size("rule.content") > 0).select("page_id", programs(F.col("rule.content")).alias("_selectors"))
    rows = _with_trimmed_length(nodes.join(chosen, "page_id"))
    found = flag_selectors(rows, "_selectors", steps).select("page_id", "pos", "last", "_len", F.explode("hits").alias("_k"))
    first = found.groupBy("page_id", "_k").agg(F.min(F.struct("pos", "last", "_len")).alias("_at"))
    best = first.filter(F.col("_at._len") >= MIN_RULE_CHARS).groupBy("page_id").agg(F.min_by("_at", "_k").alias("_at"))
    return (
        nodes.join(best, "page_id")
        .filter((F.col("pos") > F.col("_at.pos")) & (F.col("pos") <= F.col("_at.last")))
        .select(*nodes.columns)
    )


def _better(candidate: Column, primary: Column) -> Column:
    """Clearly more text, and not mostly links where the other one is not."""
    linky = (candidate["link_ratio"] > 60) & (F.coalesce(primary["link_ratio"], F.lit(0)) <= 60)
    more = candidate["char_count"] > F.coalesce(primary["char_count"], F.lit(0)) * 1.2
    return ~linky & more


def choose_extraction(candidates: DataFrame) -> DataFrame:
    """One engine per page.

    ``candidates``: page_id, slot (rule, primary, fallback, semantic), engine_id,
    has_html, level, char_count, link_ratio and any payload columns.
    """
    payload = F.struct(*[c for c in candidates.columns if c not in ("page_id", "slot")])
    wide = candidates.groupBy("page_id").agg(
        *[F.max_by(payload, F.when(F.col("slot") == s, 1)).alias(s) for s in ("rule", "primary", "fallback", "semantic")]
    )
    rule, primary, fallback, semantic = (F.col(s) for s in ("rule", "primary", "fallback", "semantic"))
    weak = F.coalesce(primary["level"].isin("failed", "poor"), F.lit(True))
    rank = F.coalesce(quality_rank(primary["level"]), F.lit(0))
    usable = (
        F.coalesce(fallback["has_html"], F.lit(False)) & (fallback["level"] != "failed")
        & ((quality_rank(fallback["level"]) > rank) | _better(fallback, primary))
    )
    no_primary = ~F.coalesce(primary["has_html"], F.lit(False))
    chosen = (
        F.when(rule["level"].isin("good", "warning"), rule)
        .when(weak & F.coalesce(usable, F.lit(False)), fallback)
        .when(weak & no_primary & F.coalesce(semantic["has_html"], F.lit(False)), semantic)
        .otherwise(primary)
    )
    return wide.select("page_id", chosen.alias("chosen")).select("page_id", "chosen.*")


def with_quality(markdown: DataFrame, slot: str, engine: str | Column) -> DataFrame:
    """Candidate rows of one engine: quality, counts and text."""
    engine_id = engine if isinstance(engine, Column) else F.lit(engine)
    rows = markdown.withColumn("q", quality_report(F.col("markdown")))
    return rows.select(
        "page_id", F.lit(slot).alias("slot"), engine_id.alias("engine_id"), F.lit(True).alias("has_html"),
        F.col("q.level").alias("level"), F.col("q.metrics.char_count").alias("char_count"),
        F.col("q.metrics.link_ratio").alias("link_ratio"), F.col("q.metrics.paragraphs").alias("paragraphs"),
        F.col("q.warnings").alias("warnings"), F.col("q.metrics").alias("metrics"), "markdown",
    )


def reextract_needed(pages: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Pages without a reusable result: same URL and version, succeeded, good."""
    reusable = cache.filter(
        F.col("ok") & (F.col("level") == "good") & (F.col("extractor_version") == version)
    ).select("url")
    return pages.join(reusable, "url", "left_anti")


def extract_pages(
    pages: DataFrame, rules: DataFrame | None = None, captured_at: Column | None = None, whole_page: bool = False
) -> DataFrame:
    """Pages → extraction rows with front matter, quality and engine.

    The fallback engines run only on the pages whose main result is weak.
    """
    captured = captured_at if captured_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    matched = match_site_rule(pages, rules) if rules is not None else None
    steps = rule_steps(rules) if rules is not None else 1
    # Written once: every branch below reads it.
    raw = cut_lineage(absolutize_links(html_tokens(pages), pages))
    removal = matched.select("page_id", F.col("rule.remove").alias("remove")) if matched is not None else None
    clean = remove_noise(raw, removal, steps)
    article = jsonld_metadata(pages)
    if whole_page:
        chosen = with_quality(to_markdown(full_page(clean)), "primary", FULL_PAGE)
        bylines = None
    else:
        content = main_content(clean, article)
        primary = cut_lineage(with_quality(to_markdown(content), "primary", READABILITY))
        bylines = content.groupBy("page_id").agg(F.max("byline").alias("found_byline"))
        strong = primary.filter(F.col("level").isin("good", "warning")).select("page_id")
        weak = pages.select("page_id").join(strong, "page_id", "left_anti")
        again = to_markdown(semantic_content(remove_noise(raw.join(weak, "page_id", "left_semi"), removal, steps)))
        parts = [primary, with_quality(again, "fallback", SEMANTIC)]
        if matched is not None:
            listed = matched.filter(F.size("rule.content") > 0).select("page_id")
            ruled = rule_content(remove_by_rules(raw.join(listed, "page_id", "left_semi"), removal, steps), matched, steps)
            ids = matched.select("page_id", F.concat(F.lit(f"{RULE}:"), "rule.rule_id").alias("rule_engine"))
            parts.append(with_quality(to_markdown(ruled).join(ids, "page_id"), "rule", F.col("rule_engine")))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        chosen = choose_extraction(rows)

    engine = article.join(chosen.select("page_id", "engine_id"), "page_id")
    if bylines is not None:
        engine = engine.join(bylines, "page_id", "left")
    own = F.col("engine_id") == READABILITY
    author = F.coalesce("byline", "found_byline") if bylines is not None else F.col("byline")
    engine = engine.select(
        "page_id", *[F.when(own, c).alias(n) for n, c in (
            ("title", F.col("title")), ("author", author), ("site", F.col("site")), ("published_at", F.col("published_at")),
        )],
    )
    meta = page_metadata(pages, engine)
    if matched is not None:
        meta = rule_metadata(meta, raw, matched, steps)
    out = meta.join(chosen, "page_id", "left").withColumn("captured_at", captured)
    ok = F.coalesce(F.trim("markdown") != "", F.lit(False))
    header = frontmatter_build(
        F.col("title"), F.col("author"), F.col("source"), F.col("site"), F.col("published_at"), F.col("captured_at"),
        F.col("language"), F.col("engine_id"), F.col("level"), F.col("warnings"),
    )
    empty = F.array(F.lit(WARN_NOTHING))
    return out.select(
        "page_id",
        F.col("source").alias("url"),
        ok.alias("ok"),
        F.when(~ok, F.lit(ERROR_EMPTY)).alias("error"),
        F.when(ok, F.col("engine_id")).alias("engine_id"),
        F.when(ok, F.concat(header, "markdown")).otherwise(F.lit("")).alias("markdown"),
        "title", "author", "site", "published_at", "language", "captured_at",
        F.when(ok, F.col("level")).otherwise(F.lit("failed")).alias("level"),
        F.when(ok, F.col("warnings")).otherwise(empty).alias("warnings"),
        F.when(ok, F.col("metrics")).alias("metrics"),
        F.when(ok, F.col("char_count")).otherwise(F.lit(0)).alias("char_count"),
        F.when(ok, F.col("paragraphs")).otherwise(F.lit(0)).alias("paragraphs"),
        (~ok | (F.col("engine_id") != READABILITY)).alias("fallback"),
    )
