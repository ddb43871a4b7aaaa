"""Noise removal, site rules, hidden and unlikely nodes, tables, conditional cleaning."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.text import token_similarity
from ...functions.urls import host_suffixes, url_host
from .selectors import MAX_STEPS, compile_selector, flag_numbered, longest, programs
from .tree import Pages, attr, by_page, has_attr, inside, is_tag, numbered, page_step, step, subtree_sums, text_length, without, without_numbered

# Containers that never hold the article.
NOISE_TAGS = ["nav", "header", "footer", "aside", "form", "iframe", "script", "style", "noscript", "template"]
NOISE_CLASS_PARTS = [
    "advertisement", "ad-", "ads", "comment", "related", "recommend", "share", "footer", "header", "nav",
]
NOISE_ID_PARTS = ["advertisement", "ad-", "ads", "comment"]

# Class and id patterns of the scoring.
UNLIKELY = (
    "-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|"
    "menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|"
    "pagination|pager|popup|yom-remote"
)
MAYBE = "and|article|body|column|content|main|mathjax|shadow"
POSITIVE = "article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
NEGATIVE = (
    "-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|"
    "promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget"
)
BYLINE = "byline|author|dateline|writtenby|p-author"
SHARE = r"(\b|_)(share|sharedaddy)(\b|_)"
UNLIKELY_ROLES = ["menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog"]
VIDEO_HOSTS = (
    r"//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq|bilibili|live.bilibili)\.com|"
    r"(archive|upload\.wikimedia)\.org|player\.twitch\.tv)"
)
AD_WORDS = "ad(vertising|vertisement)?|pub(licité)?|werb(ung)?|广告|Реклама|Anuncio"
LOADING_WORDS = r"(loading|正在加载|Загрузка|chargement|cargando)(…|\.\.\.)?"
# Element lists of the cleaning.
BLOCK_CHILDREN = ["blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul"]
EMPTY_TAGS = ["div", "section", "header", "h1", "h2", "h3", "h4", "h5", "h6"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

SIMILAR_TITLE = 0.75
BYLINE_MAX = 100
MIN_ARTICLE_CHARS = 500


# --- site rules -------------------------------------------------------------
@dataclass(frozen=True)
class SiteRule:
    """Hints for one site: hosts, selectors of content, noise and metadata (see ``selectors``)."""

    rule_id: str
    hosts: list[str]
    content: list[str] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)
    title: str | None = None
    author: str | None = None
    published_at: str | None = None

    @property
    def selectors(self) -> list[str]:
        return [s for s in (*self.content, *self.remove, self.title, self.author, self.published_at) if s is not None]


# The rule shipped by default.
BUILTIN_RULES = [
    SiteRule(
        "bestblogs", ["bestblogs.dev"], ["#bbArticleContent"], [], "#bbArticleTitle",
        'a[title^="查看该来源"] span.font-medium',
    )
]

RULES_DDL = (
    "ord int, rule_id string, hosts array<string>, content array<string>, remove array<string>, "
    "title string, author string, published_at string"
)


def register_rule(rules: list[SiteRule], rule: SiteRule) -> list[SiteRule]:
    """Add a rule; an equal id takes the place of the earlier one. A selector that is not supported raises SelectorError."""
    for selector in rule.selectors:
        compile_selector(selector)
    if any(r.rule_id == rule.rule_id for r in rules):
        return [rule if r.rule_id == rule.rule_id else r for r in rules]
    return [*rules, rule]


def rules_frame(spark, rules: list[SiteRule]) -> DataFrame:
    """Rules as rows in registration order.  The list is configuration, written by hand."""
    rows = [
        (k, r.rule_id, list(r.hosts), list(r.content), list(r.remove), r.title, r.author, r.published_at)
        for k, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES_DDL)


def rule_steps(rules: DataFrame) -> int:
    """Steps of the longest selector of the rules (a hand-written list)."""
    texts = rules.select(F.explode(F.concat("content", "remove", F.array("title", "author", "published_at"))).alias("s")).distinct()
    return longest([r["s"] for r in texts.filter("s IS NOT NULL").collect()])


def match_site_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the columns of the first registered rule whose host fits, else NULLs.

    Host suffixes turn "ends with" into an equi join.  Of the hosts a page
    matches only the first rule survives, by an aggregate per page.
    """
    by_host = rules.select(F.explode("hosts").alias("suffix"), F.struct("ord", "rule_id", "content", "remove", "title", "author", "published_at").alias("rule"))
    by_host = by_host.groupBy("suffix").agg(F.min_by("rule", "rule.ord").alias("rule"))
    hits = (
        pages.select("page_id", F.explode(host_suffixes(url_host(F.col("url")))).alias("suffix"))
        .join(by_host, "suffix")
        .groupBy("page_id")
        .agg(F.min_by("rule", "rule.ord").alias("rule"))
    )
    return pages.join(hits, "page_id", "left")


def remove_noise(nodes: DataFrame, rules: DataFrame | None = None, steps: int = MAX_STEPS) -> DataFrame:
    """Drop navigation, ads, comments and the like; ``rules``: page_id, remove selectors."""
    css, ident = attr("class"), attr("id")
    noisy = is_tag(*NOISE_TAGS)
    for part in NOISE_CLASS_PARTS:
        noisy = noisy | F.contains(css, F.lit(part))
    for part in NOISE_ID_PARTS:
        noisy = noisy | F.contains(ident, F.lit(part))
    # The page's own html, head and body are rebuilt without attributes.
    clean = without(nodes, noisy & ~is_tag("html", "head", "body", "title", "meta", "link", "base"))
    return clean if rules is None else remove_by_rules(clean, rules, steps)


def remove_by_rules(nodes: DataFrame, rules: DataFrame, steps: int = MAX_STEPS) -> DataFrame:
    """Drop what the site rule of a page lists (page_id, remove: selectors)."""
    joined = nodes.join(rules.select("page_id", programs(F.col("remove")).alias("_remove")), "page_id", "left")
    flagged = flag_numbered(numbered(joined), "_remove", steps)
    return without_numbered(flagged, F.size("hits") > 0).select(*nodes.columns)


# --- scoring helpers --------------------------------------------------------
def as_flag(value: bool | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def class_weight(enabled: bool | Column = True) -> Column:
    """±25 for each of class and id that looks bad or good."""
    weight = F.lit(0)
    for value in (attr("class"), attr("id")):
        weight = weight - F.when(value.rlike(f"(?i){NEGATIVE}"), 25).otherwise(0)
        weight = weight + F.when(value.rlike(f"(?i){POSITIVE}"), 25).otherwise(0)
    return F.when(as_flag(enabled), weight).otherwise(0)


def match_string() -> Column:
    return F.concat(attr("class"), F.lit(" "), attr("id"))


def link_length(length: Column) -> Column:
    """Length of link text, in-page links at a third of their weight.

    Needs ``_in_link`` and ``_in_hash``: whether the text lies in a link.
    """
    return F.when(F.col("_in_hash"), length * F.lit(0.3)).when(F.col("_in_link"), length.cast("double")).otherwise(F.lit(0.0))


def with_links(nodes: DataFrame) -> DataFrame:
    link = is_tag("a")
    args = {"link": link, "hash": F.coalesce(link & attr("href").rlike(r"\A#."), F.lit(False))}
    rows = page_step(nodes, args, _in_links, "struct<link: boolean, hash: boolean>")
    return rows.withColumns({"_in_link": F.col("_found.link"), "_in_hash": F.col("_found.hash")}).drop("_found")


def _in_links(pages: Pages, args: dict[str, pa.Array]) -> pa.Array:
    inner = [pa.array(pages.inside(flag.to_numpy(zero_copy_only=False))) for flag in args.values()]
    return pa.StructArray.from_arrays(inner, names=list(args))


def is_hidden() -> Column:
    style = F.lower(F.regexp_replace(attr("style"), r"\s+", ""))
    return (
        (has_attr("style") & style.rlike(r"(?:\A|;)(?:display:none|visibility:hidden)"))
        | has_attr("hidden")
        | ((attr("aria-hidden") == "true") & ~F.contains(attr("class"), F.lit("fallback-image")))
    )


def prune_nodes(nodes: DataFrame, meta: DataFrame, strip_unlikely: bool | Column = True) -> DataFrame:
    """Drop hidden, unlikely and empty nodes, the byline and a repeated title.

    ``meta``: page_id, title, byline.  Adds ``byline``, the page's author line.
    """
    return prune_numbered(nodes, meta, strip_unlikely).drop("_no")


def prune_numbered(nodes: DataFrame, meta: DataFrame, strip_unlikely: bool | Column = True) -> DataFrame:
    """``prune_nodes`` of nodes without numbers; what is left has them."""
    element = F.col("text").isNull()
    named = element & (F.size("attrs") > 0)
    args = {
        "hidden": named & (is_hidden() | ((attr("aria-modal") == "true") & (attr("role") == "dialog"))),
        "around": is_tag("table", "code"),
        # Counts outside tables and code only.
        "unlikely": named & as_flag(strip_unlikely) & match_string().rlike(f"(?i){UNLIKELY}") & ~match_string().rlike(f"(?i){MAYBE}")
        & ~is_tag("html", "body", "a"),
        "role": named & as_flag(strip_unlikely) & attr("role").isin(UNLIKELY_ROLES),
        "chars": text_length(),
        "element": element,
        "break": is_tag("br", "hr"),
        "may_be_empty": is_tag(*EMPTY_TAGS),
        "byline_like": named & F.col("_byline").isNull() & ~is_tag("html", "head", "body", "meta", "link")
        & ((attr("rel") == "author") | F.contains(attr("itemprop"), F.lit("author")) | match_string().rlike(f"(?i){BYLINE}")),
        "heading": is_tag("h1", "h2"),
    }
    told = meta.select("page_id", F.col("title").alias("_title"), F.col("byline").alias("_byline"))
    joined = nodes.join(told, "page_id", "left")
    args = {name: F.coalesce(value, F.lit(0) if name == "chars" else F.lit(False)) for name, value in args.items()}
    # Byline and repeated title need the text of a few short candidates only.
    marked = step(numbered(joined), {**args, "text": F.col("text")}, _prunable, _PRUNABLE_DDL)
    heading, found = F.col("_found")["heading"], F.col("_found")
    similar = F.when(heading.isNotNull(), token_similarity(F.coalesce("_title", F.lit("")), heading) > SIMILAR_TITLE)
    last = {"drop": found["drop"], "similar": F.coalesce(similar, F.lit(False)) & ~found["in_byline"]}
    marked = step(marked, last, _pruned, "boolean", "_gone").filter(~F.col("_gone"))
    return marked.withColumn("byline", F.coalesce("_byline", found["byline"])).select(*nodes.columns, "byline", "_no")


_PRUNABLE_DDL = "struct<drop: boolean, in_byline: boolean, heading: string, byline: string>"


def _prunable(pages: Pages, args: dict[str, pa.Array]) -> pa.Array:
    """What goes for itself, the texts of headings that may repeat the title, and the byline of pages without one."""
    texts = args.pop("text")
    flag = {name: column.to_numpy(zero_copy_only=False) for name, column in args.items()}
    rows = np.arange(len(pages))
    length = pages.subtree_sum(flag["chars"])
    hidden = flag["hidden"]
    unlikely = (flag["unlikely"] & ~pages.inside(flag["around"], or_self=False)) | flag["role"]
    bare = pages.subtree_sum(flag["element"]) - 1 == pages.subtree_sum(flag["break"])
    drop = hidden | unlikely | (flag["may_be_empty"] & (length == 0) & bare)
    seen = ~hidden & ~pages.inside(drop, or_self=False)

    def joined(member: np.ndarray, key: np.ndarray) -> dict[int, str]:
        """Texts of the members with one key, in document order."""
        pieces: dict[int, list] = {}
        for row in np.flatnonzero(member & ~flag["element"]):
            pieces.setdefault(int(key[row]), []).append((int(pages.pos[row]), texts[row].as_py()))
        return {k: "".join(text for _, text in sorted(v)) for k, v in pieces.items()}

    # The first line that looks like a byline.
    like = flag["byline_like"] & seen & (length >= 1) & (length <= BYLINE_MAX)
    no = Pages.ROOM
    start = pages.of_page(np.where(like, pages.pos, no), np.minimum)
    is_byline = pages.pos == start
    drop = drop | is_byline
    end = pages.of_page(np.where(is_byline, pages.last, -1), np.maximum)
    in_byline = (pages.pos >= start) & (pages.pos <= end)
    said = {k: v.strip(" ") for k, v in joined(in_byline, pages.page).items()}
    lines = [None] * len(pages)
    for row in rows[in_byline] if said else ():
        lines[row] = said.get(int(pages.page[row])) or None
    byline = _on_page(pages, lines, is_byline)

    # Heading text per heading: its nodes follow it directly in document order.
    title_like = flag["heading"] & seen
    owner = pages.latest(title_like)
    owned = (owner >= 0) & (pages.pos <= pages.last[owner])
    own = np.where(owner >= 0, pages.key[owner], -1)
    headed = joined(owned, own)
    headings = [None] * len(pages)
    for row in rows[title_like]:
        headings[row] = headed.get(int(pages.key[row]), "")
    values = [pa.array(drop), pa.array(in_byline), pa.array(headings, pa.string()), byline]
    return pa.StructArray.from_arrays(values, names=["drop", "in_byline", "heading", "byline"])


def _on_page(pages: Pages, values: list[str | None], flag: np.ndarray) -> pa.Array:
    """The value of the flagged node on all nodes of its page; a page has one such value at most."""
    row = pages.of_page(np.where(flag, np.arange(len(pages)), -1), np.maximum)
    return pa.array(values, pa.string()).take(pa.array(row, mask=row < 0))


def _pruned(pages: Pages, args: dict[str, pa.Array]) -> pa.Array:
    """What goes: also the first heading that repeats the title."""
    drop, similar = (args[name].to_numpy(zero_copy_only=False) for name in ("drop", "similar"))
    repeat = pages.of_page(np.where(similar, pages.pos, Pages.ROOM), np.minimum)
    return pa.array(pages.inside(drop | (pages.pos == repeat)))


# --- tables and conditional cleaning ---------------------------------------
def span_of(name: str) -> Column:
    # An empty text would fail in the cast, which is dear for every cell.
    value = F.nullif(F.regexp_extract(attr(name), r"\A\s*(\d+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(F.when(value > 0, value), F.lit(1))


TABLE_SUMS = ("_rows", "_tables", "_marks", "_captions")


def table_widths(nodes: DataFrame) -> DataFrame:
    """Adds ``_cols`` to tables: of the cell spans between two row starts, the most that a row of it has."""
    cells = F.when(is_tag("td", "th"), span_of("colspan")).otherwise(0)
    args = {"row": is_tag("tr"), "table": is_tag("table"), "cells": cells}
    return page_step(nodes, args, _widths, "bigint").withColumnRenamed("_found", "_cols")


def _widths(pages: Pages, args: dict[str, pa.Array]) -> pa.Array:
    row, table, cells = (args[name].to_numpy(zero_copy_only=False) for name in ("row", "table", "cells"))
    width = np.where(row, pages.of_run(cells.astype(np.int64), np.add, pages.page, pages.latest_pos(row)), 0)
    widest = pages.of_run(width, np.maximum, pages.page, pages.latest_pos(table))
    return pa.array(widest, pa.int64(), mask=~table)


def table_sums() -> dict[str, Column]:
    """What is added up over a table's subtree."""
    return {
        "_rows": F.when(is_tag("tr"), span_of("rowspan")).otherwise(0),
        "_tables": F.when(is_tag("table"), 1).otherwise(0),
        "_marks": F.when(is_tag("col", "colgroup", "tfoot", "thead", "th"), 1).otherwise(0),
        "_captions": F.when(is_tag("caption") & (F.col("last") > F.col("pos")), 1).otherwise(0),
    }


def table_verdict() -> Column:
    """True for a table that holds data, false for layout, NULL for other nodes."""
    rows, cols = F.col("_rows"), F.col("_cols")
    verdict = (
        F.when(attr("role") == "presentation", False)
        .when(attr("datatable") == "0", False)
        .when(attr("summary") != "", True)
        .when(F.col("_captions") > 0, True)
        .when(F.col("_marks") > 0, True)
        .when(F.col("_tables") > 1, False)
        .when((cols == 1) | (rows == 1), False)
        .when((rows >= 10) | (cols > 4), True)
        .otherwise(rows * cols > 10)
    )
    return F.when(is_tag("table"), verdict)


def data_tables(nodes: DataFrame) -> DataFrame:
    """Adds ``data_table`` to table nodes: holds data (true) or is layout (false)."""
    sums = subtree_sums(table_widths(numbered(nodes)), table_sums())
    return sums.withColumn("data_table", table_verdict()).select(*nodes.columns, "data_table")


def _fishy(tags: list[str], weights: bool | Column) -> Column:
    """Condition of conditional cleaning over the measured columns of a node."""
    length, is_list = F.col("_len"), is_tag("ul", "ol") | (F.col("_list") > F.col("_len") * 0.9)
    density = F.when(length > 0, F.col("_link") / length).otherwise(F.lit(0.0))
    heading = F.when(length > 0, F.col("_head") / length).otherwise(F.lit(0.0))
    weight = class_weight(weights)
    p, img, inputs, embeds = F.col("_p"), F.col("_img"), F.col("_input"), F.col("_embed")
    figure = F.col("_in_figure")
    suspicious = (
        (~figure & (img > 1) & (p / F.greatest(img, F.lit(1)) < 0.5))
        | (~is_list & (F.col("_li") - 100 > p))
        | (inputs > F.floor(p / 3))
        | (~is_list & ~figure & (heading < 0.9) & (length < 25) & ((img == 0) | (img > 2)) & (density > 0))
        | (~is_list & (weight < 25) & (density > 0.2))
        | ((weight >= 25) & (density > 0.5))
        | (((embeds == 1) & (length < 75)) | (embeds > 1))
        | ((img == 0) & (F.col("_textish") == 0))
    )
    # A plain list of images stays.
    image_list = is_list & (img == F.col("_li")) & (img > 0)
    verdict = (
        F.when(F.coalesce(F.col("data_table"), F.lit(False)) | F.col("_in_data") | (F.col("_data") > 0) | F.col("_in_code"), False)
        .when(weight < 0, True)
        .when(F.col("_commas") >= 10, False)
        .when(F.col("_video") > 0, False)
        .when((F.col("_junk") > 0) & (F.col("_texts") == 1), True)
        .otherwise(suspicious & ~image_list)
    )
    return is_tag(*tags) & verdict


def _measure(rows: DataFrame) -> DataFrame:
    """Adds the measures of every subtree to numbered nodes."""
    element = F.col("text").isNull()
    junk = F.trim("text").rlike(f"(?iu)\\A(?:{AD_WORDS}|{LOADING_WORDS})\\z")
    video = is_tag("object", "embed", "iframe") & F.exists(F.map_values("attrs"), lambda v: v.rlike(f"(?i){VIDEO_HOSTS}"))
    data = F.coalesce(F.col("data_table"), F.lit(False))
    flags = {
        "link": is_tag("a"), "hash": is_tag("a") & attr("href").rlike(r"\A#."), "list": is_tag("ul", "ol"), "head": is_tag(*HEADINGS),
        "figure": is_tag("figure"), "code": is_tag("code"), "data": data,
        "p": is_tag("p"), "img": is_tag("img"), "li": is_tag("li"), "input": is_tag("input"), "embed": is_tag("object", "embed", "iframe"),
        "video": video, "textish": element & is_tag("span", "li", "td", *BLOCK_CHILDREN), "junk": ~element & junk,
        "media": is_tag("img", "embed", "object", "iframe"),
    }
    args = {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}
    args |= {"chars": text_length(), "commas": F.when(element, 0).otherwise(F.regexp_count("text", F.lit(",")))}
    columns = rows.columns
    return step(rows, args, _measured, _MEASURES_DDL).select(*columns, "_found.*")


_COUNTED = ("p", "img", "li", "input", "embed", "video", "textish", "junk", "media", "data")
_MEASURES_DDL = (
    "struct<_in_figure: boolean, _in_code: boolean, _in_data: boolean, _link: double, _len: bigint, _list: bigint, _head: bigint, _commas: bigint, _texts: bigint, "
    + ", ".join(f"_{name}: bigint" for name in _COUNTED)
    + ">"
)


def _measured(pages: Pages, args: dict[str, pa.Array]) -> pa.Array:
    flag = {name: column.to_numpy(zero_copy_only=False) for name, column in args.items()}
    length = flag["chars"].astype(np.int64)
    in_link, in_hash = pages.inside(flag["link"]), pages.inside(flag["hash"])
    # In-page links count a third of their weight.
    linked = np.where(in_hash, length * 0.3, np.where(in_link, length.astype(np.float64), 0.0))
    values = {
        "_in_figure": pages.inside(flag["figure"], or_self=False), "_in_code": pages.inside(flag["code"], or_self=False),
        "_in_data": pages.inside(flag["data"], or_self=False),
        "_link": pages.subtree_sum(linked), "_len": pages.subtree_sum(length),
        "_list": pages.subtree_sum(np.where(pages.inside(flag["list"]), length, 0)),
        "_head": pages.subtree_sum(np.where(pages.inside(flag["head"]), length, 0)),
        "_commas": pages.subtree_sum(flag["commas"]), "_texts": pages.subtree_sum(length > 0),
        **{f"_{name}": pages.subtree_sum(flag[name]) for name in _COUNTED},
    }
    # Text density counts descendants only; the node itself is no part of it.
    values["_textish"] = values["_textish"] - flag["textish"]
    return pa.StructArray.from_arrays([pa.array(v) for v in values.values()], names=list(values))


def clean_conditionally(
    nodes: DataFrame, tags: list[str], weights: bool | Column = True, enabled: bool | Column = True, **facts: Column
) -> DataFrame:
    """Drop blocks of the given tags that look like forms, menus or ads.

    ``nodes`` carry ``data_table``.  All blocks of a pass are judged on the same
    state; the caller runs inner kinds of block before outer ones.  ``facts``
    become columns: what else is to be told from the measures of this pass.
    """
    return clean_numbered(numbered(nodes), tags, weights, enabled, **facts).drop("_no")


def clean_numbered(
    rows: DataFrame, tags: list[str], weights: bool | Column = True, enabled: bool | Column = True, **facts: Column
) -> DataFrame:
    """``clean_conditionally`` of numbered nodes, which stay where they are; what is left has its numbers still."""
    measured = _measure(rows).withColumns(facts) if facts else _measure(rows)
    return without_numbered(measured, as_flag(enabled) & _fishy(tags, weights)).select(*rows.columns, *facts)
