"""Queries: page extraction, site rules, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extraction import filters as fl
from ..operators.extraction import markdown as mk
from ..operators.extraction import metadata as mt
from ..operators.extraction import pages as pg
from ..operators.extraction import scoring as so
from ..operators.extraction import tree as tr
from ..functions.core import let
from ..functions.text import strip_frontmatter
from ..operators import contents as ct
from ..sources import captures as cap
from ..sources import exports as ex
from ..streaming import captures as feed
from .inputs import Inputs, query
from .text import _ABSOLUTE, _LINKS, _UNESCAPE, hashed

VERSION = "v7"
# What is not an ASCII letter, or neither one nor a blank. A negated class of ranges such as [^A-Za-z] takes some twenty times as long
# where eight tasks use it at once on JDK 17.
_NO_LETTERS, _NEITHER = r"\P{Alpha}+", r"[^\p{Alpha} ]+"


def rules(t: Inputs) -> DataFrame:
    """Hand-written rules: the later ``shop`` replaces the earlier one, the first match wins."""
    listed = list(fl.BUILTIN_RULES)
    for rule in [
        fl.SiteRule("shop", ["cheap-pills.example.com"], ["main"]),
        fl.SiteRule("org", ["example.org"], ["article"], [".ad", "nav > ul > li:nth-child(n+2)"], "body > article > h1:first-child"),
        fl.SiteRule("blog", ["blog.therst.example.net", "example.net"], ["#missing, body > p", "article"], ["nav"]),
        fl.SiteRule("late", ["org"], ["html > body > nav ~ article"]),
        fl.SiteRule("shop", ["example.com"], ["div > article", "div.ad + article"], ["li + li > a[href^='/']"], "head > title:last-child"),
    ]:
        listed = fl.register_rule(listed, rule)
    return fl.rules_frame(t.spark, listed)


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
_RULE = f"""CASE WHEN {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' THEN 'shop' WHEN {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' THEN 'org'
    WHEN {_HOST} = 'example.net' OR {_HOST} LIKE '%.example.net' THEN 'blog' WHEN {_HOST} LIKE '%.org' THEN 'late' END"""


@query("match_site_rule", f"SELECT page_id, {_RULE} AS rule_id FROM pages")
def _(t):
    return fl.match_site_rule(t.pages, rules(t)).select("page_id", "rule.rule_id")


@query(
    "site_rules",
    f"SELECT {_RULE} AS rule_id, count(*) AS pages FROM pages GROUP BY 1",
)
def _(t):
    return fl.match_site_rule(t.pages, rules(t)).groupBy("rule.rule_id").agg(F.count("*").alias("pages"))


@query(
    "reextract_needed",
    "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0)",
)
def _(t):
    n = F.col("page_id")
    cache = t.pages.select(
        "url", (n % 2 == 0).alias("ok"), F.when(n % 3 == 0, "warning").otherwise("good").alias("level"),
        F.when(n % 5 == 0, "v6").otherwise(VERSION).alias("extractor_version"),
    )
    return pg.reextract_needed(t.pages, cache, VERSION).select("page_id")


def nodes(t: Inputs) -> DataFrame:
    return tr.html_tokens(t.pages)


def clean_nodes(t: Inputs) -> DataFrame:
    return fl.remove_noise(nodes(t))


# The pages have few elements, each at a depth of its own. A <b> is never closed, so the next block with a text opens it again, three of
# them at most. A parent is the last node one level up, a subtree ends before the next node that is not deeper.
_PIECES = """(SELECT page_id, unnest(found) AS piece, unnest(range(len(found))) AS ord FROM (
    SELECT page_id, regexp_extract_all(regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!.*?>|</[^>]*>', '<>', 'gs'), '<[a-z][^>]*>|[^<>]+') AS found FROM pages) p)"""
_TAGGED = f"""(SELECT *, CASE WHEN tag IN ('html') THEN 0 WHEN tag IN ('head', 'body') THEN 1 WHEN tag IN ('meta', 'title', 'nav', 'div', 'article', 'footer') THEN 2 WHEN tag IN ('ul', 'h1', 'p') THEN 3
        WHEN tag = 'li' THEN 4 WHEN tag = 'a' THEN 5 END AS level FROM (SELECT *, CASE WHEN piece LIKE '<%' THEN regexp_extract(piece, '^<([a-z0-9]+)', 1) ELSE '#text' END AS tag FROM {_PIECES}))"""
_BLOCKS = f"""(SELECT *, count(level) OVER (PARTITION BY page_id ORDER BY ord) AS block, count(*) FILTER (tag = 'b') OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bold FROM {_TAGGED})"""
_INSIDE = f"""(SELECT *, first_value(level) OVER w AS above, first_value(bold) OVER w AS left_open, row_number() OVER w - 1 AS nth FROM {_BLOCKS} WINDOW w AS (PARTITION BY page_id, block ORDER BY ord))"""
_DEEP = f"""(SELECT page_id, ord, 9 AS sub, tag, CASE WHEN tag = '#text' THEN piece END AS raw, coalesce(level, above + 1 + least(left_open, 3) + bold - left_open) AS depth FROM {_INSIDE}
    UNION ALL SELECT page_id, ord, sub, 'b', NULL, above + 1 + sub FROM (SELECT *, unnest(range(least(left_open, 3))) AS sub FROM {_INSIDE} WHERE nth = 1))"""
_LEVELS = f"(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord, sub) - 1 AS pos FROM {_DEEP})"
_NODES_SQL = f"""SELECT n.page_id, CAST(n.pos AS INT) AS pos, CAST(coalesce(max(m.pos) FILTER (m.pos < n.pos AND m.depth = n.depth - 1), -1) AS INT) AS parent,
       CAST(coalesce(min(m.pos) FILTER (m.pos > n.pos AND m.depth <= n.depth), max(m.pos) + 1) - 1 AS INT) AS last, CAST(n.depth AS INT) AS depth, n.tag,
       replace(replace(replace(replace(replace(replace(n.raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text
    FROM {_LEVELS} n JOIN {_LEVELS} m USING (page_id) GROUP BY n.page_id, n.pos, n.depth, n.tag, n.raw"""


@query("html_tokens", _NODES_SQL)
def _(t):
    return nodes(t).select("page_id", "pos", "parent", "last", "depth", "tag", "text")


@query(
    "parent_element",
    f"""WITH n AS MATERIALIZED ({_NODES_SQL})
        SELECT a.page_id, CAST(row_number() OVER (PARTITION BY a.page_id ORDER BY a.pos) - 1 AS INT) AS link_no, p.tag AS parent, g.tag AS grandparent
        FROM n a JOIN n p ON a.page_id = p.page_id AND a.parent = p.pos JOIN n g ON p.page_id = g.page_id AND p.parent = g.pos WHERE a.tag = 'a'""",
)
def _(t):
    rows = nodes(t)
    names = rows.select("page_id", F.col("pos").alias("up"), F.col("ptag").alias("grandparent"))
    links = rows.filter((F.col("tag") == "a") & F.map_contains_key("attrs", "href"))
    order = tr.Window.partitionBy("page_id").orderBy("pos")
    numbered = links.select("page_id", (F.row_number().over(order) - 1).alias("link_no"), F.col("ptag").alias("parent"), F.col("parent").alias("up"))
    return numbered.join(names, ["page_id", "up"]).select("page_id", "link_no", "parent", "grandparent")


_LETTERS = "regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&[a-zA-Z]+;', '', 'g'), '[^A-Za-z]', '', 'g')"
_BARE = "regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!.*?>', '', 'gs')"
_ANCHORS = f"CAST(len(regexp_extract_all({_BARE}, '<a ')) AS BIGINT)"


@query(
    "remove_noise",
    f"""SELECT page_id, 0::BIGINT AS links, CAST(len(regexp_extract_all(html, '<article')) AS BIGINT) AS articles, 0::BIGINT AS footers,
              CAST(len(regexp_extract_all(html, '<div class="ad"')) AS BIGINT) AS ad_boxes,
              {_LETTERS.format(x=f"regexp_replace({_BARE}, '<nav>.*?</nav>|<footer>.*?</footer>', '', 'gs')")} AS letters,
              CASE rule WHEN 'org' THEN least(anchors, 1) WHEN 'shop' THEN least(anchors, 1) WHEN 'blog' THEN 0 ELSE anchors END AS links_by_rule
       FROM (SELECT *, {_RULE} AS rule, {_ANCHORS} AS anchors FROM pages)""",
)
def _(t):
    tag = F.col("tag")
    clean = clean_nodes(t)
    left = clean.groupBy("page_id").agg(
        F.count_if(tag == "a").alias("links"), F.count_if(tag == "article").alias("articles"),
        F.count_if(tag == "footer").alias("footers"), F.count_if((tag == "div") & (tr.attr("class") == "ad")).alias("ad_boxes"),
    ).join(tr.inner_text(clean, ["page_id"]), "page_id").withColumn("letters", F.regexp_replace("inner_text", _NO_LETTERS, "")).drop("inner_text")
    listed = rules(t)
    removal = fl.match_site_rule(t.pages, listed).select("page_id", F.col("rule.remove").alias("remove"))
    ruled = fl.remove_by_rules(nodes(t), removal, fl.rule_steps(listed))
    return left.join(ruled.groupBy("page_id").agg(F.count_if(tag == "a").alias("links_by_rule")), "page_id")


def article_pages(t: Inputs) -> DataFrame:
    """Documents as web pages with meta tags, JSON-LD, tables, images and code."""
    n = F.col("doc_id")
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split(safe, "\n")
    name = F.concat(F.lit("Report number "), n.cast("string"), F.lit(" about reading"))
    ld = F.to_json(
        F.struct(
            F.lit("https://schema.org").alias("@context"),
            F.when(n % 4 == 3, "Person").otherwise("NewsArticle").alias("@type"),
            F.when(n % 2 == 0, F.lit("The Daily")).alias("name"),
            name.alias("headline"),
            F.array(F.struct(F.lit(" Ann ").alias("name")), F.struct(F.concat(F.lit("Bob "), n.cast("string")).alias("name"))).alias("author"),
            F.struct(F.lit("Publisher").alias("name")).alias("publisher"),
            F.lit("2024-05-06").alias("datePublished"),
        )
    )
    script = F.when(n % 3 != 0, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))).otherwise(F.lit(""))
    body_rows = F.array_join(
        F.transform(
            lines,
            lambda l, i: F.when(i % 3 == 2, F.concat(F.lit("<tr><td colspan=2>"), l)).otherwise(
                F.concat(F.lit("<tr><td>"), i.cast("string"), F.lit("<td>"), l)
            ),
        ),
        "",
    )
    head_row = F.when(n % 4 == 1, F.lit("")).otherwise(F.lit("<tr><th>No<th>Line"))
    role = F.when(n % 4 == 0, F.lit(' role="presentation"')).otherwise(F.lit(""))
    table = F.concat(F.lit("<table"), role, F.lit(">"), head_row, body_rows, F.lit("</table>"))
    paragraphs = F.array_join(F.transform(lines, lambda l: F.concat(F.lit("<p>"), l)), "")
    html = F.concat(
        F.lit("<!DOCTYPE html><html lang='"), F.col("lang"), F.lit("'><head><title>"), name, F.lit(" | Site of news</title>"),
        F.lit('<meta property="og:site_name" content="Tag &amp; Site"><meta name="author" content="Meta Author">'), script,
        F.lit('</head><body><nav><a href="/x">x</a></nav><h1>'), name, F.lit('</h1><p class="byline">By Carol</p><article>'),
        paragraphs, table, F.lit("<pre><code class='language-sql'>SELECT 1;\n  FROM t</code></pre><p><img data-src='/i/"), n.cast("string"),
        F.lit(".png' alt='pic'> <a href='../up'>up</a></p></article><div hidden>secret</div><footer>end</footer></body></html>"),
    )
    return t.documents.select(
        n.alias("page_id"), F.concat(F.lit("https://news.example.org/a/b/"), n.cast("string")).alias("url"), html.alias("html"), "text"
    )


# The given pages have no author and no site, so articles built from the documents follow them.
@query(
    "page_metadata",
    """SELECT page_id, url AS source, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS site,
              CAST(NULL AS VARCHAR) AS published_at, nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language FROM pages
       UNION ALL SELECT -1 - doc_id, 'https://news.example.org/a/b/' || doc_id, 'Report number ' || doc_id || ' about reading | Site of news', 'Meta Author', 'Tag & Site', NULL, lang FROM documents""",
)
def _(t):
    articles = article_pages(t).select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    return mt.page_metadata(t.pages.select("page_id", "url", "html").unionByName(articles))


@query(
    "jsonld_metadata",
    """SELECT doc_id AS page_id, 'Report number ' || doc_id || ' about reading' AS title, CASE WHEN ld THEN 'Ann, Bob ' || doc_id ELSE 'Meta Author' END AS byline,
              CASE WHEN ld THEN 'Publisher' ELSE 'Tag & Site' END AS site, CASE WHEN ld THEN '2024-05-06' END AS published_at, ld AS has_jsonld
       FROM (SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 3 AS ld FROM documents)""",
)
def _(t):
    return mt.jsonld_metadata(article_pages(t))


def table_nodes(t: Inputs) -> DataFrame:
    return tr.html_tokens(article_pages(t)).filter(F.size("cells") >= 0)


def grid_pages(t: Inputs) -> DataFrame:
    """Tables whose rows take turns: two cells, a cell over two rows, its second row, no cells; the foot stands first."""
    words = F.transform(F.split("text", "\n"), lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, _NEITHER, ""), " {2,}", " ")))

    def row(line, i, last):
        number = F.concat(F.lit("<td>"), i.cast("string"))
        return (
            F.when(i % 4 == 3, F.lit("<tr></tr>"))
            .when((i % 4 == 1) & (i < last), F.concat(F.lit("<tr><td rowspan=2>"), i.cast("string"), F.lit("<td>"), line))
            .when(i % 4 == 2, F.concat(F.lit("<tr><td>"), line))
            .otherwise(F.concat(F.lit("<tr>"), number, F.lit("<td>"), line))
        )

    # The lines are bound once: named in each of them, they would be cut again for each.
    rows = let(words, lambda found: F.array_join(F.transform(found, lambda line, i: row(line, i, F.size(found) - 1)), ""))
    html = F.concat(F.lit("<html><body><table><tfoot><tr><td>foot<td>end</tfoot><thead><tr><th>No<th>Line</thead><tbody>"), rows, F.lit("</tbody></table></body></html>"))
    return t.documents.select(F.col("doc_id").alias("page_id"), F.lit("https://news.example.org/").alias("url"), html.alias("html"))


_GRID = """SELECT doc_id AS page_id, i, len(lines) AS n, trim(regexp_replace(regexp_replace(lines[i + 1], '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(len(lines))) AS u(i)"""


@query(
    "table_grid",
    f"""SELECT page_id, CAST(i + 1 AS INT) AS row_no, CAST(c AS INT) AS col_no, CASE WHEN i % 4 = 3 THEN '' WHEN c = 1 THEN line WHEN i % 4 = 2 THEN CAST(i - 1 AS VARCHAR) ELSE CAST(i AS VARCHAR) END AS text,
               1::INT AS header_rows, n < 3 AS simple FROM ({_GRID}), (SELECT unnest([0, 1]) AS c)
        UNION ALL SELECT doc_id, 0::INT, c::INT, CASE c WHEN 0 THEN 'No' ELSE 'Line' END, 1::INT, len(string_split(text, chr(10))) < 3 FROM documents, (SELECT unnest([0, 1]) AS c)
        UNION ALL SELECT doc_id, CAST(len(string_split(text, chr(10))) + 1 AS INT), c::INT, CASE c WHEN 0 THEN 'foot' ELSE 'end' END, 1::INT, len(string_split(text, chr(10))) < 3 FROM documents, (SELECT unnest([0, 1]) AS c)""",
)
def _(t):
    return mk.table_grid(tr.html_tokens(grid_pages(t))).select("page_id", "row_no", "col_no", "text", "header_rows", "simple")


@query(
    "data_tables",
    """SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 0 THEN false WHEN 1 THEN n > 1 AND (n >= 10 OR n * 2 > 10) ELSE true END AS data_table
       FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)""",
)
def _(t):
    return fl.data_tables(table_nodes(t)).filter("tag = 'table'").select("page_id", "data_table")


@query(
    "absolutize_links",
    f"""SELECT page_id, CAST(pos - 1 AS INT) AS link_no, {_UNESCAPE.format(x=_ABSOLUTE)} AS target FROM ({_LINKS})""",
)
def _(t):
    rows = mk.absolutize_links(nodes(t), t.pages).filter((F.col("tag") == "a") & F.map_contains_key("attrs", "href"))
    order = tr.Window.partitionBy("page_id").orderBy("pos")
    return rows.select("page_id", (F.row_number().over(order) - 1).alias("link_no"), F.try_element_at("attrs", F.lit("href")).alias("target"))


# Hidden parts and the heading that repeats the title go; the byline stays, as the metadata has an author already.
@query(
    "prune_nodes",
    """SELECT doc_id AS page_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 3 THEN 'Ann, Bob ' || doc_id ELSE 'Meta Author' END AS byline,
              'ReportnumberaboutreadingSiteofnewsxByCarol' || letters || CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'NoLine' END || letters || 'SELECTFROMtupend' AS letters
       FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS letters FROM documents)""",
)
def _(t):
    pages = article_pages(t)
    pruned = fl.prune_nodes(tr.html_tokens(pages), mt.jsonld_metadata(pages))
    # The byline stands on all nodes of a page, so the nodes are read once for it and the text.
    told = tr.inner_text(pruned.filter("page_id IS NOT NULL"), ["page_id"], byline=F.max("byline"))
    return told.select("page_id", "byline", F.regexp_replace("inner_text", _NO_LETTERS, "").alias("letters"))


# Nodes without navigation and footer; a heading that repeats the title goes where the scoring prunes.
_KEPT = f"""n AS MATERIALIZED ({_NODES_SQL}),
k AS (SELECT *, CASE WHEN tag <> '#text' OR trim(text) = '' THEN 0 ELSE length(regexp_replace(text, '\\s+', ' ', 'g')) END AS own,
        CASE WHEN tag = '#text' THEN len(regexp_extract_all(text, '[,،﹐︐︑⹁⸴⸲，]')) ELSE 0 END AS own_commas FROM n
      WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.page_id = n.page_id AND m.tag IN ('nav', 'footer') AND n.pos BETWEEN m.pos AND m.last){{pruned}}),
sums AS (SELECT v.page_id, v.pos, v.last, v.parent, v.tag, sum(d.own) AS len, sum(d.own_commas) AS commas,
        count(*) FILTER (d.pos <> v.pos AND d.tag NOT IN ('#text', 'b', 'br', 'a')) AS inner_blocks FROM k v JOIN k d ON d.page_id = v.page_id AND d.pos BETWEEN v.pos AND v.last GROUP BY ALL),
kinds AS (SELECT s.*, s.tag = 'div' AND inner_blocks = 0 AND len > 0 AS acts_p, s.tag IN ('#text', 'b', 'br') OR (s.tag = 'a' AND inner_blocks = 0) AS phrasing,
        coalesce(p.tag, '') AS above, last_value(CASE WHEN s.tag <> '#text' OR len > 0 THEN s.tag END IGNORE NULLS) OVER (PARTITION BY s.page_id, s.parent ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
      FROM sums s LEFT JOIN n p ON p.page_id = s.page_id AND p.pos = s.parent),
cuts AS (SELECT *, NOT phrasing OR (tag = 'br' AND coalesce(previous = 'br', false)) AS cut FROM kinds),
runs AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY page_id, parent ORDER BY pos) AS run, phrasing AND above = 'div' AND bool_or(cut) OVER (PARTITION BY page_id, parent) AS in_run FROM cuts),
units AS (SELECT *, sum(len) OVER g AS run_len, in_run AND pos = min(pos) OVER g AND sum(len) OVER g > 0 AS run_head FROM runs WINDOW g AS (PARTITION BY page_id, parent, run, in_run))"""
_PARAGRAPHS_SQL = f"WITH {_KEPT.format(pruned='')} SELECT page_id, pos, tag, CAST(len AS BIGINT) AS len, CAST(run_len AS BIGINT) AS run_len, acts_p, run_head FROM units WHERE run_head OR acts_p OR tag = 'p'"
_FIRST_HEADING = """ AND NOT EXISTS (SELECT 1 FROM n h WHERE h.page_id = n.page_id AND h.tag = 'h1' AND n.pos BETWEEN h.pos AND h.last
        AND h.pos = (SELECT min(pos) FROM n f WHERE f.page_id = n.page_id AND f.tag = 'h1'))"""
_SCORES = f"""WITH RECURSIVE {_KEPT.format(pruned=_FIRST_HEADING)},
points AS (SELECT page_id, pos, parent, 2 + commas + least(length // 100, 3) AS points
           FROM (SELECT *, CASE WHEN run_head THEN run_len ELSE len END AS length FROM units WHERE run_head OR acts_p OR tag IN ('p', 'td', 'pre', 'section', 'h2', 'h3', 'h4', 'h5', 'h6')) u WHERE length >= 25),
ups AS (SELECT page_id, pos, points, parent AS target, 0 AS level FROM points UNION ALL
        SELECT u.page_id, u.pos, u.points, n.parent, u.level + 1 FROM ups u JOIN n ON n.page_id = u.page_id AND n.pos = u.target WHERE u.level < 4),
met AS (SELECT page_id, target, sum(points / CASE level WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE level * 3 END) AS points, min((pos, level)) AS found FROM ups WHERE target >= 0 GROUP BY page_id, target),
scores AS (SELECT m.page_id, m.target AS pos, n.tag, round(points + CASE n.tag WHEN 'div' THEN 5 WHEN 'li' THEN -3 WHEN 'ul' THEN -3 ELSE 0 END, 6) AS score, found
           FROM met m JOIN n ON n.page_id = m.page_id AND n.pos = m.target WHERE n.tag <> 'html')"""


@query("normalize_paragraphs", _PARAGRAPHS_SQL)
def _(t):
    rows = so.normalize_paragraphs(clean_nodes(t))
    return rows.filter(F.col("run_head") | F.col("acts_p") | (F.col("tag") == "p")).select("page_id", "pos", "tag", "len", "run_len", "acts_p", "run_head")


def scored(t: Inputs) -> DataFrame:
    return so.score_candidates(fl.prune_nodes(clean_nodes(t), mt.jsonld_metadata(t.pages)))


@query("score_candidates", f"{_SCORES} SELECT page_id, pos, tag, score FROM scores")
def _(t):
    return scored(t).filter("score IS NOT NULL").select("page_id", "pos", "tag", F.round("score", 6).alias("score"))


@query(
    "top_candidates",
    f"""{_SCORES} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, found, pos) AS INTEGER) AS rank, pos, tag, score FROM scores
        QUALIFY rank <= 5""",
)
def _(t):
    return so.top_candidates(scored(t)).select("page_id", "rank", "pos", "tag", F.round("score", 6).alias("score"))


# The article without the heading that repeats the title; where that leaves too little, the last attempt also keeps the box before it:
# a sibling counts as a paragraph with more than 80 characters, or with fewer and the end of a sentence.
_CONTENT_SQL = f"""WITH {_KEPT.format(pruned=_FIRST_HEADING)},
parts AS (SELECT k.*, box.tag = 'div' AS boxed FROM k JOIN n box ON box.page_id = k.page_id AND box.tag IN ('article', 'div') AND k.pos BETWEEN box.pos AND box.last),
tried AS (SELECT page_id, CAST(CASE WHEN sum(own) FILTER (NOT boxed) >= 500 THEN 0 WHEN sum(own) FILTER (boxed) > 80 OR (sum(own) FILTER (boxed) BETWEEN 1 AND 79 AND bool_or(regexp_matches(text, '\\.( |$)')) FILTER (boxed)) THEN 3 ELSE 0 END AS INTEGER) AS attempt
          FROM parts GROUP BY page_id)
SELECT page_id, attempt, pos, tag, text FROM parts JOIN tried USING (page_id) WHERE NOT boxed OR attempt = 3"""


@query("main_content", _CONTENT_SQL)
def _(t):
    content = so.main_content(clean_nodes(t), mt.jsonld_metadata(t.pages))
    return content.select("page_id", "attempt", "pos", "tag", "text")


def boxed_pages(t: Inputs) -> DataFrame:
    """Article pages with boxes before the article: links (half of them linked text), a widget, a list of links, a form, a linked name in a div."""
    n = F.col("page_id")
    first = F.substring(F.regexp_replace("text", _NEITHER, ""), 1, 60)
    boxes = F.concat(
        F.when(n % 2 == 0, F.concat(F.lit("<div id=links><p><a href=/x>"), first, F.lit("</a>, "), F.when(n % 4 == 0, F.repeat(first, 9)).otherwise(F.lit("")), F.lit(" and more words</p></div>"))).otherwise(F.lit("")),
        F.when(n % 3 == 0, F.concat(F.lit("<div class=widget><p>"), first, F.lit(" in a widget of this site</p></div>"))).otherwise(F.lit("")),
        F.when(n % 5 == 0, F.lit("<ul><li><a href=/a>first link</a><li><a href=/b>second link</a></ul>")).otherwise(F.lit("")),
        F.when(n % 7 == 0, F.lit("<form><input name=q><p>Search the site, its pages and its words</p></form>")).otherwise(F.lit("")),
    )
    return article_pages(t).withColumn("html", F.replace("html", F.lit("<article>"), F.concat(boxes, F.lit("<article>"))))


# A widget's class goes against it, a form has more inputs than a third of its paragraphs, a list may hold links.
# A div keeps its place while links are at most a fifth of its text, and it has some text besides.
_BOXES = """SELECT doc_id, lines, doc_id % 2 = 0 AND NOT (linked / total > 0.2 OR (total < 25 AND linked > 0)) AS box
    FROM (SELECT *, linked + length(regexp_replace(', ' || CASE WHEN doc_id % 4 = 0 THEN repeat(s, 9) ELSE '' END || ' and more words', ' +', ' ', 'g')) AS total
          FROM (SELECT doc_id, s, lines, CASE WHEN trim(s) = '' THEN 0 ELSE length(regexp_replace(s, ' +', ' ', 'g')) END AS linked
                FROM (SELECT doc_id, substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 60) AS s, len(string_split(text, chr(10))) AS lines FROM documents)))"""


@query(
    "clean_conditionally",
    f"""SELECT doc_id AS page_id, 1::BIGINT AS tables, CAST(lines + 2 + CASE WHEN box THEN 1 ELSE 0 END AS BIGINT) AS paragraphs, 0::BIGINT AS widgets,
              CAST(CASE WHEN box THEN 1 ELSE 0 END AS BIGINT) AS link_boxes, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lists, 0::BIGINT AS forms FROM ({_BOXES})""",
)
def _(t):
    rows = fl.data_tables(tr.html_tokens(boxed_pages(t)))
    tag = F.col("tag")
    return fl.clean_conditionally(rows, ["table", "div", "ul", "form"]).groupBy("page_id").agg(
        F.count_if(tag == "table").alias("tables"), F.count_if(tag == "p").alias("paragraphs"), F.count_if(tr.attr("class") == "widget").alias("widgets"),
        F.count_if(tr.attr("id") == "links").alias("link_boxes"), F.count_if(tag == "ul").alias("lists"), F.count_if(tag == "form").alias("forms"),
    )


# Blank text aside, everything after the article's start tag belongs to it.
@query(
    "semantic_content",
    """SELECT page_id, CAST(len(regexp_extract_all(a, '<h1')) AS BIGINT) AS headings, regexp_replace(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '&[a-zA-Z]+;', '', 'g'), '[^A-Za-z]', '', 'g') AS letters
       FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages)""",
)
def _(t):
    rows = pg.semantic_content(nodes(t))
    joined = tr.inner_text(rows, ["page_id"])
    heads = rows.groupBy("page_id").agg(F.count_if(F.col("tag") == "h1").alias("headings"))
    return heads.join(joined, "page_id").select("page_id", "headings", F.regexp_replace("inner_text", _NO_LETTERS, "").alias("letters"))


@query(
    "full_page",
    f"SELECT page_id, {_ANCHORS} AS links, {_LETTERS.format(x=f"regexp_replace({_BARE}, '<head>.*?</head>', '', 's')")} AS letters FROM pages",
)
def _(t):
    rows = pg.full_page(nodes(t))
    links = rows.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("links"))
    return links.join(tr.inner_text(rows, ["page_id"]), "page_id").select("page_id", "links", F.regexp_replace("inner_text", _NO_LETTERS, "").alias("letters"))


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"


@query(
    "rule_content",
    f"""SELECT page_id, CAST(len(regexp_extract_all({_ARTICLE}, '<h1')) AS BIGINT) AS headings, {_LETTERS.format(x=_ARTICLE)} AS letters
        FROM pages WHERE {_RULE} IS NOT NULL AND length(trim(regexp_replace({_ARTICLE}, '<[^>]*>', '', 'g'))) >= 100""",
)
def _(t):
    listed = rules(t)
    matched, steps = fl.match_site_rule(t.pages, listed), fl.rule_steps(listed)
    removal = matched.select("page_id", F.col("rule.remove").alias("remove"))
    rows = pg.rule_content(fl.remove_by_rules(nodes(t), removal, steps), matched, steps)
    heads = rows.groupBy("page_id").agg(F.count_if(F.col("tag") == "h1").alias("headings"))
    return heads.join(tr.inner_text(rows, ["page_id"]), "page_id").select("page_id", "headings", F.regexp_replace("inner_text", _NO_LETTERS, "").alias("letters"))


@query(
    "rule_metadata",
    f"""SELECT page_id, source, CASE WHEN {_RULE} = 'org' AND length(h) < 200 AND h <> '' THEN h ELSE title END AS title, author, language
        FROM (SELECT page_id, url, url AS source, trim(regexp_extract(x, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(x, '<h1[^>]*>([^<]*)</h1>', 1)) AS h,
                CAST(NULL AS VARCHAR) AS author, nullif(regexp_extract(x, '<html lang="([^"]*)"', 1), '') AS language FROM (SELECT page_id, url, replace(html, '&amp;', '&') AS x FROM pages))""",
)
def _(t):
    listed = rules(t)
    matched = fl.match_site_rule(t.pages, listed)
    return mt.rule_metadata(mt.page_metadata(t.pages), nodes(t), matched, fl.rule_steps(listed)).select("page_id", "source", "title", "author", "language")


# A cell over two columns stands in both of them; the addresses of the image and the link are absolute.
@query(
    "to_markdown",
    """SELECT doc_id AS page_id, array_to_string(lines, '') || CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'NoLine' END
              || array_to_string(list_transform(lines, lambda l, i: CASE WHEN i % 3 = 0 THEN l || l ELSE l END), '') || 'sqlSELECTFROMtpichttpsnewsexampleorgipnguphttpsnewsexampleorgaup' AS letters,
              CAST(len(lines) AS BIGINT) AS rows
       FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '[^A-Za-z]', '', 'g')) AS lines FROM documents)""",
)
def _(t):
    pages = article_pages(t)
    content = pg.semantic_content(mk.absolutize_links(tr.html_tokens(pages), pages))
    text = F.col("markdown")
    # Lines of the table but for the header and the one below it.
    body = F.filter(F.split(text, "\n"), lambda l: l.rlike(r"\A\| .* \|\z"))
    return mk.to_markdown(content).select("page_id", F.regexp_replace(text, _NO_LETTERS, "").alias("letters"), (F.size(body) - 2).cast("bigint").alias("rows"))


def candidate_rows(t: Inputs) -> DataFrame:
    """Engine results derived from the documents: sizes decide quality and links."""
    n, size = F.col("doc_id"), F.col("n_chars")
    level = F.when(size % 7 == 0, "failed").when(size % 7 < 4, "poor").when(size % 7 == 4, "warning").otherwise("good")
    base = [n.alias("page_id"), F.lit(None).cast("string").alias("markdown")]

    def slot(name, engine, html, lvl, chars, link):
        return t.documents.select(
            *base, F.lit(name).alias("slot"), F.lit(engine).alias("engine_id"), html.alias("has_html"), lvl.alias("level"),
            chars.cast("int").alias("char_count"), link.cast("int").alias("link_ratio"),
        )

    primary = slot("primary", "readability", size % 7 != 0, level, size, size % 100)
    fallback = slot("fallback", "fallback", n % 3 != 0, F.when(n % 5 == 0, "failed").when(n % 5 == 1, "poor").otherwise("good"), size + (n % 4) * 100, (n * 37) % 100)
    semantic = slot("semantic", "semantic-dom", n % 2 == 0, F.lit("poor"), size, F.lit(0))
    rule = slot("rule", "adapter:x", F.lit(True), F.when(n % 11 == 0, "good").otherwise("poor"), size, F.lit(0)).filter(n % 11 < 2)
    return primary.unionByName(fallback).unionByName(semantic).unionByName(rule)


@query(
    "choose_extraction",
    """SELECT page_id, CASE WHEN n % 11 = 0 THEN 'adapter:x' WHEN k < 4 AND n % 3 <> 0 AND n % 5 <> 0 AND (fr > pr OR (NOT (fl > 60 AND pl <= 60) AND fc > pc * 1.2)) THEN 'fallback'
              WHEN k = 0 AND n % 2 = 0 THEN 'semantic-dom' ELSE 'readability' END AS engine_id
       FROM (SELECT doc_id AS page_id, doc_id AS n, n_chars % 7 AS k, n_chars AS pc, n_chars + (doc_id % 4) * 100 AS fc, n_chars % 100 AS pl, (doc_id * 37) % 100 AS fl,
                    CASE WHEN n_chars % 7 = 0 THEN 0 WHEN n_chars % 7 < 4 THEN 1 ELSE 2 END AS pr, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 3 END AS fr FROM documents)""",
)
def _(t):
    return pg.choose_extraction(candidate_rows(t)).select("page_id", "engine_id")


@query("extract_pages")
def _(t):
    rows = pg.extract_pages(t.pages, rules(t), F.lit("2024-01-01T00:00:00.000Z"))
    return rows.select("page_id", "ok", "engine_id", "level", "char_count", "paragraphs", "fallback", "title", "markdown")


def export_rows(t: Inputs) -> DataFrame:
    """Contents in the shape of extraction rows."""
    return t.v_contents.select(
        F.col("content_id"), "title", F.when(F.col("capture_mode") == "manual", F.lit("Ann")).otherwise(F.lit("")).alias("author"),
        F.col("source_url").alias("url"), F.lit(None).cast("string").alias("published_at"), "markdown",
        F.col("capture_quality").alias("level"), F.array(F.lit("w")).alias("warnings"), F.lit("readability").alias("engine_id"),
        F.lit("2024-01-01").alias("captured_at"),
    )


_FILE = """CASE WHEN trim(title) = '' THEN '未命名文章' ELSE substr(trim(regexp_replace(title, '[\\\\/:*?"<>|\\x00-\\x1f]', '_', 'g')), 1, 80) END"""


@query("export_markdown", f"SELECT {_FILE} || '.md' AS name, sha256(markdown) AS text FROM v_contents")
def _(t):
    return ex.export_markdown(export_rows(t)).select("name", hashed(F.col("text")).alias("text"))


@query(
    "export_json",
    f"""SELECT {_FILE} || '.json' AS name, sha256('{{"metadata":{{"title":' || to_json(title) || CASE WHEN capture_mode = 'manual' THEN ',"author":"Ann"' ELSE '' END || ',"source":' || to_json(source_url)
           || '}},"markdown":' || to_json(markdown) || ',"contentType":"article","quality":{{"level":"' || capture_quality || '","warnings":["w"]}},"extraction":{{"engine":"readability","adapter":null,"capturedAt":"2024-01-01"}}}}') AS json
        FROM v_contents""",
)
def _(t):
    return ex.export_json(export_rows(t)).select("name", hashed(F.col("json")).alias("json"))


@query(
    "capture_envelope",
    """SELECT content_id, sha256('{"schema_version":"gleaner.capture.v1","capture_id":"' || capture_id || '","source":{"type":"web","url":' || to_json(source_url) || ',"title":' || to_json(title)
           || CASE WHEN capture_mode = 'manual' THEN ',"author":"Ann"' ELSE '' END || '},"document":{"format":"markdown","text":' || to_json(markdown) || ',"units":[]},"capture":{"mode":"manual","producer":"gleaner-web","producer_version":"1.0.0","quality":{"level":"'
           || capture_quality || '","warnings":["w"]},"extraction_engine":"readability"}}') AS envelope FROM v_contents""",
)
def _(t):
    author = F.when(F.col("capture_mode") == "manual", F.lit("Ann")).otherwise(F.lit(""))
    envelope = cap.build_capture(
        F.col("capture_id"), F.col("source_url"), F.col("title"), author, F.col("markdown"), F.col("capture_quality"),
        F.array(F.lit("w")), F.lit("readability"),
    )
    return t.v_contents.select("content_id", hashed(envelope).alias("envelope"))


# Every fourth page is not captured again. A stored page keeps its id and its first capture.
_STORED_PAGES = """SELECT 'k-' || page_id AS content_id, 'stored-' || page_id AS capture_id, norm, page_id FROM pages JOIN o_page_urls USING (url) WHERE page_id % 3 = 0
    QUALIFY row_number() OVER (PARTITION BY norm ORDER BY page_id DESC) = 1"""
_AGAIN = f"""SELECT norm, arg_max(letters, page_id) || 'second' AS letters, arg_min(url, page_id) AS first_url, min(page_id) AS first_page, max(page_id) AS last_page
    FROM (SELECT page_id, url, norm, {_LETTERS.format(x=f"regexp_replace({_BARE}, '<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>', '', 'gs')")} AS letters
          FROM pages JOIN o_page_urls USING (url) WHERE page_id % 4 <> 1) GROUP BY norm"""
_MOMENT = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({n} AS INTEGER)), '%Y-%m-%dT%H:%M:00.000Z')"


@query(
    "ingest_pages",
    f"""SELECT coalesce(s.content_id, sha256('web|' || a.norm)) AS content_id, coalesce(s.capture_id, sha256(a.first_url || '|' || {_MOMENT.format(n="2 * a.first_page")})) AS capture_id,
               coalesce(a.norm, s.norm) AS canonical_url, coalesce(a.letters, 'old') AS letters, a.norm IS NOT NULL AS envelope_is_new,
               coalesce({_MOMENT.format(n="2 * a.last_page + 1")}, '2023-01-01T00:00:00.000Z') AS updated
        FROM ({_AGAIN}) a FULL JOIN ({_STORED_PAGES}) s ON a.norm = s.norm""",
)
def _(t):
    n = F.col("page_id")
    stored = t.pages.filter(n % 3 == 0).select(
        F.concat(F.lit("k-"), n.cast("string")).alias("content_id"), F.concat(F.lit("stored-"), n.cast("string")).alias("capture_id"), F.lit("web").alias("source_type"),
        F.col("url").alias("source_url"), F.lit(None).cast("string").alias("canonical_url"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("author"),
        F.lit("old").alias("markdown"), F.lit("good").alias("capture_quality"), F.lit("{}").alias("payload"), F.lit("manual").alias("capture_mode"),
        F.timestamp_seconds(F.lit(1_600_000_000) + n).alias("created_at"), F.to_timestamp(F.lit("2023-01-01 00:00:00")).alias("updated_at"),
    )
    # Two captures of each page, the second one longer and later.
    twice = t.pages.filter(n % 4 != 1).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "*").select(
        (n * 2 + F.col("k")).alias("page_id"), "url", F.when(F.col("k") == 0, F.col("html")).otherwise(F.replace("html", F.lit("</article>"), F.lit("<p>second</p></article>"))).alias("html")
    )
    moment = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + n * 60), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = feed.capture_pages(twice, ct.dedupe_contents(stored), captured_at=moment, whole_page=True)["contents"]
    text = F.get_json_object("payload", "$.document.text")
    return rows.select(
        "content_id", "capture_id", "canonical_url", F.regexp_replace(strip_frontmatter(F.col("markdown")), _NO_LETTERS, "").alias("letters"),
        F.coalesce(text == F.col("markdown"), F.lit(False)).alias("envelope_is_new"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated"),
    )
