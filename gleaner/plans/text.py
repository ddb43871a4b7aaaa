"""Queries: scalar text functions over documents, pages and articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as ql
from ..functions import text as tx
from ..functions import urls as ul
from ..functions.markdown import count_tables, scan_headings
from .inputs import Inputs, query



def hashed(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


_STRIPPED = "regexp_replace(markdown, '^---\\n[\\s\\S]*?\\n---\\n', '')"


@query("strip_frontmatter", f"SELECT doc_id, sha256({_STRIPPED}) AS body FROM v_markdown")
def _(t):
    return t.v_markdown.select("doc_id", hashed(tx.strip_frontmatter(F.col("markdown"))).alias("body"))


@query(
    "strip_frontmatter_keyed",
    f"SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN {_STRIPPED} ELSE markdown END) AS body FROM v_markdown",
)
def _(t):
    return t.v_markdown.select("doc_id", hashed(tx.strip_frontmatter_keyed(F.col("markdown"))).alias("body"))


@query(
    "frontmatter_field",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'zh-cn' END AS language, CASE WHEN doc_id % 3 = 0 THEN '2024-01-02' END AS captured_at FROM v_markdown",
)
def _(t):
    return t.v_markdown.select(
        "doc_id", tx.frontmatter_field(F.col("markdown"), "language").alias("language"), tx.frontmatter_field(F.col("markdown"), "captured_at").alias("captured_at")
    )


def _visible(text: str) -> str:
    fenced = f"regexp_replace({text}, '```[\\s\\S]*?```|~~~[\\s\\S]*?~~~', ' ', 'g')"
    code = f"regexp_replace({fenced}, '`[^`\\n]+`', ' ', 'g')"
    image = f"regexp_replace({code}, '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g')"
    return f"regexp_replace({image}, 'https?://[^\\s)>\\]]+', ' ', 'g')"


@query("visible_text", f"SELECT doc_id, sha256({_visible('markdown')}) AS visible FROM v_markdown")
def _(t):
    return t.v_markdown.select("doc_id", hashed(tx.visible_text(F.col("markdown"))).alias("visible"))


@query(
    "detect_language",
    f"""SELECT doc_id, CASE WHEN la >= 200 THEN 'en' WHEN doc_id % 3 = 0 THEN 'zh-cn' WHEN la >= 40 THEN 'en' ELSE 'unknown' END AS language
        FROM (SELECT doc_id, length(regexp_replace({_visible(_STRIPPED)}, '[^A-Za-z]', '', 'g')) AS la FROM v_markdown)""",
)
def _(t):
    return t.v_markdown.select("doc_id", tx.detect_language(F.col("markdown")).alias("language"))


@query(
    "heading_title",
    "SELECT doc_id, line_no, text AS title FROM o_article_headings",
)
def _(t):
    rows = t.v_articles.select("doc_id", F.inline(scan_headings(F.col("markdown"))))
    return rows.select("doc_id", F.col("line").alias("line_no"), tx.heading_title(F.concat(F.lit("# "), "text")).alias("title"))


@query("normalize_title", "SELECT doc_id, lower(regexp_replace(text, '[\\s\\p{P}]', '', 'g')) AS title FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.normalize_title(F.col("text")).alias("title"))


@query(
    "safe_filename",
    """SELECT doc_id, CASE WHEN f = '' THEN '未命名文章' ELSE f END AS name
       FROM (SELECT doc_id, substr(trim(regexp_replace(text, '[\\\\/:*?"<>|\\x00-\\x1f]', '_', 'g')), 1, 80) AS f FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", tx.safe_filename(F.col("text")).alias("name"))


def inline_tokens(t: Inputs) -> DataFrame:
    opening = F.element_at(F.array(*[F.lit(p) for p in ("// ", "/*", " # ", "#", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", F.concat(F.lit("`"), opening, "text", F.lit("`")).alias("token"))


@query(
    "comment_marker",
    """SELECT doc_id, CASE WHEN c LIKE '//%' THEN '//' WHEN c LIKE '/*%' THEN '/*' WHEN regexp_matches(c, '^#(\\s|$)') THEN '#' END AS marker
       FROM (SELECT doc_id, ltrim((['// ', '/*', ' # ', '#', ''])[CAST(doc_id % 5 AS INT) + 1] || rtrim(text, '`')) AS c FROM documents)""",
)
def _(t):
    return inline_tokens(t).select("doc_id", tx.comment_marker(F.col("token")).alias("marker"))


_TOKENS = """list_distinct(list_concat(regexp_extract_all({x}, 'https?://[^\\s)>\\]]+'),
    list_transform(regexp_extract_all({x}, '(?:^|[^`])(`[^`\\n]+`)(?:[^`]|$)', 1), lambda k: CASE WHEN k LIKE '`//%' THEN '//' ELSE k END)))"""


@query(
    "protected_tokens",
    f"SELECT doc_id, array_to_string(list_sort({_TOKENS.format(x='markdown')}), ' ') AS tokens FROM v_markdown",
)
def _(t):
    return t.v_markdown.select("doc_id", F.array_join(F.array_sort(tx.protected_tokens(F.col("markdown"))), " ").alias("tokens"))


_CHANGED = "replace(replace(markdown, '`run()`', 'run'), 'https://e.example.org/p8', 'p8')"


@query(
    "missing_tokens",
    f"""SELECT doc_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS missing
        FROM (SELECT doc_id, {_TOKENS.format(x='markdown')} AS a, {_TOKENS.format(x=_CHANGED)} AS b FROM v_markdown)""",
)
def _(t):
    changed = F.replace(
        F.replace(F.col("markdown"), F.lit("`run()`"), F.lit("run")), F.lit("https://e.example.org/p8"), F.lit("p8")
    )
    return t.v_markdown.select("doc_id", F.array_join(tx.missing_tokens(F.col("markdown"), changed), " ").alias("missing"))


@query(
    "frontmatter_build",
    """SELECT content_id, '---' || chr(10) || 'title: "' || replace(title, '"', '\\"') || '"' || chr(10)
           || CASE WHEN capture_mode = 'manual' THEN 'author: "say \\"hi\\""' || chr(10) ELSE '' END || 'source: "' || source_url || '"' || chr(10)
           || 'captured_at: "2024-01-01T00:00:00.000Z"' || chr(10) || 'language: "en"' || chr(10) || 'extractor: "readability"' || chr(10) || 'quality: "' || capture_quality || '"' || chr(10)
           || CASE capture_quality WHEN 'good' THEN 'warnings: []' ELSE 'warnings:' || chr(10) || '  - "is ' || capture_quality || '"' END || chr(10) || '---' || chr(10) AS header
       FROM v_contents""",
)
def _(t):
    none = F.lit(None).cast("string")
    quality = F.col("capture_quality")
    warnings = F.when(quality == "good", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("is "), quality)))
    header = tx.frontmatter_build(
        F.col("title"), F.when(F.col("capture_mode") == "manual", F.lit('say "hi"')).otherwise(F.lit("")), F.col("source_url"),
        none, none, F.lit("2024-01-01T00:00:00.000Z"), F.lit("en"), F.lit("readability"), quality, warnings,
    )
    return t.v_contents.select("content_id", header.alias("header"))


_SEP = "\\s[|\\-–—\\\\/>»]\\s"


@query(
    "clean_title",
    f"""SELECT page_id, CASE WHEN len(string_split_regex(chosen, '\\s+')) <= 4 AND (NOT regexp_matches(t, '\\s[\\\\/>»]\\s')
                    OR len(string_split_regex(chosen, '\\s+')) <> len(string_split_regex(regexp_replace(t, '{_SEP}', '', 'g'), '\\s+')) - 1) THEN t ELSE chosen END AS title
        FROM (SELECT page_id, t, regexp_replace(trim(CASE WHEN regexp_matches(t, '{_SEP}') THEN CASE WHEN len(string_split_regex(lead, '\\s+')) < 3 THEN regexp_replace(t, '^[^|\\-–—\\\\/>»]*[|\\-–—\\\\/>»]', '') ELSE lead END
                     WHEN (length(t) > 150 OR length(t) < 15) AND h = 1 THEN head ELSE t END), '\\s{{2,}}', ' ', 'g') AS chosen
              FROM (SELECT *, regexp_extract(t, '^(.*){_SEP}', 1) AS lead
                    FROM (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS head,
                                 len(regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS h FROM pages)))""",
)
def _(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    h1s = F.regexp_extract_all("html", F.lit("<h1[^>]*>([^<]*)</h1>"), F.lit(1))
    rows = t.pages.select("page_id", title.alias("raw"), h1s.alias("h1s"))
    return rows.select("page_id", tx.clean_title(F.col("raw"), F.col("h1s"), F.col("h1s")).alias("title"))


def page_links(t: Inputs) -> DataFrame:
    return t.pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href")
    )


# Every link of the pages is a path; only spaces and non-ASCII need escapes.
_ABSOLUTE = "regexp_extract(url, '^[a-z]+://[^/?#]*') || replace(url_encode(href), '%2F', '/')"
_LINKS = """SELECT page_id, url, pos, links[pos] AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages), unnest(generate_series(1, len(links))) AS u(pos)"""
_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace({x}, '%2C', ','), '%24', '$'), '%26', '&'), '%25', '%'), '%2A', '*'), '%3D', '='), '%40', '@'), '%3A', ':')"


@query("absolute_url", f"SELECT page_id, CAST(pos - 1 AS INT) AS pos, {_UNESCAPE.format(x=_ABSOLUTE)} AS target FROM ({_LINKS})")
def _(t):
    return page_links(t).select("page_id", "pos", ul.absolute_url(F.col("href"), F.col("url")).alias("target"))


@query(
    "absolute_srcset",
    f"""SELECT page_id, string_agg({_UNESCAPE.format(x=_ABSOLUTE)} || ' ' || pos || 'x', ', ' ORDER BY pos) AS srcset
        FROM ({_LINKS}) WHERE href NOT LIKE '%,%' GROUP BY page_id""",
)
def _(t):
    links = F.filter(
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), lambda x: F.lit(True)
    )
    numbered = F.filter(
        F.transform(links, lambda x, i: F.when(~F.contains(x, F.lit(",")), F.concat(x, F.lit("  "), (i + 1).cast("string"), F.lit("x")))),
        lambda x: x.isNotNull(),
    )
    rows = t.pages.select("page_id", "url", F.array_join(numbered, ",").alias("raw")).filter("raw <> ''")
    return rows.select("page_id", ul.absolute_srcset(F.col("raw"), F.col("url")).alias("srcset"))


@query(
    "lazy_image_src",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'https://i.example.org/' || doc_id WHEN doc_id % 5 = 0 THEN 'd' || doc_id WHEN doc_id % 2 = 0 THEN 'o' || doc_id
              WHEN doc_id % 7 = 0 THEN 'l' || doc_id WHEN doc_id % 3 = 0 THEN ' ' ELSE 'DATA:image/gif;base64,AA' END AS src FROM documents""",
)
def _(t):
    n = F.col("doc_id")
    name = n.cast("string")
    src = F.when(n % 3 == 0, F.lit(" ")).when(n % 3 == 1, F.lit("DATA:image/gif;base64,AA")).otherwise(F.concat(F.lit("https://i.example.org/"), name))
    out = tx.lazy_image_src(
        src, F.when(n % 5 == 0, F.concat(F.lit("d"), name)), F.when(n % 2 == 0, F.concat(F.lit("o"), name)), F.when(n % 7 == 0, F.concat(F.lit("l"), name))
    )
    return t.documents.select("doc_id", out.alias("src"))


@query(
    "code_language",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'sql' WHEN doc_id % 4 = 1 THEN '' ELSE lang END AS language FROM documents",
)
def _(t):
    n = F.col("doc_id")
    css = F.when(n % 4 == 1, F.concat(F.lit("nolanguage-"), "lang")).otherwise(F.concat(F.lit("hl language-"), "lang", F.lit(" line")))
    return t.documents.select("doc_id", tx.code_language(F.when(n % 4 == 0, F.lit("sql")), css).alias("language"))


_WORDS = "list_filter(string_split_regex(lower({x}), '\\W+'), lambda w: w <> '')"


@query(
    "token_similarity",
    f"""SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN CAST(0 AS DOUBLE)
               ELSE round(1 - length(array_to_string(list_filter(b, lambda w: NOT list_contains(a, w)), ' ')) / length(array_to_string(b, ' ')), 9) END AS similarity
        FROM (SELECT doc_id, {_WORDS.format(x='text')} AS a, {_WORDS.format(x="replace(text, 'ee', 'e')")} AS b FROM documents)""",
)
def _(t):
    sim = tx.token_similarity(F.col("text"), F.replace("text", F.lit("ee"), F.lit("e")))
    return t.documents.select("doc_id", F.round(sim, 9).alias("similarity"))


_TABLES = """SELECT doc_id, CAST(count(*) FILTER (delim AND prev_row) AS INT) AS tables FROM (
    SELECT doc_id, delim, coalesce(lag(rowlike AND NOT delim) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS prev_row FROM (
        SELECT doc_id, line_no, NOT fence AND NOT inside AND regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AS rowlike,
               NOT fence AND NOT inside AND regexp_matches(line, '^\\s*\\|(\\s*:?-{3,}:?\\s*\\|)+\\s*$') AS delim FROM o_doc_marks)) GROUP BY doc_id"""


@query("count_tables", _TABLES)
def _(t):
    return t.v_markdown.select("doc_id", count_tables(F.col("markdown")).alias("tables"))


@query(
    "table_cell",
    "SELECT doc_id, sha256(trim(replace(regexp_replace(regexp_replace(text || chr(10) || 'a | b', '\\r?\\n+', ' ', 'g'), '\\s{2,}', ' ', 'g'), '|', '\\|'))) AS cell FROM documents",
)
def _(t):
    return t.documents.select("doc_id", hashed(tx.table_cell(F.concat("text", F.lit("\na | b")))).alias("cell"))


@query(
    "unescape_entities",
    "SELECT doc_id, sha256('<' || text || '\"&lt; A中' || chr(65533) || '😀&') AS text_hash FROM documents",
)
def _(t):
    escaped = F.concat(F.lit("&lt;"), "text", F.lit("&quot;&amp;lt; &#65;&#x4E2D;&#xD800;&#128512;&amp;"))
    return t.documents.select("doc_id", hashed(tx.unescape_entities(escaped)).alias("text_hash"))


_METRICS = f"""SELECT m.doc_id, length(regexp_replace(markdown, '\\s', '', 'g')) AS char_count,
       CAST(len(list_filter(regexp_split_to_array(markdown, '\\n\\s*\\n'), lambda p: trim(p, ' ' || chr(10)) <> '')) AS INT) AS paragraphs,
       CAST(floor(length(array_to_string(regexp_extract_all(markdown, '\\[[^\\]]*\\]\\([^)]*\\)'), '')) / length(markdown) * 100 + 0.5) AS INT) AS link_ratio,
       CAST(len(regexp_extract_all(markdown, '(?m)^#{{1,6}} ')) AS INT) AS headings,
       CAST(floor(len(regexp_extract_all(markdown, '```')) / 2) AS INT) AS code_blocks, t.tables,
       CAST(len(regexp_extract_all(markdown, '!\\[[^\\]]*\\]\\([^)]*\\)')) AS INT) AS images
FROM v_markdown m JOIN ({_TABLES}) t ON t.doc_id = m.doc_id"""


@query("text_metrics", f"SELECT * REPLACE (CAST(char_count AS INT) AS char_count) FROM ({_METRICS})")
def _(t):
    return t.v_markdown.select("doc_id", ql.text_metrics(F.col("markdown")).alias("m")).select("doc_id", "m.*")


@query(
    "content_type",
    f"SELECT doc_id, CASE WHEN code_blocks >= 2 THEN 'technical-article' WHEN tables >= 3 THEN 'documentation' ELSE 'article' END AS content_type FROM ({_METRICS})",
)
def _(t):
    rows = t.v_markdown.select("doc_id", ql.text_metrics(F.col("markdown")).alias("m"))
    return rows.select("doc_id", ql.content_type(F.col("m.code_blocks"), F.col("m.tables")).alias("content_type"))


@query(
    "normalize_quality",
    "SELECT content_id, CASE WHEN capture_mode = 'manual' AND capture_quality IN ('good', 'poor') THEN capture_quality ELSE 'warning' END AS level FROM v_contents",
)
def _(t):
    level = F.when(F.col("capture_mode") == "manual", F.col("capture_quality")).otherwise(F.lit("unheard of"))
    return t.v_contents.select("content_id", ql.normalize_quality(level).alias("level"))


def spaced(t: Inputs) -> DataFrame:
    """Documents with every line as a paragraph of its own."""
    return t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown"))


_PARAS = """SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> '') AS ps FROM documents"""
_DUP = f"""SELECT doc_id, text, n, dup, CASE WHEN n >= 4 AND dup >= greatest(2, floor(n * CAST(0.2 AS DOUBLE) + 0.5)) THEN CAST(floor(dup / n * 100 + 0.5) AS INT) END AS ratio
    FROM (SELECT doc_id, text, len(ps) AS n, len(ps) - len(list_distinct(ps)) AS dup FROM ({_PARAS}))"""


@query("duplicate_paragraphs", f"SELECT doc_id, ratio FROM ({_DUP})")
def _(t):
    return spaced(t).select("doc_id", ql.duplicate_paragraphs(F.col("markdown")).alias("ratio"))


_LOGIN = " OR ".join(f"contains(text, '{p}')" for p in ql.LOGIN_PHRASES)


@query(
    "quality_report",
    f"""SELECT doc_id, CASE WHEN chars = 0 THEN 'failed' WHEN chars < 100 THEN 'poor' WHEN w <> '' THEN 'warning' ELSE 'good' END AS level,
               CASE WHEN chars = 0 THEN '{ql.WARN_EMPTY}' ELSE w END AS warnings
        FROM (SELECT doc_id, chars, concat_ws(';', CASE WHEN chars < 100 THEN '{ql.WARN_TOO_SHORT}' WHEN chars < 300 THEN '{ql.WARN_SHORT}' END,
                     CASE WHEN login THEN '{ql.WARN_LOGIN}' END, CASE WHEN headings = 0 AND chars > 500 THEN '{ql.WARN_NO_HEADING}' END,
                     CASE WHEN ratio IS NOT NULL THEN '检测到重复段落（重复比 ' || ratio || '%），疑似模板/复制内容' END) AS w
              FROM (SELECT doc_id, ratio, length(regexp_replace(text, '\\s', '', 'g')) AS chars, {_LOGIN} AS login, len(regexp_extract_all(text, '(?m)^#{{1,6}} ')) AS headings FROM ({_DUP})))""",
)
def _(t):
    rows = spaced(t).select("doc_id", ql.quality_report(F.col("markdown")).alias("q"))
    return rows.select("doc_id", "q.level", F.array_join("q.warnings", ";").alias("warnings"))
