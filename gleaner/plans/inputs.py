"""The given tables and the derived views the queries run on.

``VIEWS`` holds SQL that is valid in Spark and in DuckDB; a pair gives the two
dialects where they differ.  ``ORACLE_VIEWS`` are helper relations that only
the independent SQL checks use.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["pages", "documents", "conversations", "labels", "events", "customer", "benchmark"]

VIEWS: dict[str, str | tuple[str, str]] = {}

# One row per document; title and address come from the page with the same id, if there is one.
VIEWS["v_contents"] = """
SELECT 'c' || n AS content_id, 'cap-' || lpad(CAST(n AS STRING), 8, '0') AS capture_id,
       'web' AS source_type, url AS source_url,
       CASE WHEN n % 4 = 0 THEN 'automatic' ELSE 'manual' END AS capture_mode, title,
       CASE n % 7 WHEN 0 THEN 'poor' WHEN 1 THEN 'warning' ELSE 'good' END AS capture_quality,
       '# ' || title || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS markdown,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '37' MINUTE * n AS created_at
FROM (SELECT d.doc_id AS n, d.text, coalesce(p.url, 'https://docs.example.org/d/' || d.doc_id) AS url,
             coalesce(regexp_extract(p.html, '<title>([^<]*)</title>', 1), 'Document ' || d.doc_id) AS title
      FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id) c
"""

# One or two analyses per content, up to three windows per owner.
VIEWS["v_attempts"] = (
    "SELECT doc_id AS n, explode(sequence(1, 1 + doc_id % 2)) AS k FROM documents",
    "SELECT doc_id AS n, unnest(generate_series(1, 1 + doc_id % 2)) AS k FROM documents",
)
VIEWS["v_owner_slots"] = (
    "SELECT c_custkey, explode(sequence(0, CAST(c_custkey % 3 AS INT))) AS k FROM customer",
    "SELECT c_custkey, CAST(unnest(generate_series(0, c_custkey % 3)) AS INT) AS k FROM customer",
)

# The newest analysis of a content wins.
VIEWS["v_analyses"] = """
SELECT 'a' || c.n || '-' || c.k AS analysis_id, 'c' || c.n AS content_id,
       CASE c.n % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 4 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN c.n % 5 IN (2, 3) AND c.n % 10 <> 3 THEN
            CASE (c.n * 7 + c.k) % 4 WHEN 0 THEN 'ignore' WHEN 1 THEN 'summary_enough' WHEN 2 THEN 'selective_read' ELSE 'deep_read' END END AS evaluation_recommendation,
       CASE WHEN c.n % 10 = 3 THEN 'ignore' WHEN c.n % 5 <> 0 THEN 'continue' END AS triage_decision,
       CASE WHEN c.n % 6 = 0 THEN 'outside_profile_high_value' WHEN c.n % 6 < 3 THEN 'adjacent' ELSE 'profile_match' END AS discovery_type,
       TIMESTAMP '2024-01-01 00:05:00' + INTERVAL '37' MINUTE * c.n + INTERVAL '10' MINUTE * c.k AS created_at
FROM v_attempts c
"""

VIEWS["v_jobs"] = """
SELECT 'j' || analysis_id AS job_id, analysis_id,
       CASE status WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'analyze' WHEN 'running' THEN 'evaluate' ELSE 'triage' END AS stage,
       CASE status WHEN 'running' THEN 'pending' ELSE status END AS status,
       CASE WHEN status IN ('pending', 'running') AND CAST(substr(content_id, 2) AS BIGINT) % 3 = 0 THEN created_at + INTERVAL '15' MINUTE END AS immediate_requested_at,
       created_at
FROM v_analyses
"""

# Append-only edits, ten per analysis.
VIEWS["v_feedback_events"] = """
SELECT event_id, 'a' || k || '-1' AS analysis_id, ts,
       CASE k % 5 WHEN 0 THEN 'ignore' WHEN 1 THEN 'summary_enough' WHEN 2 THEN 'selective_read' WHEN 3 THEN 'deep_read' ELSE 'selective_read' END AS ai_recommendation,
       CASE event_type WHEN 'view' THEN 'ignore' WHEN 'click' THEN 'summary_enough' WHEN 'signup' THEN 'selective_read' WHEN 'purchase' THEN 'deep_read' END AS preferred_recommendation,
       CASE event_id % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'partly' ELSE 'yes' END AS time_worthwhile,
       CASE event_id % 4 WHEN 0 THEN 'accurate' WHEN 1 THEN 'omission' WHEN 2 THEN 'misleading' ELSE 'not_sure' END AS summary_quality,
       CASE WHEN event_id % 2 = 0 THEN 'model-a' ELSE 'model-b' END AS model,
       'v' || (event_id % 3) AS prompt_version
FROM (SELECT *, CAST(floor(event_id / 10) AS BIGINT) AS k FROM events) e
"""

# Pages captured again with tracking noise and newer text, plus new transcripts.
VIEWS["v_captures"] = """
SELECT 'cap-' || lpad(CAST(page_id AS STRING), 8, '0') AS capture_id, 'web' AS source_type, url, 'v1 of ' || page_id AS text,
       'Page ' || page_id AS title, CASE page_id % 9 WHEN 0 THEN 'failed' ELSE 'good' END AS quality,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '37' MINUTE * page_id AS captured_at
FROM pages
UNION ALL
SELECT 'rep-' || lpad(CAST(page_id AS STRING), 8, '0'), 'web',
       CASE WHEN url LIKE '%?%' THEN replace(url, '?', '?utm_medium=mail&') WHEN url LIKE '%#%' THEN replace(url, '#', '?from=inbox#') ELSE url || '?from=inbox' END,
       'v2 of ' || page_id, 'Page ' || page_id || ' again', CASE page_id % 11 WHEN 0 THEN 'failed' ELSE 'warning' END,
       TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '37' MINUTE * page_id
FROM pages
UNION ALL
SELECT 'talk-' || lpad(CAST(conv_id AS STRING), 8, '0') || '-' || turn, 'podcast', 'https://talks.example.org/t/' || conv_id, text,
       'Talk ' || conv_id, CASE WHEN (conv_id + turn) % 5 = 0 OR conv_id % 13 = 0 THEN 'failed' ELSE 'good' END,
       TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' MINUTE * (conv_id * 100 + turn)
FROM conversations
"""

VIEWS["v_schedule_windows"] = """
SELECT '01:00' AS start_at, '08:00' AS end_at UNION ALL SELECT '23:00' AS start_at, '00:30' AS end_at
"""

# One article per conversation, an H2 per turn.
_ARTICLE = "'# Conversation ' || conv_id || chr(10) || chr(10) || %s"
_TURN = "'## Turn ' || turn || ' ' || role || chr(10) || chr(10) || text || chr(10)"
VIEWS["v_articles"] = (
    f"SELECT conv_id AS doc_id, 'Conversation ' || conv_id AS title, {_ARTICLE % f'listagg({_TURN}, chr(10)) WITHIN GROUP (ORDER BY turn)'} AS markdown FROM conversations GROUP BY conv_id",
    f"SELECT conv_id AS doc_id, 'Conversation ' || conv_id AS title, {_ARTICLE % f'string_agg({_TURN}, chr(10) ORDER BY turn)'} AS markdown FROM conversations GROUP BY conv_id",
)

# Documents given Markdown structure: the line number decides the block form.
_FORM = """CASE {i} % 9
    WHEN 0 THEN '## ' || l
    WHEN 1 THEN l
    WHEN 2 THEN '- ' || l || chr(10) || '- item'
    WHEN 3 THEN '> ' || l
    WHEN 4 THEN '```js' || chr(10) || l || chr(10) || chr(10) || '# no heading' || chr(10) || '```'
    WHEN 5 THEN '![img](https://e.example.org/i.png)'
    WHEN 6 THEN '---'
    WHEN 7 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| `x` | ' || replace(l, '|', '/') || ' |'
    ELSE 'See `run()` and `// note` at https://e.example.org/p' || {i} || ' ' || l END"""
_FRONT = """CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'language: "zh_CN"' || chr(10) || 'captured_at: "2024-01-02"' || chr(10) || '---' || chr(10)
    WHEN 1 THEN '---' || chr(10) || chr(10) || 'no key here' || chr(10) || '---' || chr(10) ELSE '' END"""
VIEWS["v_markdown"] = (
    f"SELECT doc_id, 'Document ' || doc_id AS title, {_FRONT} || array_join(transform(split(text, chr(10)), (l, i) -> {_FORM.format(i='i')}), chr(10) || chr(10)) AS markdown FROM documents",
    f"SELECT doc_id, 'Document ' || doc_id AS title, {_FRONT} || array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: {_FORM.format(i='(i - 1)')}), chr(10) || chr(10)) AS markdown FROM documents",
)

def _clock(minutes: str) -> str:
    return (
        f"lpad(CAST(CAST(floor(({minutes}) % 1440 / 60) AS INT) AS STRING), 2, '0') || ':' || "
        f"lpad(CAST(CAST(({minutes}) % 60 AS INT) AS STRING), 2, '0')"
    )


# Up to three windows per owner; some are empty, some overlap.
VIEWS["v_owner_windows"] = f"""
SELECT c_custkey AS owner_id, w.k AS window_no,
       {_clock('c_custkey * 7 + w.k * 480')} AS start_at,
       {_clock('c_custkey * 7 + w.k * 480 + c_custkey % 11 * 60')} AS end_at
FROM v_owner_slots w
"""

# Reader profiles: every second one finished the questionnaire.
VIEWS["v_profiles"] = """
SELECT 'u' || c_custkey AS user_id, c_mktsegment AS focus, 'topic ' || (c_custkey % 7) AS topic,
       CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'level ' || (c_custkey % 3) END AS topic_level,
       'goal ' || (c_custkey % 5) AS goal,
       CASE c_custkey % 3 WHEN 0 THEN 'deep' ELSE 'brief' END AS preferred_depth,
       CAST(10 + c_custkey % 30 AS INT) AS time_budget_minutes,
       CASE c_custkey % 3 WHEN 0 THEN 'high' ELSE 'low' END AS exploration_level,
       CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS questionnaire_completed_at
FROM customer
"""

# --- helper relations of the checks ----------------------------------------
ORACLE_VIEWS: dict[str, str] = {}

ORACLE_VIEWS["o_feedback"] = """
SELECT analysis_id, first(ai_recommendation ORDER BY ts, event_id) AS ai,
       last(preferred_recommendation ORDER BY ts, event_id) AS pref,
       last(time_worthwhile ORDER BY ts, event_id) AS worthwhile,
       last(summary_quality ORDER BY ts, event_id) AS summary_quality,
       first(model ORDER BY ts, event_id) AS model, first(prompt_version ORDER BY ts, event_id) AS prompt_version,
       min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n
FROM v_feedback_events GROUP BY analysis_id
"""
_RANK = "CASE {c} WHEN 'ignore' THEN 0 WHEN 'summary_enough' THEN 1 WHEN 'selective_read' THEN 2 WHEN 'deep_read' THEN 3 END"
ORACLE_VIEWS["o_ranked"] = f"""
SELECT *, CASE WHEN ai_rank > pref_rank THEN 'too_high' WHEN ai_rank < pref_rank THEN 'too_low' WHEN ai_rank = pref_rank THEN 'accurate' END AS accuracy
FROM (SELECT *, {_RANK.format(c='ai')} AS ai_rank, {_RANK.format(c='pref')} AS pref_rank FROM o_feedback)
"""
ORACLE_VIEWS["o_latest"] = """
SELECT * FROM v_analyses QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY created_at DESC, analysis_id) = 1
"""

# Query string: decode, drop tracking keys, sort, encode.  Host and path by regular expressions.
_URL = """
SELECT url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1))
       || CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/'
               ELSE rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') END
       || coalesce('?' || (SELECT string_agg(p.part, '&' ORDER BY split_part(p.part, '=', 1), p.part) FROM (
              SELECT unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS part) p
            WHERE p.part <> '' AND lower(split_part(p.part, '=', 1)) NOT IN ('entry','fbclid','from','gclid','mc_cid','mc_eid','ref','referrer')
              AND lower(split_part(p.part, '=', 1)) NOT LIKE 'utm#_%' ESCAPE '#'), '') AS norm
FROM {source}
"""
ORACLE_VIEWS["o_page_urls"] = _URL.replace("{source}", "(SELECT url FROM pages UNION SELECT source_url FROM v_contents)")
ORACLE_VIEWS["o_capture_urls"] = _URL.replace("{source}", "(SELECT DISTINCT url FROM v_captures)")

# Lines, headings and sections of the articles (no fences, no front matter).
ORACLE_VIEWS["o_article_lines"] = """
SELECT doc_id, title, CAST(i AS INT) - 1 AS line_no, lines[i] AS line, len(lines) AS n_lines
FROM (SELECT doc_id, title, string_split(markdown, chr(10)) AS lines FROM v_articles), unnest(generate_series(1, len(lines))) AS t(i)
"""
ORACLE_VIEWS["o_article_headings"] = """
SELECT doc_id, title, n_lines, line_no, length(regexp_extract(line, '^(#{1,3})[ \\t]', 1)) AS level,
       trim(regexp_replace(regexp_replace(line, '^#{1,3}[ \\t]+', ''), '[ \\t]+#+[ \\t]*$', '')) AS text,
       row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n
FROM o_article_lines WHERE regexp_matches(line, '^#{1,3}[ \\t]+.')
"""
ORACLE_VIEWS["o_article_levels"] = """
SELECT doc_id, title, n_lines, max(CASE WHEN n = 1 AND level = 1 AND text = title THEN line_no END) AS title_line,
       count(*) FILTER (level = 1 AND NOT (n = 1 AND text = title)) AS n1,
       count(*) FILTER (level = 2) AS n2, count(*) FILTER (level = 3) AS n3
FROM o_article_headings GROUP BY ALL
"""
ORACLE_VIEWS["o_article_primary"] = """
SELECT *, CASE WHEN n1 >= 2 THEN CASE WHEN n1 <= 10 THEN 1 END WHEN n2 >= 2 THEN CASE WHEN n2 <= 10 THEN 2 END
               WHEN n3 >= 2 THEN CASE WHEN n3 <= 10 THEN 3 END END AS primary_level
FROM o_article_levels
"""
ORACLE_VIEWS["o_sections"] = """
SELECT doc_id, level, text AS title, line_no AS start_line, CAST(end_line AS INT) AS end_line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ord
FROM (SELECT h.*, p.primary_level, p.title_line,
             coalesce(lead(h.line_no) OVER (PARTITION BY h.doc_id ORDER BY h.line_no), h.n_lines) AS end_line
      FROM o_article_headings h JOIN o_article_primary p USING (doc_id) WHERE h.level <= p.primary_level)
WHERE level = primary_level AND line_no IS DISTINCT FROM title_line
"""

# Lines and blocks of the Markdown documents: fences of that view never nest.
ORACLE_VIEWS["o_doc_lines"] = """
SELECT doc_id, CAST(i AS INT) - 1 AS line_no, lines[i] AS line,
       CASE doc_id % 3 WHEN 2 THEN 0 ELSE 4 END AS body_start
FROM (SELECT doc_id, string_split(markdown, chr(10)) AS lines FROM v_markdown), unnest(generate_series(1, len(lines))) AS t(i)
"""
ORACLE_VIEWS["o_doc_marks"] = """
SELECT *, fence AND fences_before % 2 = 0 AS opens, fences_before % 2 = 1 AS inside,
       NOT regexp_matches(line, '^\\s*$') OR fences_before % 2 = 1 AS in_block
FROM (SELECT *, line LIKE '```%' AS fence,
             coalesce(sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences_before
      FROM o_doc_lines WHERE line_no >= body_start)
"""
ORACLE_VIEWS["o_doc_starts"] = """
SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no
FROM (SELECT *, in_block AND (lag(in_block) OVER w IS NULL OR NOT lag(in_block) OVER w OR (lag(fence) OVER w AND lag(inside) OVER w)) AS starts
      FROM o_doc_marks WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
"""
ORACLE_VIEWS["o_blocks"] = """
SELECT doc_id, CAST(block_no AS INT) AS block_no, 'b' || CAST(block_no AS INT) AS id, start_line, end_line, src,
       kind, kind NOT IN ('code', 'image', 'separator') AS translatable
FROM (SELECT *, CASE WHEN fenced THEN 'code' WHEN regexp_matches(src, '^!\\[[^\\]]*\\]\\([^)]+\\)$') THEN 'image'
                     WHEN regexp_matches(src, '^-[-\\s]*$') AND length(replace(src, '-', '')) <= length(src) - 3 THEN 'separator'
                     WHEN regexp_matches(first_line, '^#{1,6}\\s') THEN 'heading' WHEN first_line LIKE '>%' THEN 'quote'
                     WHEN regexp_matches(first_line, '^([-+*]|[0-9]+[.)])\\s') THEN 'list'
                     WHEN first_line LIKE '%|%' AND contains(src, chr(10)) THEN 'table' ELSE 'paragraph' END AS kind
      FROM (SELECT *, string_split(src, chr(10))[1] AS first_line
            FROM (SELECT doc_id, block_no, min(line_no) AS start_line, max(line_no) + 1 AS end_line, bool_or(opens) AS fenced,
                         regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS src
                  FROM o_doc_starts WHERE in_block GROUP BY doc_id, block_no)))
"""
# Stored translations of those blocks: four of five translatable blocks are done.
ORACLE_VIEWS["o_translated"] = """
SELECT b.*, CASE WHEN translatable AND (doc_id + block_no) % 5 <> 0 THEN 'T: ' || src END AS translated
FROM o_blocks b
"""

# Blocks of the articles: runs of non-blank lines.
ORACLE_VIEWS["o_article_blocks"] = """
SELECT *, 'b' || block_no AS id, CASE WHEN translatable AND (doc_id + block_no) % 5 <> 0 THEN CASE WHEN kind = 'heading' THEN src || ' (T)' ELSE 'T: ' || src END END AS translated
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS INT) AS block_no, kind NOT IN ('image', 'separator') AS translatable
      FROM (SELECT doc_id, start_line, end_line, src,
                   CASE WHEN regexp_matches(src, '^!\\[[^\\]]*\\]\\([^)]+\\)$') THEN 'image'
                        WHEN regexp_matches(src, '^([*][*\\s]*|-[-\\s]*|_[_\\s]*)$') AND length(regexp_replace(src, '\\s', '', 'g')) >= 3 THEN 'separator'
                        WHEN regexp_matches(f, '^#{1,6}\\s') THEN 'heading' WHEN f LIKE '>%' THEN 'quote' WHEN regexp_matches(f, '^([-+*]|[0-9]+[.)])\\s') THEN 'list'
                        WHEN contains(f, '|') AND contains(src, chr(10)) THEN 'table' ELSE 'paragraph' END AS kind
            FROM (SELECT *, string_split(src, chr(10))[1] AS f
                  FROM (SELECT doc_id, min(line_no) AS start_line, max(line_no) + 1 AS end_line, trim(string_agg(line, chr(10) ORDER BY line_no)) AS src
                        FROM (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM o_article_lines WHERE trim(line) <> '')
                        GROUP BY doc_id, island))))
"""

# Open blocks of the translation tasks, and their greedy packing as a recursion.
ORACLE_VIEWS["o_open"] = """
SELECT doc_id, id, src, length(src) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS k
FROM o_translated WHERE translatable AND NOT (translated IS NOT NULL AND (block_no - 1) % 4 = 3)
"""
ORACLE_VIEWS["o_packed"] = """
SELECT doc_id, k, len AS chars, 1 AS n, 1 AS batch_no FROM o_open WHERE k = 1
UNION ALL
SELECT b.doc_id, b.k, CASE WHEN p.n >= 12 OR p.chars + b.len > 6000 THEN b.len ELSE p.chars + b.len END,
       CASE WHEN p.n >= 12 OR p.chars + b.len > 6000 THEN 1 ELSE p.n + 1 END,
       CASE WHEN p.n >= 12 OR p.chars + b.len > 6000 THEN p.batch_no + 1 ELSE p.batch_no END
FROM o_packed p JOIN o_open b ON b.doc_id = p.doc_id AND b.k = p.k + 1
"""


def _sides(name: str) -> tuple[str, str]:
    view = VIEWS[name]
    return view if isinstance(view, tuple) else (view, view)


_NAME = re.compile(r"\b([vo]_[a-z_]+)\b")


def oracle(sql: str) -> str:
    """Complete check query: the named helper relations become CTEs."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            body = ORACLE_VIEWS.get(name) or (name in VIEWS and _sides(name)[1])
            if body and name not in seen:
                seen.add(name)
                visit(body)
                order.append(name)

    visit(sql)
    ctes = ", ".join(f"{n} AS ({(ORACLE_VIEWS.get(n) or _sides(n)[1]).strip()})" for n in order)
    return f"WITH RECURSIVE {ctes} {sql.strip()}" if order else sql.strip()


class Inputs:
    """Lazily opened tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._open(name)
        return self._cache[name]

    def _open(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sql = _sides(name)[0]
        used = [n for n in [*TABLES, *VIEWS] if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
        for n in used:
            sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **{n: getattr(self, n) for n in used}) if used else self.spark.sql(sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its independent SQL where one can be written."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register


def stamp(ts) -> F.Column:
    """Timestamps leave the queries as text, so that both engines agree on them."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
