"""Queries: sections, blocks, guided reading, translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import source_hash
from ..operators import guided as gd
from ..operators import translation as tr
from .inputs import Inputs, query
from .reading import GUIDED_REASON_SQL, _PLAN, article_plans
from .text import hashed


def headings(t: Inputs) -> DataFrame:
    scanned = t.v_articles.select("doc_id", "title", md.scan_headings(F.col("markdown")).alias("headings"))
    return scanned.withColumn("title_line", md.document_title_line(F.col("headings"), F.col("title")))


@query(
    "scan_headings",
    "SELECT doc_id, line_no AS line, CAST(length(regexp_extract(line, '^(#{1,3})[ \\t]', 1)) AS INT) AS level, regexp_replace(regexp_replace(line, '^#{1,3}[ \\t]+', ''), '[ \\t\\r]*$', '') AS text FROM o_doc_marks WHERE NOT fence AND NOT inside AND regexp_matches(line, '^#{1,3}[ \\t]+.')",
)
def _(t):
    return t.v_markdown.select("doc_id", F.inline(md.scan_headings(F.col("markdown"))))


@query("document_title", "SELECT doc_id, title_line FROM o_article_levels")
def _(t):
    return headings(t).select("doc_id", "title_line")


def levels(t: Inputs) -> DataFrame:
    return headings(t).select(
        "doc_id", *[md.level_count(F.col("headings"), F.col("title_line"), k).alias(f"n{k}") for k in (1, 2, 3)]
    )


@query("level_counts", "SELECT doc_id, CAST(n1 AS INT) AS n1, CAST(n2 AS INT) AS n2, CAST(n3 AS INT) AS n3 FROM o_article_levels")
def _(t):
    return levels(t)


@query("primary_level", "SELECT doc_id, primary_level FROM o_article_primary")
def _(t):
    return levels(t).select("doc_id", md.primary_level(F.col("n1"), F.col("n2"), F.col("n3")).alias("primary_level"))


def sections(t: Inputs) -> DataFrame:
    index = md.section_index(F.col("markdown"), F.col("title"))
    return t.v_articles.select("doc_id", index.alias("index")).select("doc_id", F.inline("index.sections"))


@query("section_ranges", "SELECT doc_id, start_line, end_line FROM o_sections")
def _(t):
    return sections(t).select("doc_id", "start_line", "end_line")


@query(
    "section_index",
    "SELECT doc_id, printf('sec-%03d', ord) AS section_ref, CAST(level AS INT) AS level, title, CAST(ord AS INT) AS ord, start_line, end_line FROM o_sections",
)
def _(t):
    return sections(t).withColumnRenamed("order", "ord")


@query("split_blocks", "SELECT doc_id, id, kind, sha256(src) AS source, translatable, start_line, end_line FROM o_blocks")
def _(t):
    rows = t.v_markdown.select("doc_id", F.inline(md.split_blocks(F.col("markdown"))))
    return rows.select("doc_id", "id", "kind", hashed(F.col("source_markdown")).alias("source"), "translatable", "start_line", "end_line")


@query("block_ids", "SELECT doc_id, id, start_line FROM o_blocks")
def _(t):
    return t.v_markdown.select("doc_id", F.inline(md.split_blocks(F.col("markdown")))).select("doc_id", "id", "start_line")


def with_answers(blocks):
    """Blocks with four of five translations filled in."""

    def fill(b, i):
        text = F.when(b["kind"] == "heading", F.concat(b["source_markdown"], F.lit(" (T)"))).otherwise(
            F.concat(F.lit("T: "), b["source_markdown"])
        )
        return b.withField(
            "translated_markdown", F.when(b["translatable"] & ((F.col("doc_id") + i + 1) % 5 != 0), text)
        )

    return F.transform(blocks, fill)


def article_docs(t: Inputs) -> DataFrame:
    """Articles with plan, map, section index and partly translated blocks."""
    rows = article_plans(t).withColumn("blocks", md.split_blocks(F.col("markdown")))
    return rows.withColumn("blocks", with_answers(F.col("blocks")))


@query(
    "blocks_in_section",
    "SELECT s.doc_id, printf('sec-%03d', s.ord) AS section_ref, b.id, b.start_line FROM o_sections s JOIN o_article_blocks b ON b.doc_id = s.doc_id AND b.start_line >= s.start_line AND b.start_line < s.end_line",
)
def _(t):
    return gd.blocks_in_section(article_docs(t)).select("doc_id", "section_ref", "id", "start_line")


_BODY = """(SELECT string_agg(l.line, chr(10) ORDER BY l.line_no) FROM o_article_lines l WHERE l.doc_id = s.doc_id AND l.line_no > s.start_line AND l.line_no < s.end_line)"""
_ACTION = f"""(SELECT arg_max(p.action, p.ord) FROM ({_PLAN}) p WHERE p.doc_id = s.doc_id AND p.ref = printf('sec-%03d', s.ord))"""
_GUIDED = f"""SELECT s.doc_id, printf('sec-%03d', s.ord) AS section_ref, s.title, coalesce({_ACTION}, 'read') AS action,
       CASE WHEN s.doc_id % 7 = 6 AND s.ord = 1 THEN '' ELSE 'about ' || s.title END AS summary, sha256({_BODY}) AS body FROM o_sections s"""


@query("guided_sections", _GUIDED)
def _(t):
    rows = gd.guided_sections(article_plans(t))
    return rows.select("doc_id", "section_ref", "title", "action", "summary", hashed(F.col("body")).alias("body"))


@query(
    "action_counts",
    f"""SELECT doc_id, count(*) FILTER (action = 'skip') AS skip, count(*) FILTER (action = 'skim') AS skim, count(*) FILTER (action = 'read') AS read,
               count(*) FILTER (action = 'deep_read') AS deep_read FROM ({_GUIDED}) GROUP BY doc_id""",
)
def _(t):
    return gd.action_counts(gd.guided_sections(article_plans(t)))


@query("guided_flow_reason", GUIDED_REASON_SQL)
def _(t):
    reason = gd.guided_flow_reason(F.col("section_index"), F.col("content_map"), F.col("reading_plan"))
    return article_plans(t).select("doc_id", reason.alias("reason"))


@query(
    "context_block",
    """SELECT a.doc_id, coalesce((SELECT string_agg(l.line, chr(10) ORDER BY l.line_no) FROM o_article_lines l
              WHERE l.doc_id = a.doc_id AND l.line_no < (SELECT min(start_line) FROM o_sections s WHERE s.doc_id = a.doc_id)), '') AS context FROM v_articles a""",
)
def _(t):
    return article_plans(t).select("doc_id", gd.context_block(F.col("markdown"), F.col("section_index")).alias("context"))


_TITLES = """SELECT s.doc_id, printf('sec-%03d', s.ord) AS section_ref, s.title,
       coalesce((SELECT trim(regexp_replace(arg_min(b.translated, b.block_no), '^#{1,6}\\s+', '')) FROM o_article_blocks b
                 WHERE b.doc_id = s.doc_id AND b.kind = 'heading' AND b.start_line <= s.start_line AND s.start_line < b.end_line), s.title) AS translated_title FROM o_sections s"""


@query("translated_titles", _TITLES)
def _(t):
    return gd.translated_titles(article_docs(t))


@query(
    "assemble_document",
    "SELECT doc_id, sha256(string_agg(coalesce(translated, src), chr(10) || chr(10) ORDER BY block_no)) AS document FROM o_article_blocks GROUP BY doc_id",
)
def _(t):
    return tr.assemble_document(article_docs(t)).select("doc_id", hashed(F.col("document")).alias("document"))


@query(
    "comparison_view",
    f"""SELECT s.doc_id, printf('sec-%03d', s.ord) AS section_ref, CASE WHEN s.doc_id % 3 = 0 THEN s.title ELSE x.translated_title END AS translated_title,
               coalesce({_ACTION}, 'read') AS action, sha256({_BODY}) AS body,
               sha256(CASE WHEN s.doc_id % 3 = 0 THEN '' ELSE coalesce((SELECT string_agg(coalesce(b.translated, b.src), chr(10) || chr(10) ORDER BY b.block_no) FROM o_article_blocks b
                      WHERE b.doc_id = s.doc_id AND b.start_line > s.start_line AND b.start_line < s.end_line), '') END) AS translated_body,
               s.doc_id % 3 <> 0 AND s.doc_id % 2 = 0 AS annotated
        FROM o_sections s JOIN ({_TITLES}) x ON x.doc_id = s.doc_id AND x.section_ref = printf('sec-%03d', s.ord)""",
)
def _(t):
    n = F.col("doc_id")
    rows = article_docs(t).withColumns(
        {
            "translation_status": F.when(n % 3 == 0, F.lit("running")).otherwise(F.lit("completed")),
            "guided_available": n % 2 == 0,
        }
    )
    return gd.comparison_view(rows).select(
        "doc_id", "section_ref", "translated_title", "action", hashed(F.col("body")).alias("body"),
        hashed(F.col("translated_body")).alias("translated_body"), "annotated",
    )


# --- translation of the Markdown documents ----------------------------------
def stored_translations(t: Inputs) -> DataFrame:
    """Stored translations: some of older text, some failed, some missing."""
    n = F.col("doc_id")
    rows = t.v_markdown.withColumn("blocks", md.split_blocks(F.col("markdown")))
    filled = F.transform(
        "blocks",
        lambda b, i: b.withField(
            "translated_markdown",
            F.when(b["translatable"] & ((F.col("doc_id") + i + 1) % 5 != 0), F.concat(F.lit("T: "), b["source_markdown"])),
        ),
    )
    return rows.select(
        n.alias("content_id"),
        F.when(n % 8 == 7, F.lit("fr")).otherwise(F.lit("zh-CN")).alias("target_language"),
        F.when(n % 7 == 0, F.lit("old")).otherwise(source_hash(F.col("markdown"))).alias("source_hash"),
        F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "failed", "completed")]), (n % 4 + 1).cast("int")).alias("status"),
        filled.alias("blocks"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=((n * 7919) % 100_000).cast("int"))).alias("created_at"),
        n.alias("doc_id"),
        "markdown",
    )


_LANGUAGE = """(SELECT doc_id, CASE WHEN la >= 200 THEN 'en' WHEN doc_id % 3 = 0 THEN 'zh-cn' WHEN la >= 40 THEN 'en' ELSE 'unknown' END AS language
    FROM (SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(markdown, '^---\\n[\\s\\S]*?\\n---\\n', ''), '```[\\s\\S]*?```', ' ', 'g'), '`[^`\\n]+`', ' ', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', ' ', 'g'),
        'https?://[^\\s)>\\]]+', ' ', 'g'), '[^A-Za-z]', '', 'g')) AS la FROM v_markdown))"""


@query(
    "translation_requests",
    f"""SELECT doc_id AS content_id, action, CASE WHEN action IN ('create', 'reset', 'resume') THEN 'pending' WHEN doc_id % 8 <> 7 THEN (['pending', 'running', 'failed', 'completed'])[CAST(doc_id % 4 AS INT) + 1] END AS status,
               CASE WHEN action NOT IN ('create', 'reset') AND doc_id % 8 = 7 THEN NULL ELSE total END AS total_blocks,
               CASE WHEN action IN ('create', 'reset') THEN 0 WHEN doc_id % 8 <> 7 THEN done END AS completed_blocks
        FROM (SELECT d.doc_id, total, done, CASE WHEN language = 'zh-cn' THEN 'already_chinese' WHEN language <> 'en' THEN 'unsupported'
                     WHEN (d.doc_id % 8 = 7 OR d.doc_id % 7 = 0) AND total = 0 THEN 'nothing_to_translate' WHEN d.doc_id % 8 = 7 THEN 'create' WHEN d.doc_id % 7 = 0 THEN 'reset'
                     WHEN d.doc_id % 4 = 2 THEN 'resume' ELSE 'unchanged' END AS action
              FROM {_LANGUAGE} d JOIN (SELECT doc_id, CAST(count(*) FILTER (translatable) AS INT) AS total, CAST(count(translated) AS INT) AS done FROM o_translated GROUP BY doc_id) b ON b.doc_id = d.doc_id)""",
)
def _(t):
    contents = t.v_markdown.select(F.col("doc_id").alias("content_id"), "markdown")
    rows = tr.translation_requests(contents, stored_translations(t))
    return rows.select("content_id", "action", "status", "total_blocks", "completed_blocks")


@query(
    "translation_progress",
    "SELECT doc_id AS content_id, CAST(count(*) FILTER (translatable) AS INT) AS total_blocks, CAST(count(translated) AS INT) AS completed_blocks FROM o_translated GROUP BY doc_id",
)
def _(t):
    return tr.translation_progress(stored_translations(t))


@query(
    "translation_queue",
    "SELECT doc_id AS content_id FROM documents WHERE doc_id % 4 = 0 ORDER BY (doc_id * 7919) % 100000, doc_id LIMIT 50",
)
def _(t):
    return tr.translation_queue(stored_translations(t), 50).select("content_id")


def untranslated(t: Inputs) -> DataFrame:
    """Documents as translation tasks, a quarter of the blocks already done."""
    rows = stored_translations(t)
    done = F.transform(
        "blocks",
        lambda b, i: b.withField("translated_markdown", F.when(i % 4 == 3, b["translated_markdown"])),
    )
    return rows.withColumn("blocks", done)


@query(
    "pack_batches",
    """SELECT content_id, CAST(batch_no AS INT) AS batch_no, string_agg(id, ',' ORDER BY k) AS ids FROM (
           SELECT b.doc_id AS content_id, b.id, b.k, p.batch_no FROM o_packed p JOIN o_open b ON b.doc_id = p.doc_id AND b.k = p.k) GROUP BY ALL""",
)
def _(t):
    packed = tr.pack_batches(untranslated(t))
    ids = F.array_join(F.transform("blocks", lambda b: b["id"]), ",")
    return packed.select("content_id", "batch_no", ids.alias("ids"))


@query(
    "batch_payload",
    """SELECT content_id, CAST(batch_no AS INT) AS batch_no, sha256('{"target_language":"zh-CN","blocks":[' || string_agg('{"id":"' || id || '","markdown":' || to_json(src) || '}', ',' ORDER BY k) || ']}') AS payload
       FROM (SELECT b.doc_id AS content_id, b.id, b.k, b.src, p.batch_no FROM o_packed p JOIN o_open b ON b.doc_id = p.doc_id AND b.k = p.k) GROUP BY ALL""",
)
def _(t):
    rows = tr.batch_payload(tr.pack_batches(untranslated(t)))
    return rows.select("content_id", "batch_no", hashed(F.col("payload")).alias("payload"))


def answered(t: Inputs) -> DataFrame:
    """Batches with a model's answer; some answers break a rule."""
    n = F.col("content_id") + F.col("batch_no")

    def answer(b, i):
        text = F.when((n % 6 == 1) & (i == 0), F.replace(b["source_markdown"], F.lit("`run()`"), F.lit("run"))).otherwise(b["source_markdown"])
        return F.struct(
            F.when((n % 6 == 2) & (i == 0), F.lit("b0")).when((n % 6 == 3) & (i == 1), F.col("blocks")[0]["id"]).otherwise(b["id"]).alias("id"),
            F.when((n % 6 == 4) & (i == 0), F.lit("")).otherwise(F.concat(F.lit("T: "), text)).alias("translated_markdown"),
        )

    return tr.pack_batches(untranslated(t)).withColumn("result", F.transform("blocks", answer))


_PROBLEM = """SELECT content_id, batch_no, CASE WHEN r = 4 THEN 'field' WHEN r = 3 AND n > 1 THEN 'duplicate_id' WHEN r = 2 THEN 'id_mismatch' WHEN r = 1 AND contains(first_src, '`run()`') THEN 'protected_tokens' END AS problem, ids
    FROM (SELECT content_id, CAST(batch_no AS INT) AS batch_no, (content_id + batch_no) % 6 AS r, count(*) AS n, arg_min(src, k) AS first_src, list(id) AS ids
          FROM (SELECT b.doc_id AS content_id, b.id, b.k, b.src, p.batch_no FROM o_packed p JOIN o_open b ON b.doc_id = p.doc_id AND b.k = p.k) GROUP BY ALL)"""


@query("check_batch", f"SELECT content_id, batch_no, problem FROM ({_PROBLEM})")
def _(t):
    return tr.check_batch(answered(t)).select("content_id", "batch_no", "problem")


_MERGED = f"""SELECT b.doc_id AS content_id, CAST(count(*) FILTER (translatable) AS INT) AS total_blocks,
    CAST(count(*) FILTER (translatable AND ((translated IS NOT NULL AND (block_no - 1) % 4 = 3) OR p.id IS NOT NULL)) AS INT) AS completed_blocks
    FROM o_translated b LEFT JOIN (SELECT content_id, unnest(ids) AS id FROM ({_PROBLEM}) WHERE problem IS NULL) p ON p.content_id = b.doc_id AND p.id = b.id GROUP BY b.doc_id"""


def merged(t: Inputs) -> DataFrame:
    return tr.merge_translations(untranslated(t), tr.check_batch(answered(t)))


@query("merge_translations", _MERGED)
def _(t):
    return merged(t).select("content_id", "total_blocks", "completed_blocks")


@query(
    "finish_translation",
    f"""SELECT content_id, CASE WHEN content_id % 9 = 0 THEN 'failed' WHEN completed_blocks = total_blocks THEN 'completed' ELSE 'failed' END AS status,
               CASE WHEN content_id % 9 = 0 THEN 'timeout' WHEN completed_blocks <> total_blocks THEN '翻译块未全部完成：' || completed_blocks || '/' || total_blocks END AS last_error
        FROM ({_MERGED})""",
)
def _(t):
    rows = merged(t).withColumn("status", F.lit("running")).withColumn(
        "error", F.when(F.col("content_id") % 9 == 0, F.lit("timeout"))
    )
    return tr.finish_translation(rows).select("content_id", "status", "last_error")


@query(
    "align_blocks",
    """SELECT doc_id AS content_id, id, NOT translatable AS shared, CASE WHEN doc_id % 3 <> 1 THEN start_line END AS start_line, CASE WHEN doc_id % 3 <> 1 THEN end_line END AS end_line
       FROM o_blocks""",
)
def _(t):
    n = F.col("doc_id")
    bare = F.transform(
        "blocks",
        lambda b: b.withField("start_line", F.lit(None).cast("int"))
        .withField("end_line", F.lit(None).cast("int"))
        .withField("source_markdown", F.when(n % 3 == 1, F.concat(b["source_markdown"], F.lit("!"))).otherwise(b["source_markdown"])),
    )
    rows = tr.align_blocks(stored_translations(t).withColumn("blocks", bare))
    # The outer form keeps the optimizer from aligning the blocks again for a size filter.
    return rows.select("content_id", F.inline_outer("blocks")).filter("id IS NOT NULL").select("content_id", "id", "shared", "start_line", "end_line")
