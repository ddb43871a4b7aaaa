"""Line-addressed Markdown structure: sections, blocks and tables.

A document stays one row.  One regular expression cuts it into fences and
lines, and fences are blanked without changing the number of lines, so the
position in ``split(text, '\\n')`` stays the line number.  No shuffle, no
running state, and the work is linear in the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import count_matches, extract_all, let, strip
from .text import heading_title, normalize_title

_FRONT = r"\A\r*---\r*\n(?:[\s\S]*?\n)??[ \t\r]*(?:---|\.\.\.)[ \t\r]*(?:\n|\z)"
_LINE = r"[^\n]*\n|[^\n]+\z"
_IS_FRONT = r"\A\r*---\r*\n[\s\S]"

# Section rule: any indent, at least three marks, closed by the same mark.
_SECTION_FENCE = r"[ \t]*(`|~)\1{2,}[^\n]*+(?:[\s\S]*?\n[ \t]*\1{3}[^\n]*+|[\s\S]*)(?:\n|\z)"
# Block rule: a fence counts at a block start only, closed by the same three marks.
_BLOCK_FENCE = r"[^\S\n]*(```|~~~)[^\n]*+(?:[\s\S]*?\n[^\S\n]*\1[^\n]*+|[\s\S]*)(?:\n|\z)"
# Table rule: indent of at most three, closed by at least as many marks.
_TABLE_FENCE = r"\s{0,3}(`{3,}+|~{3,}+)[^\n]*+(?:[\s\S]*?\n[^\S\n]{0,3}\1[^\n]*+|[\s\S]*)(?:\n|\z)"

_CLOSED_FENCE = r"(?U)\A[^\S\n]*(```|~~~)[^\n]*+[\s\S]*?\n[^\S\n]*\1[^\n]*\n?\z"

_BLANK = r"[^\S\n]*\n|[^\S\n]+\z"
_PARAGRAPH = r"[\s\S]+?(?=\n[^\S\n]*(?:\n|\z)|\z)\n?"

_HEADING = r"\A#{1,3}[ \t]+[^\n]+?[ \t\r]*\z"
MAX_SECTIONS = 10


def _blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]+", "")


def _mask(text: Column, pattern: str, masked: str) -> Column:
    """Empty every piece that matches ``masked``, keeping its line breaks."""
    pieces = extract_all(text, pattern)
    return F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike(masked), _blank_lines(p)).otherwise(p)), ""
    )


def _has_fence(text: Column) -> Column:
    return text.contains("```") | text.contains("~~~")


def scan_headings(markdown: Column) -> Column:
    """H1–H3 outside front matter and fences: ``array<struct<line,level,text>>``."""
    masked = F.when(
        _has_fence(markdown) | markdown.rlike(r"\A\r*---"),
        _mask(markdown, f"{_FRONT}|{_SECTION_FENCE}|{_LINE}", rf"\A[ \t]*(?:```|~~~)|{_IS_FRONT}"),
    ).otherwise(markdown)
    lines = F.transform(
        F.split(masked, "\n"), lambda text, i: F.struct(i.alias("line"), text.alias("text"))
    )
    return F.transform(
        F.filter(lines, lambda h: F.startswith(F.ltrim(h["text"]), F.lit("#")) & h["text"].rlike(_HEADING)),
        lambda h: F.struct(
            h["line"].alias("line"),
            F.length(F.regexp_extract(h["text"], r"\A(#{1,3})", 1)).alias("level"),
            F.regexp_extract(h["text"], r"\A#{1,3}[ \t]+([^\n]+?)[ \t\r]*\z", 1).alias("text"),
        ),
    )


def document_title_line(headings: Column, title: Column) -> Column:
    """Line of the leading H1 that repeats the captured title, else NULL."""
    first = F.get(headings, F.lit(0))
    return F.when(
        (first["level"] == 1) & (normalize_title(first["text"]) == normalize_title(title)), first["line"]
    )


def level_count(headings: Column, title_line: Column, level: int) -> Column:
    return F.size(
        F.filter(headings, lambda h: (h["level"] == level) & ~h["line"].eqNullSafe(title_line))
    )


def primary_level(n1: Column, n2: Column, n3: Column) -> Column:
    """Shallowest level with two headings; NULL when that one has more than ten."""
    level = F.lit(None).cast("int")
    for depth, n in [(3, n3), (2, n2), (1, n1)]:
        level = F.when(n >= 2, F.when(n <= MAX_SECTIONS, F.lit(depth))).otherwise(level)
    return level


def section_index(markdown: Column, title: Column) -> Column:
    """Primary level and ordered sections of a document, NULL when none fits."""

    def build(s: Column) -> Column:
        headings, title_line = s["headings"], s["title_line"]
        level = primary_level(*[level_count(headings, title_line, k) for k in (1, 2, 3)])
        return let(
            F.struct(
                level.alias("level"),
                F.size(F.split(s["md"], "\n")).alias("n_lines"),
                headings.alias("headings"),
                title_line.alias("title_line"),
            ),
            lambda t: F.when(
                t["level"].isNotNull(),
                let(
                    F.struct(
                        F.transform(
                            F.filter(t["headings"], lambda h: h["level"] <= t["level"]), lambda h: h["line"]
                        ).alias("bounds"),
                        F.filter(
                            t["headings"],
                            lambda h: (h["level"] == t["level"]) & ~h["line"].eqNullSafe(t["title_line"]),
                        ).alias("starts"),
                    ),
                    lambda u: F.struct(
                        t["level"].alias("primary_heading_level"),
                        F.transform(
                            u["starts"],
                            lambda h, i: F.struct(
                                F.format_string("sec-%03d", i + 1).alias("section_ref"),
                                t["level"].alias("level"),
                                heading_title(F.concat(F.lit("# "), h["text"])).alias("title"),
                                (i + 1).alias("order"),
                                h["line"].alias("start_line"),
                                F.coalesce(
                                    F.get(F.filter(u["bounds"], lambda b: b > h["line"]), F.lit(0)),
                                    t["n_lines"],
                                ).alias("end_line"),
                            ),
                        ).alias("sections"),
                    ),
                ),
            ),
        )

    return let(
        F.struct(markdown.alias("md"), scan_headings(markdown).alias("headings")),
        lambda s: build_with_title(s, title, build),
    )


def build_with_title(s: Column, title: Column, build) -> Column:
    return let(
        F.struct(
            s["md"].alias("md"),
            s["headings"].alias("headings"),
            document_title_line(s["headings"], title).alias("title_line"),
        ),
        build,
    )


def lines_between(markdown: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` … ``end`` (zero-based, half-open) as one text."""
    return F.array_join(
        F.slice(F.split(markdown, "\n"), start + 1, F.greatest(end - start, F.lit(0))), "\n"
    )


# --- blocks -----------------------------------------------------------------
_IMAGE = r"(?U)\A\s*!\[[^\]]*\]\([^)]+\)\s*\z"


def _only(text: Column, mark: str) -> Column:
    return text.rlike(rf"(?U)\A{mark}[{mark}\s]*\z") & (count_matches(text, mark) >= 3)


def block_kind(source: Column, fenced: Column) -> Column:
    """Kind of a block from its stripped text."""
    first = F.regexp_extract(source, r"\A[^\n\r\x0B\f\x1c-\x1e\u0085  ]*", 0)
    return (
        F.when(fenced, F.lit("code"))
        .when(source.rlike(_IMAGE), F.lit("image"))
        .when(_only(source, r"\*") | _only(source, r"\-") | _only(source, "_"), F.lit("separator"))
        .when(first.rlike(r"(?U)\A#{1,6}\s"), F.lit("heading"))
        .when(F.startswith(first, F.lit(">")), F.lit("quote"))
        .when(first.rlike(r"(?U)\A(?:[-+*]|\d+[.)])\s"), F.lit("list"))
        .when(first.contains("|") & source.contains("\n"), F.lit("table"))
        .otherwise(F.lit("paragraph"))
    )


SHARED_KINDS = ["code", "image", "separator"]


def split_blocks(markdown: Column) -> Column:
    """Ordered blocks of a document with half-open line ranges."""
    text = F.replace(markdown, F.lit("\r\n"), F.lit("\n"))
    pieces = extract_all(text, rf"(?U){_FRONT}|{_BLANK}|{_BLOCK_FENCE}|{_PARAGRAPH}")
    marked = F.transform(
        pieces,
        lambda p, i: F.struct(
            p.alias("text"),
            (~p.rlike(r"(?U)\A\s*\z") & ~((i == 0) & p.rlike(_FRONT + r"\z"))).alias("body"),
        ),
    )

    def number(ps: Column) -> Column:
        # One mark per line: "S" where a block starts.  Its index is the line number.
        labels = F.array_join(
            F.transform(
                ps, lambda p: F.concat(F.when(p["body"], F.lit("S")).otherwise(F.lit("")), _blank_lines(p["text"]))
            ),
            "",
        )
        starts = F.filter(
            F.transform(F.split(labels, "\n"), lambda mark, i: F.when(mark == "S", i)),
            lambda i: i.isNotNull(),
        )
        texts = F.transform(F.filter(ps, lambda p: p["body"]), lambda p: p["text"])
        return F.zip_with(starts, texts, lambda start, text: F.struct(start.alias("start"), text.alias("text")))

    def finish(b: Column, i: Column) -> Column:
        # An unclosed fence runs to the end and owns the empty last line too.
        fenced = b["text"].rlike(r"(?U)\A\s*(?:```|~~~)")
        unclosed = fenced & ~b["text"].rlike(_CLOSED_FENCE)
        n_lines = F.size(F.split(b["text"], "\n")) - F.when(
            F.endswith(b["text"], F.lit("\n")) & ~unclosed, F.lit(1)
        ).otherwise(F.lit(0))
        # The stripped text is bound first: its kind looks at it many times.
        judged = let(strip(b["text"]), lambda s: F.struct(s.alias("source"), block_kind(s, fenced).alias("kind")))
        return let(
            judged,
            lambda s: F.struct(
                F.concat(F.lit("b"), (i + 1).cast("string")).alias("id"),
                s["kind"].alias("kind"),
                s["source"].alias("source_markdown"),
                F.lit(None).cast("string").alias("translated_markdown"),
                (~s["kind"].isin(SHARED_KINDS)).alias("translatable"),
                b["start"].alias("start_line"),
                (b["start"] + n_lines).alias("end_line"),
            ),
        )

    return F.transform(let(marked, number), finish)


# --- tables -----------------------------------------------------------------
def count_tables(markdown: Column) -> Column:
    """Header row followed by a delimiter row, outside fences."""
    masked = F.when(
        _has_fence(markdown), _mask(markdown, f"{_TABLE_FENCE}|{_LINE}", r"\A\s{0,3}(?:```|~~~)")
    ).otherwise(markdown)
    row, delimiter = r"(?U)\A\s*\|.*\|\s*\z", r"(?U)\A\s*\|(?:\s*:?-{3,}:?\s*\|)++\s*\z"

    def pairs(lines: Column) -> Column:
        kinds = F.transform(
            lines,
            lambda l: F.when(~l.contains("|"), F.lit(0))
            .when(l.rlike(delimiter), F.lit(2))
            .when(l.rlike(row), F.lit(1))
            .otherwise(F.lit(0)),
        )
        return let(
            kinds,
            lambda k: F.size(
                F.filter(
                    F.zip_with(k, F.slice(k, 2, F.greatest(F.size(k), F.lit(1))), lambda a, b: (a == 1) & (b == 2)),
                    lambda hit: hit,
                )
            ),
        )

    return F.when(masked.contains("|"), let(F.split(masked, "\n"), pairs)).otherwise(F.lit(0))
