"""Scalar text functions over Markdown, titles, file names and inline code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import JS_SPACE, count_matches, extract_all, let, nonempty, strip

FRONTMATTER = r"\A---\r?\n([\s\S]*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)"
URL = r"(?U)https?://[^\s)>\]]+"
DEFAULT_TITLE = "未命名文章"  # fixed value: name of a page without a title


def strip_frontmatter(markdown: Column) -> Column:
    """Drop a leading ``---`` block."""
    return F.regexp_replace(markdown, FRONTMATTER, "")


def strip_frontmatter_keyed(markdown: Column) -> Column:
    """Drop a leading ``---`` block only if it holds a ``key:`` line."""
    body = F.regexp_extract(markdown, FRONTMATTER, 1)
    return F.when(body.rlike(r"(?m)^[A-Za-z_][\w-]*\s*:"), strip_frontmatter(markdown)).otherwise(markdown)


def frontmatter_field(markdown: Column, field: str) -> Column:
    """``language`` (lower case, ``_`` → ``-``) or ``captured_at`` of the front matter."""
    if field == "captured_at":
        return nonempty(F.regexp_extract(markdown, r'(?m)^captured_at:\s*"([^"]+)"', 1))
    body = F.regexp_extract(markdown, FRONTMATTER, 1)
    value = F.regexp_extract(body, r"(?Umd)^" + field + r"\s*:\s*[\"']?([^\"'\s]+)", 1)
    return nonempty(F.lower(F.replace(value, F.lit("_"), F.lit("-"))))


def visible_text(markdown: Column) -> Column:
    """Blank out code, images and addresses, which say nothing about the language."""
    out = F.regexp_replace(markdown, r"```[\s\S]*?```|~~~[\s\S]*?~~~", " ")
    out = F.regexp_replace(out, r"`[^`\n]+`", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]+\)", " ")
    return F.regexp_replace(out, URL, " ")


def detect_language(markdown: Column) -> Column:
    """Body evidence first, front matter second, weak body evidence last."""
    visible = visible_text(strip_frontmatter(markdown))
    counts = let(
        visible,
        lambda v: F.struct(
            count_matches(v, r"[㐀-鿿]").alias("zh"),
            count_matches(v, r"[A-Za-z]").alias("la"),
        ),
    )
    return let(
        counts,
        lambda c: F.when((c["la"] >= 200) & (c["la"] > c["zh"] * 4), F.lit("en"))
        .when((c["zh"] >= 50) & (c["zh"] >= c["la"] / 2), F.lit("zh-CN"))
        .when(frontmatter_field(markdown, "language").isNotNull(), frontmatter_field(markdown, "language"))
        .when((c["zh"] >= 20) & (c["zh"] >= c["la"] / 2), F.lit("zh-CN"))
        .when((c["la"] >= 40) & (c["la"] > c["zh"] * 2), F.lit("en"))
        .otherwise(F.lit("unknown")),
    )


def source_hash(markdown: Column) -> Column:
    return F.sha2(markdown.cast("binary"), 256)


def heading_title(line: Column) -> Column:
    """Text of an ATX heading line, without its marks."""
    text = F.regexp_extract(line, r"\A(#{1,3})[ \t]+([^\n]+?)[ \t\r]*\z", 2)
    return strip(F.regexp_replace(text, r"[ \t]+#+[ \t\r]*\z", ""))


def plain_heading(text: Column) -> Column:
    """Text of a translated heading block."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)\A#{1,6}\s+", ""), r"[ \t]+#+[ \t]*\z", ""))


def normalize_title(text: Column) -> Column:
    """Comparable form of a title: no white space, no punctuation, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\p{P}]", ""))


def safe_filename(title: Column) -> Column:
    clean = F.regexp_replace(title, r'[\\/:*?"<>|\u0000-\u001f]', "_")
    trimmed = F.regexp_replace(clean, rf"\A[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")
    return F.coalesce(nonempty(F.substring(trimmed, 1, 80)), F.lit(DEFAULT_TITLE))


def comment_marker(token: Column) -> Column:
    """Comment mark that opens an inline code span, NULL for real code."""
    content = F.regexp_replace(F.regexp_replace(token, r"\A`+|`+\z", ""), r"(?U)\A\s+", "")
    return (
        F.when(F.startswith(content, F.lit("//")), F.lit("//"))
        .when(F.startswith(content, F.lit("/*")), F.lit("/*"))
        .when(content.rlike(r"(?U)\A#(?:\s|\z)"), F.lit("#"))
    )


def protected_tokens(markdown: Column) -> Column:
    """Addresses and inline code a translation must keep, without repeats."""
    code = extract_all(markdown, r"(?<!`)`[^`\n]+`(?!`)")
    kept = F.transform(code, lambda token: F.coalesce(comment_marker(token), token))
    return F.array_distinct(F.concat(extract_all(markdown, URL), kept))


def missing_tokens(source: Column, translated: Column) -> Column:
    return F.array_sort(F.array_except(protected_tokens(source), protected_tokens(translated)))


def token_similarity(a: Column, b: Column) -> Column:
    """Share of ``b``'s words that ``a`` also has, by joined length (0 … 1)."""

    def words(text: Column) -> Column:
        return F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")

    def marked(of: Column, of_b: bool) -> Column:
        return F.transform(of, lambda w: F.struct(w.alias("word"), F.lit(of_b).alias("of_b")))

    def add(state: Column, x: Column) -> Column:
        shared = x["of_b"] & (state["word"] == x["word"])
        return F.struct(
            F.when(x["of_b"], state["word"]).otherwise(x["word"]).alias("word"),
            (state["length"] + F.when(x["of_b"] & ~shared, F.length(x["word"]) + 1).otherwise(0)).alias("length"),
        )

    def unshared(p: Column) -> Column:
        # Sorted together, a word of b stands behind the same word of a: no search per word.
        both = F.concat(marked(p["a"], False), marked(p["b"], True))
        start = F.struct(F.lit("").alias("word"), F.lit(0).alias("length"))
        return F.greatest(F.aggregate(F.sort_array(both), start, add)["length"] - 1, F.lit(0))

    pair = F.struct(words(a).alias("a"), words(b).alias("b"))
    return let(
        pair,
        lambda p: F.when((F.size(p["a"]) == 0) | (F.size(p["b"]) == 0), F.lit(0.0)).otherwise(
            F.lit(1.0) - unshared(p) / F.length(F.array_join(p["b"], " "))
        ),
    )


def table_cell(markdown: Column) -> Column:
    """One-line form of a cell: spaces collapsed, free pipes escaped."""

    def collapse(line: Column) -> Column:
        # The class of all white space is dear, and few cells have two of it in a row.
        twice = line.rlike(r"(?U)\s\s") | F.contains(line, F.lit("\ufeff"))
        return F.when(twice, F.regexp_replace(line, rf"[{JS_SPACE}]{{2,}}", " ")).otherwise(line)

    def escape(line: Column) -> Column:
        return F.when(F.contains(line, F.lit("|")), F.regexp_replace(line, r"(?<!\\)\|", r"\\|")).otherwise(line)

    line = let(markdown, lambda m: F.when(F.contains(m, F.lit("\n")), F.regexp_replace(m, r"\r?\n+", " ")).otherwise(m))
    return strip(let(let(line, collapse), escape))


_NUMERIC = r"&#(?:x[0-9a-f]+|[0-9]+);"


def unescape_entities(text: Column) -> Column:
    """Resolve five named entities, then numeric ones; bad code points become U+FFFD."""
    named = text
    # The ampersand comes last, so that no result is read as a new entity.
    for name, char in [("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")]:
        named = F.replace(named, F.lit(f"&{name};"), F.lit(char))

    def numeric(piece: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(piece, r"(?i)#x?([0-9a-f]+);", 1), r"\A0+", "")
        value = F.when(piece.rlike(r"(?i)\A&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        code = F.when(F.length(digits) > 8, F.lit(0)).otherwise(F.coalesce(value, F.lit(0)))
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return let(F.when(bad, F.lit(0xFFFD)).otherwise(code), code_point)

    pieces = extract_all(named, rf"(?i){_NUMERIC}|[\s\S]+?(?={_NUMERIC}|\z)")
    resolved = F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike(rf"(?i)\A{_NUMERIC}\z"), numeric(p)).otherwise(p)), ""
    )
    return F.when(named.contains("&#"), resolved).otherwise(named)


def code_point(code: Column) -> Column:
    """Character of a Unicode code point, built from its UTF-8 bytes."""

    def byte(value: Column) -> Column:
        return F.lpad(F.hex(value.cast("bigint")), 2, "0")

    def tail(shift: int) -> Column:
        return byte(F.shiftright(code, shift).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)))

    encoded = (
        F.when(code < 0x80, byte(code))
        .when(code < 0x800, F.concat(byte(F.shiftright(code, 6).bitwiseOR(F.lit(0xC0))), tail(0)))
        .when(
            code < 0x10000,
            F.concat(byte(F.shiftright(code, 12).bitwiseOR(F.lit(0xE0))), tail(6), tail(0)),
        )
        .otherwise(F.concat(byte(F.shiftright(code, 18).bitwiseOR(F.lit(0xF0))), tail(12), tail(6), tail(0)))
    )
    return F.decode(F.unhex(encoded), "UTF-8")


def word_count(text: Column) -> Column:
    return F.size(F.split(text, rf"[{JS_SPACE}]+"))


# Characters that separate the parts of a page title.
_SEPARATORS = r"\|\-–—\\/>»"
_SPACED_SEPARATOR = rf"[{JS_SPACE}][{_SEPARATORS}][{JS_SPACE}]"


def clean_title(title: Column, headings: Column, h1s: Column) -> Column:
    """Article part of a page title.

    ``headings`` are the texts of the page's h1 and h2 elements, ``h1s`` those of h1.
    """
    original = strip(title)

    def choose(t: Column) -> Column:
        before_last = F.regexp_extract(t, rf"\A([\s\S]*){_SPACED_SEPARATOR}", 1)
        after_first = F.regexp_replace(t, rf"\A[^{_SEPARATORS}]*[{_SEPARATORS}]", "")
        split_title = F.when(word_count(before_last) < 3, after_first).otherwise(before_last)

        after_last_colon = F.regexp_extract(t, r"\A[\s\S]*:([\s\S]*)\z", 1)
        after_first_colon = F.regexp_extract(t, r"\A[^:]*:([\s\S]*)\z", 1)
        lead = F.regexp_extract(t, r"\A([^:]*):", 1)
        colon_title = (
            F.when(F.exists(headings, lambda h: strip(h) == t), t)
            .when(word_count(after_last_colon) < 3, after_first_colon)
            .when(word_count(lead) > 5, t)
            .otherwise(after_last_colon)
        )
        heading_title_ = F.when(F.size(h1s) == 1, F.regexp_replace(strip(h1s[0]), r"(?U)\s{2,}", " ")).otherwise(t)
        return (
            F.when(t.rlike(_SPACED_SEPARATOR), split_title)
            .when(t.contains(": "), colon_title)
            .when((F.length(t) > 150) | (F.length(t) < 15), heading_title_)
            .otherwise(t)
        )

    def settle(pair: Column) -> Column:
        t, chosen = pair["t"], pair["chosen"]
        hierarchical = t.rlike(rf"[{JS_SPACE}][\\/>»][{JS_SPACE}]")
        words = word_count(chosen)
        whole = word_count(F.regexp_replace(t, _SPACED_SEPARATOR, ""))
        return F.when((words <= 4) & (~hierarchical | (words != whole - 1)), t).otherwise(chosen)

    return let(
        original,
        lambda t: let(
            F.struct(t.alias("t"), F.regexp_replace(strip(choose(t)), r"(?U)\s{2,}", " ").alias("chosen")),
            settle,
        ),
    )


def lazy_image_src(src: Column, data_src: Column, data_original: Column, data_lazy: Column) -> Column:
    """Real address of an image whose ``src`` is empty or an inline placeholder."""
    lazy = F.coalesce(nonempty(data_src), nonempty(data_original), nonempty(data_lazy))
    current = F.coalesce(strip(src), F.lit(""))
    return F.when(lazy.isNotNull() & ((current == "") | current.rlike(r"(?i)\Adata:image/")), lazy).otherwise(src)


def code_language(data_lang: Column, css_class: Column) -> Column:
    """Language of a code element: ``data-lang``, else its ``language-x`` class."""
    from_class = F.regexp_extract(css_class, r"(?U)(?:\A|\s)language-(\S*)", 1)
    return F.coalesce(nonempty(data_lang), from_class, F.lit(""))


def quote_yaml(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def frontmatter_build(
    title: Column,
    author: Column,
    source: Column,
    site: Column,
    published_at: Column,
    captured_at: Column,
    language: Column,
    extractor: Column,
    level: Column,
    warnings: Column,
) -> Column:
    """Quoted YAML header of an extracted page; empty optional keys are left out."""

    def line(key: str, value: Column, optional: bool = False) -> Column:
        text = F.concat(F.lit(f"{key}: "), quote_yaml(value))
        return F.when(F.coalesce(value, F.lit("")) != "", text) if optional else text

    warning_lines = F.when(F.size(warnings) == 0, F.array(F.lit("warnings: []"))).otherwise(
        F.concat(
            F.array(F.lit("warnings:")),
            F.transform(warnings, lambda w: F.concat(F.lit("  - "), quote_yaml(w))),
        )
    )
    lines = F.concat(
        F.array_compact(
            F.array(
                F.lit("---"),
                line("title", title),
                line("author", author, optional=True),
                line("source", source),
                line("site", site, optional=True),
                line("published_at", published_at, optional=True),
                line("captured_at", captured_at),
                line("language", language, optional=True),
                line("extractor", extractor),
                line("quality", level),
            )
        ),
        warning_lines,
        F.array(F.lit("---"), F.lit("")),
    )
    return F.array_join(lines, "\n")
