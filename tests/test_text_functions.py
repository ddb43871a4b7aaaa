import random
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from gleaner.functions import markdown as md
from gleaner.functions import quality as q
from gleaner.functions import text as t
from gleaner.functions import urls as u


def first(evaluate, values, column):
    return [r[0] for r in evaluate([(i, v) for i, v in enumerate(values)], "i int, c string", x=column)]


def expected_url(value):
    p = urlsplit(value.strip())
    port = p.port
    if (p.scheme.lower(), port) in {("http", 80), ("https", 443)}:
        port = None
    host = (p.hostname or "").lower() + (f":{port}" if port is not None else "")
    path = p.path.rstrip("/") if p.path not in ("", "/") else "/"
    keep = [
        (k, v)
        for k, v in parse_qsl(p.query, keep_blank_values=True)
        if k.lower() not in u.TRACKING_KEYS and not k.lower().startswith("utm_")
    ]
    query = urlencode(sorted(keep))
    return f"{p.scheme.lower()}://{host}{path}" + (f"?{query}" if query else "")


def test_normalize_url(evaluate):
    urls = [
        " HTTPS://User:pw@Example.COM:443/a/b//?utm_source=x&b=2&a=1&a=0#frag ",
        "http://example.com:80",
        "http://example.com:8080/?q=a~b*c%20d&empty&ref=z",
        "https://example.com/x?k=%zz%41&From=me&k=+plus",
        "https://example.com/x?y=%E4%BD%A0&x==",
        "https://example.com/?&&a=b",
    ]
    got = first(evaluate, urls, u.normalize_url(F.col("c")))
    assert got == [expected_url(x) for x in urls]
    again = first(evaluate, got, u.normalize_url(F.col("c")))
    assert again == got


def test_absolute_url(evaluate):
    base = "https://a.example.org/x/y/page.html?q=1"
    links = ["z.html", "/r/s", "../up", "../../../top", "//cdn.example.net/i.png", "?k=2", "#part", "https://b.org", "./", "a b.png"]
    got = first(evaluate, links, u.absolute_url(F.col("c"), F.lit(base)))
    want = [urljoin(base, x) for x in links]
    want[7] = "https://b.org/"
    want[9] = want[9].replace(" ", "%20")
    assert got == want
    bad = first(evaluate, ["JavaScript:alert(1)", "data:text/html,x", "vbscript:x", "mailto:a@b.c"], u.absolute_url(F.col("c"), F.lit(base)))
    assert bad == [None, None, None, "mailto:a@b.c"]


def test_srcset(evaluate):
    got = first(evaluate, ["a.png 1x, /b.png 2x", "javascript:x 1x,c.png"], u.absolute_srcset(F.col("c"), F.lit("https://e.org/d/")))
    assert got == ["https://e.org/d/a.png 1x, https://e.org/b.png 2x", "https://e.org/d/c.png"]


def random_docs(n, seed):
    rng = random.Random(seed)
    pieces = ["---", "...", "```", "~~~", "````js", "  ```", "# Title", "## A ##", "## B", "### C", "text | x", "", "", " \t", "a\r", "# Big, title!", "|a|b|", "|---|:-:|", "![i](u)", "***", "- - -", "> q", "1. x", "* li", "#nohead", "    ## deep", "　", "--- "]
    return ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 16))) for _ in range(n)]


def test_sections_by_hand(evaluate):
    cases = {
        "# One\na\n# Two\nb": [("sec-001", 1, "One", 0, 2), ("sec-002", 1, "Two", 2, 4)],
        "# Big, title!\n## A ##\nx\n### in\n## B\ny": [("sec-001", 2, "A", 1, 4), ("sec-002", 2, "B", 4, 6)],
        "---\n# no\n---\n## A\n```\n## fenced\n```\n## B": [("sec-001", 2, "A", 3, 7), ("sec-002", 2, "B", 7, 8)],
        "# Only one\ntext": None,
        "#nohead\n    ## deep\n#### four": None,
        "## A\n# Top\n## B\n# End": [("sec-001", 1, "Top", 1, 3), ("sec-002", 1, "End", 3, 4)],
    }
    got = first(evaluate, list(cases), md.section_index(F.col("c"), F.lit("big title")))
    found = [index and [(s.section_ref, s.level, s.title, s.start_line, s.end_line) for s in index.sections] for index in got]
    assert found == list(cases.values())


def test_sections_are_ranges_in_order(evaluate):
    docs = random_docs(1200, 3) + [d.replace("\n", "\r\n") for d in random_docs(200, 4)]
    for doc, index in zip(docs, first(evaluate, docs, md.section_index(F.col("c"), F.lit("big title")))):
        if index is None:
            continue
        lines, parts = doc.split("\n"), index.sections
        assert 2 <= len(parts) <= 10 and len({s.level for s in parts}) == 1, repr(doc)
        assert [s.section_ref for s in parts] == [f"sec-{n:03d}" for n in range(1, len(parts) + 1)]
        for a, b in zip(parts, [*parts[1:], None]):
            assert a.start_line < a.end_line <= (b.start_line if b else len(lines)), repr(doc)
            assert lines[a.start_line].startswith("#" * a.level + " "), repr(doc)
            assert a.title in lines[a.start_line]


def test_blocks_by_hand(evaluate):
    cases = {
        "a\nb\n\nc": [("b1", "a\nb", 0, 2), ("b2", "c", 3, 4)],
        "```\nx\n\ny\n```\nz": [("b1", "```\nx\n\ny\n```", 0, 5), ("b2", "z", 5, 6)],
        "~~~\nopen\n\nend": [("b1", "~~~\nopen\n\nend", 0, 4)],
        "---\nk: v\n---\n\ntext": [("b1", "text", 4, 5)],
        " \t\n\n": [],
    }
    got = first(evaluate, list(cases), md.split_blocks(F.col("c")))
    assert [[(b.id, b.source_markdown, b.start_line, b.end_line) for b in blocks] for blocks in got] == list(cases.values())


def test_blocks_cover_the_body(evaluate):
    docs = random_docs(1200, 5) + [d.replace("\n", "\r\n") for d in random_docs(200, 6)]
    for doc, blocks in zip(docs, first(evaluate, docs, md.split_blocks(F.col("c")))):
        lines = doc.replace("\r\n", "\n").split("\n")
        assert [b.id for b in blocks] == [f"b{n}" for n in range(1, len(blocks) + 1)]
        ends = [0]
        for b in blocks:
            assert ends[-1] <= b.start_line < b.end_line <= len(lines), repr(doc)
            assert "\n".join(lines[b.start_line : b.end_line]).strip() == b.source_markdown, repr(doc)
            ends.append(b.end_line)
        if blocks:  # only blank lines lie between blocks and after the last
            gaps = [k for a, b in zip(ends[1:], [*[b.start_line for b in blocks[1:]], len(lines)]) for k in range(a, b)]
            assert not any(lines[k].strip() for k in gaps), repr(doc)


def test_block_kinds(evaluate):
    doc = "\n\n".join(["# h", "```js\nx\n\ny\n```", "![a](b)", "---", "* * *", "> q", "- a\n- b", "1. a", "a|b\n-|-\n1|2", "plain | text", "####### no"])
    kinds = [b.kind for b in first(evaluate, [doc], md.split_blocks(F.col("c")))[0]]
    assert kinds == ["heading", "code", "image", "separator", "separator", "quote", "list", "list", "table", "paragraph", "paragraph"]


@pytest.mark.parametrize(
    "doc, tables",
    [
        ("", 0),
        ("|a|b|", 0),
        ("|a|b|\n|---|---|", 1),
        ("  |a|b|  \n | :---: | ---: |\n|1|2|", 1),
        ("|a|\n|--|", 0),  # two dashes are no delimiter
        ("|---|\n|---|", 0),  # a delimiter is no header
        ("|a|\n\n|---|", 0),
        ("|a|\n|---|\n|b|\n|---|", 2),
        ("|a|\n|---|\n|---|", 1),
        ("a|b\n-|-", 0),
        ("```\n|a|\n|---|\n```", 0),
        ("~~~\n|a|\n|---|\n```\n|a|\n|---|\n~~~\n|a|\n|---|", 1),  # the other mark does not close
        ("````\n```\n|a|\n|---|\n````\n|a|\n|---|", 1),  # nor does a shorter one
        ("    ```\n|a|\n|---|", 1),  # indented too far for a fence
        ("|a|\n```\n```\n|---|", 0),
        ("```\n|a|\n|---|", 0),  # an open fence goes to the end
    ],
)
def test_count_tables(evaluate, doc, tables):
    assert first(evaluate, [doc], md.count_tables(F.col("c"))) == [tables]


def test_count_tables_adds_up(evaluate):
    rng = random.Random(9)
    pieces = ["|a|b|", "|---|:---:|", "| x |", "|--|", "text", "", "a | b"]
    docs = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    count = lambda made: first(evaluate, made, md.count_tables(F.col("c")))
    own = count(docs)
    assert sum(own) > 50
    assert count([f"{d}\n\n| h | k |\n|---|---|" for d in docs]) == [n + 1 for n in own]
    assert count([f"{d}\n```\n{e}\n```\n" for d, e in zip(docs, docs[::-1], strict=True)]) == own
    assert count([f"{d}\n\n{e}" for d, e in zip(docs, docs[::-1], strict=True)]) == [n + m for n, m in zip(own, own[::-1], strict=True)]
    assert count([d.replace("-", "x") for d in docs]) == [0] * len(docs)


def test_long_runs_do_not_overflow(evaluate):
    docs = ["-" * 20000, "```\n" + "x\n" * 30000, "a\n" * 30000, "|" + "---|" * 5000, "---\n" + "k: v\n" * 20000]
    got = evaluate([(d,) for d in docs], "c string", b=md.split_blocks(F.col("c")), s=md.section_index(F.col("c"), F.lit("")), m=q.quality_report(F.col("c")))
    assert [r.b[0].kind for r in got] == ["separator", "code", "paragraph", "paragraph", "paragraph"]


def test_language(evaluate):
    docs = [
        "---\nlanguage: zh_CN\n---\n" + "word " * 60,
        "---\nlanguage: en\n---\n" + "中文内容" * 20,
        "---\nlanguage: Fr_FR\n---\nshort",
        "```\n" + "code " * 100 + "\n```\n简短",
        "中" * 20,
        "a" * 40,
        "`x` https://example.org/" + "y" * 300,
    ]
    assert first(evaluate, docs, t.detect_language(F.col("c"))) == ["en", "zh-CN", "fr-fr", "unknown", "zh-CN", "en", "unknown"]


def test_protected_tokens(evaluate):
    rows = [("See `renderLoop()` and `// Do it once!` https://e.org/a", "见 `renderLoop()` `// 只做一次` https://e.org/a"),
            ("`#include` `# note` ``x``", "无")]
    got = evaluate(rows, "a string, b string", p=t.protected_tokens(F.col("a")), m=t.missing_tokens(F.col("a"), F.col("b")))
    assert got[0].p == ["https://e.org/a", "`renderLoop()`", "//"] and got[0].m == []
    assert got[1].m == ["#", "`#include`"]


def test_entities(evaluate):
    values = ["a &amp;lt; b", "&quot;x&apos; &#65;&#x4e2d;", "&#0; &#xD800; &#x110000; &#99999999999;", "&amp;#66;", "plain", "&#128512;"]
    assert first(evaluate, values, t.unescape_entities(F.col("c"))) == ["a &lt; b", "\"x' A中", "� � � �", "B", "plain", "😀"]


def test_titles(evaluate):
    rows = [
        ("A long enough article title here | Site name", [], []),
        ("Short | A site with many words in it", [], []),
        ("Section: the real title of this page", ["Other"], ["Other"]),
        ("Tiny", [], ["The only   heading of the page"]),
        ("One two three four five six: rest of it goes on", [], []),
    ]
    got = evaluate(rows, "t string, h array<string>, h1 array<string>", x=t.clean_title(F.col("t"), F.col("h"), F.col("h1")))
    assert [r.x for r in got] == [
        "A long enough article title here",
        "A site with many words in it",
        "the real title of this page",
        "The only heading of the page",
        "One two three four five six: rest of it goes on",
    ]


def test_small_functions(evaluate):
    assert first(evaluate, ["a/b:c*?", "  ", "x" * 90], t.safe_filename(F.col("c"))) == ["a_b_c__", "未命名文章", "x" * 80]
    assert first(evaluate, ["a|b \n\n c \\| d"], t.table_cell(F.col("c"))) == ["a\\|b c \\| d"]
    assert first(evaluate, ["`// a`", "`#`", "`#if`", "`/* x`", "`y`"], t.comment_marker(F.col("c"))) == ["//", "#", None, "/*", None]
    sim = evaluate([("a b c", "a b d"), ("", "x"), ("x y", "X y")], "a string, b string", s=t.token_similarity(F.col("a"), F.col("b")))
    assert [round(r.s, 3) for r in sim] == [0.8, 0.0, 1.0]
    assert first(evaluate, ["lang language-ts x", "languages", None], t.code_language(F.lit(None).cast("string"), F.col("c"))) == ["ts", "", ""]
    assert first(evaluate, ["---\n\nx\n---\nbody", "---\nk: 1\n---\nbody"], t.strip_frontmatter_keyed(F.col("c"))) == ["---\n\nx\n---\nbody", "body"]


def test_quality(evaluate):
    docs = ["", "short", "x" * 150, "# h\n" + "x" * 400, "x" * 600 + " 请登录", "\n\n".join(["same text here " * 10] * 4 + ["# h"])]
    got = first(evaluate, docs, q.quality_report(F.col("c")))
    assert [r.level for r in got] == ["failed", "poor", "warning", "good", "warning", "warning"]
    assert got[0].warnings == [q.WARN_EMPTY]
    assert got[4].warnings == [q.WARN_LOGIN, q.WARN_NO_HEADING]
    assert got[5].duplicate_ratio == 60 and "60%" in got[5].warnings[0]
