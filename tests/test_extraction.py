from types import SimpleNamespace

from pyspark.sql import functions as F

from gleaner.operators.extraction import filters as fl
from gleaner.operators.extraction import markdown as mk
from gleaner.operators.extraction import pages as pg
from gleaner.operators.extraction import tree as tr
from gleaner.operators.extraction.selectors import flag_selectors
from gleaner.plans import extraction as ex
from gleaner.plans.registry import QUERIES

PAGE = "page_id long, url string, html string"


def frame(spark, *bodies, url="https://e.org/d/p.html"):
    return spark.createDataFrame([(k, url, b) for k, b in enumerate(bodies)], PAGE)


def markdown(spark, body):
    pages = frame(spark, f"<html><body>{body}</body></html>")
    rows = mk.to_markdown(mk.absolutize_links(tr.html_tokens(pages), pages)).collect()
    return rows[0].markdown if rows else ""


def test_tree_closes_open_elements():
    names = ["div", "p", "b", "#", "br", "p", "#", "ul", "li", "#", "li", "#", "/ul", "/b", "#", "/div", "#"]
    nodes = tr.link_nodes(names)
    tags = [names[n[0]] for n in nodes]
    assert tags == ["div", "p", "b", "#", "br", "p", "b", "#", "ul", "li", "b", "#", "li", "b", "#", "#", "#"]
    parents = [tags[n[1]] if n[1] >= 0 else None for n in nodes]
    assert parents[8] == "div" and parents[9] == "ul" and parents[15] == "div" and parents[16] is None
    for k, node in enumerate(nodes):
        inside = [j for j, other in enumerate(nodes) if j == k or ancestors(nodes, j, k)]
        assert inside == list(range(k, node[2] + 1)), "a subtree is one interval"


def ancestors(nodes, j, k):
    while j >= 0:
        j = nodes[j][1]
        if j == k:
            return True
    return False


def test_slots_against_brute_force():
    def cell(row, rowspan=1, colspan=1):
        return {"row_no": row, "rowspan": rowspan, "colspan": colspan}

    grid = mk.fill_slots([cell(0, colspan=2), cell(0), cell(1, rowspan=2), cell(1), cell(1), cell(2), cell(2)])
    assert [c for _, _, c in grid] == [0, 0, 1, 2, 3, 4, 2, 5, 6]
    assert mk.fill_slots([cell(0, rowspan=0), cell(0), cell(1)]) == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 2)]
    assert mk.fill_slots([]) == []
    assert mk.fill_slots([cell(1)], 3) == [(0, 0, -1), (1, 0, 0), (2, 0, -1)]


def test_markdown_forms(spark):
    assert markdown(spark, "<h2>T  x</h2><p>a <b> bold </b>b<br>c <i></i></p>") == "## T x\n\na **bold** b  \nc"
    assert markdown(spark, "<p>- x</p><p>1. y</p><p># z *q* [l]</p>") == "\\- x\n\n1\\. y\n\n\\# z \\*q\\* \\[l\\]"
    assert markdown(spark, "<ul><li>a<ul><li>b</li></ul></li><li><p>c</p><p>d</p></li></ul>") == "-   a\n    -   b\n-   c\n    \n    d"
    assert markdown(spark, "<ol start=3><li>x<li>y</ol>") == "3.  x\n4.  y"
    assert markdown(spark, "x<blockquote><p>q</p><p>r</p></blockquote>y") == "x\n\n> q\n> \n> r\n\ny"
    assert markdown(spark, "<pre><code class='language-js'>a  &lt; b;\n\n  c\n</code></pre>") == "```js\na  < b;\n\n  c\n```"
    assert markdown(spark, "<p><a href='/q'>l</a> <img src='data:image/gif;x' data-src='i.png' alt='A'></p>") == "[l](https://e.org/q) ![A](https://e.org/d/i.png)"
    assert markdown(spark, "<a href='javascript:x'>bad</a>") == "bad"


def test_markdown_tables(spark):
    assert markdown(spark, "<table><tr><th>A<th>B|<tr><td>1<td>2</table>") == "| A | B\\| |\n| --- | --- |\n| 1 | 2 |"
    assert markdown(spark, "<table><tr><td colspan=2>w<tr><td>x<td>y</table>") == "| 列 1 | 列 2 |\n| --- | --- |\n| w | w |\n| x | y |"
    # A row without cells stays a row, ends the header and makes the widths unequal; the foot comes last.
    empty = "<table><tr><th>A<th>B<tr></tr><tr><th>1<th>2</table>"
    assert markdown(spark, empty) == "| A | B |\n| --- | --- |\n|  |  |\n| 1 | 2 |"
    assert markdown(spark, "<table><tr></tr><tr><th>A<tr><td>1</table>") == "| 列 1 |\n| --- |\n|  |\n| A |\n| 1 |"
    foot = "<table><tfoot><tr><td>sum</tfoot><tbody><tr><td>1</tbody><thead><tr><td>H</thead></table>"
    assert markdown(spark, foot) == "| H |\n| --- |\n| 1 |\n| sum |"
    # A span attribute of one makes a table complex, too: its empty labels are numbered.
    assert markdown(spark, "<table><tr><th><th>B<tr><td>1<td>2</table>").startswith("|  | B |")
    assert markdown(spark, "<table><tr><th colspan=1><th>B<tr><td>1<td>2</table>").startswith("| 列 1 | B |")
    nested = "<table><tr><td>a<table><tr><td>in</table><td>b<tr><td>c<td>d</table>"
    assert markdown(spark, nested).endswith("| c | d |") and " | b |" in markdown(spark, nested)
    two_heads = "<table><thead><tr><th>G<th>G<tr><th>a<th>b</thead><tr><td>1<td>2</table>"
    assert markdown(spark, two_heads) == "| G / a | G / b |\n| --- | --- |\n| 1 | 2 |"


def test_noise_and_selectors(spark):
    html = (
        '<html class="nav"><body><nav>n</nav><div class="main-ads">a</div><div id="x"><span class="k m" title="von hier">s</span></div>'
        '<p class="k">t</p></body></html>'
    )
    nodes = tr.html_tokens(frame(spark, html))
    left = [r.text for r in fl.remove_noise(nodes).filter("text is not null").orderBy("pos").collect()]
    assert left == ["s", "t"]

    def hits(selector):
        flagged = flag_selectors(nodes.withColumn("s", F.array(F.lit(selector))), "s")
        return [r.tag for r in flagged.filter("size(hits) > 0").orderBy("pos").collect()]

    assert hits("#x") == ["div"] and hits(".k") == ["span", "p"] and hits("p.k") == ["p"]
    assert hits('span[title^="von"]') == ["span"] and hits("#x .m") == ["span"] and hits("nav .k") == []
    assert hits("div > span, body > p") == ["span", "p"] and hits("body > span") == [] and hits("div + div ~ p.k") == ["p"]


def test_extraction_of_pages(spark):
    text = "A sentence with some commas, some words, and an end. " * 6
    article = (
        '<html lang="en"><head><title>The title of the page | Site</title><meta property="og:site_name" content="Site"></head><body>'
        '<nav><a href="/">home</a></nav><div class="post"><h1>The title of the page</h1><p class="byline">Ann Lee</p>'
        f"<h2>Part</h2><p>{text}</p><p>{text}</p><div class='share'><a href='/s'>share it</a></div></div><footer>end</footer></body></html>"
    )
    pages = frame(spark, article, "<html><head><title>Blank</title></head><body></body></html>", url="https://e.org/a")
    rows = {r.page_id: r for r in pg.extract_pages(pages, captured_at=F.lit("2024-01-01")).collect()}
    good = rows[0]
    assert good.ok and good.engine_id == "readability" and good.level == "good" and not good.fallback
    assert good.author == "Ann Lee" and good.site == "Site" and good.language == "en" and good.title == "The title of the page"
    assert "## Part" in good.markdown and "share it" not in good.markdown and "home" not in good.markdown and "Ann Lee\n\n" not in good.markdown
    assert good.markdown.startswith('---\ntitle: "')
    blank = rows[1]
    assert not blank.ok and blank.error == pg.ERROR_EMPTY and blank.level == "failed" and blank.title == "Blank" and blank.fallback


def test_five_candidates_of_a_page(spark, tmp_path):
    part = "<div><p>Some words, then more words, and an end of them.</p></div>"
    pages = frame(spark, f"<html><body>{part * 7}</body></html>", f"<html><body>{part}</body></html>", "<p>x")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["top_candidates"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r["rank"]) for r in found) == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 1), (1, 2)]
    assert [r.tag for r in sorted(found) if r.page_id == 0] == ["body", "div", "div", "div", "div"]


def test_lines_of_a_grid_are_cut_once(spark):
    documents = spark.createDataFrame([(1, "a, b\n c  d\n\ne1\n f")], "doc_id long, text string")
    pages = ex.grid_pages(SimpleNamespace(documents=documents))
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1, "not once for each line"
    rows = "<tr><td>0<td>a b<tr><td rowspan=2>1<td>c d<tr><td><tr></tr><tr><td>4<td>f"
    assert f"<tbody>{rows}</tbody>" in pages.first().html
