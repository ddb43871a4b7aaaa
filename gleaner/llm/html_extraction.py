"""Main text of pages: the contiguous region of maximal score, words positive and tags negative."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, columns

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements whose content is no text of the page: skipped up to their end tag.
RAW = "script|style|title|template|noscript|iframe|svg|textarea|select|object|canvas|audio|video|xmp|noembed|noframes"
TOKENS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-z][^\s/>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""",
    re.I | re.S,
)
MARKS = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements outside the article, by name and by a word of class, id or role.
NOISE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
NOISE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead",
    "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "share", "sharing", "social", "related", "recommended",
    "widget", "pagination", "pager", "toolbar", "search", "complementary", "contentinfo", "alert", "disclaimer",
}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "meter", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
ROOTS = {"article", "main", "body"}

# Labelled pages: «» encloses the content. They show where words and tags of each kind lie.
LABELLED = (
    '<html><head><meta><title>t</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article>«<h1>A title here</h1><p>One two three four five six seven eight.</p><p>More words <b>stand</b> here and there<br>on a line.</p>»</article><footer>Copyright of the site &middot; all rights</footer></body></html>',
    '<body><header><h2>Site name</h2><a href="/">start</a></header><div class="ad">Buy this now</div><div><main>«<h1>Another title</h1><p>Some long text with an <a href="/x">inner link</a> and <em>stress</em> in it.</p><ul><li>first point of a list</li><li>second point of the list</li></ul><blockquote>quoted words of someone else</blockquote><p>The end of it comes now.</p>»</main></div><aside><a href="/r">Related</a> read this too</aside><footer><a href="/i">Imprint</a></footer></body>',
    '<body><div class="menu"><a href="/1">One</a><a href="/2">Two</a></div><div class="post">«<h2>Heading</h2><p>Plain words come in a row and go on for a while.</p><table><tr><td>cell one</td><td>cell two</td></tr></table><p>Then it goes on with more words and more.</p>»</div><div class="comments"><div><b>Ann</b> nice one</div><form><input><button>Send</button></form></div></body>',
    '<body><nav><a href="/a">A</a><a href="/b">B</a><a href="/c">C</a></nav><article>«<p>No heading, only text that runs over many words until it stops.</p><p>Short.</p><p>And a last one of some words.</p>»<div class="share"><a href="/s">Share</a></div></article><footer><ul><li><a href="/p">Privacy</a></li></ul></footer></body>',
)


def noisy(tag: str, attributes: str) -> bool:
    if tag in NOISE_TAGS:
        return True
    if tag in ROOTS or tag == "html" or not attributes:
        return False
    words = " ".join(a or b or c for a, b, c in MARKS.findall(attributes)).lower()
    return any(w in NOISE_WORDS for w in re.split(r"[^a-z]+", words))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): a piece of text, a start tag, an end tag, in page order."""
    at = 0
    for m in TOKENS.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[3]:
            yield ("end" if m[2] else "start"), m[3].lower(), m[4] or ""
    if at < len(page):
        yield "text", page[at:], ""


def learn_weights(pages: tuple[str, ...] = LABELLED) -> dict[str, float]:
    """Log odds of each kind of token inside against outside the content; words are scaled positive, tags negative."""
    inside, outside = Counter(), Counter()
    for page in pages:
        before, rest = page.split("«")
        content, after = rest.split("»")
        for part, counts in ((before, outside), (content, inside), (after, outside)):
            for kind, value, attributes in tokens(part):
                if kind == "text":
                    counts["word"] += len(value.split())
                elif kind == "start":
                    counts["noise" if noisy(value, attributes) else value] += 1
    total_in, total_out = sum(inside.values()), sum(outside.values())
    odds = {k: math.log((inside[k] + 0.5) / total_in) - math.log((outside[k] + 0.5) / total_out) for k in inside | outside}
    top = max(odds.values()) + 0.25
    weights = {k: v - top for k, v in odds.items() if k != "word"}
    return weights | {"word": max(0.2, odds["word"]), "other": min(-0.5, -math.log(2))}


def read_page(page: str, weights: dict[str, float]) -> tuple[list[str], list[int], np.ndarray, np.ndarray]:
    """Pieces of text with the number of their block, and for the scan a score per token; noise has no piece.

    An element of noise ends with its end tag; an unclosed one ends at the article's begin, or with the page.
    """
    pieces: list[str] = []
    blocks: list[int] = []
    scores: list[float] = []
    owner: list[int] = []  # of each token: the piece, or -1 for a tag, -2 for a border of the region
    block, shut, depth = 0, "", 0
    for kind, value, attributes in tokens(page):
        if kind == "text":
            if shut:
                continue
            n = len(value.split())
            pieces.append(value)
            blocks.append(block)
            scores.append(weights["word"] * n)
            owner.append(len(pieces) - 1)
            continue
        if shut:
            if value in ("article", "main") and kind == "start" or shut == "head" and value == "body":
                shut = ""
            else:
                if value == shut:
                    depth += 1 if kind == "start" else -1
                    if depth == 0:
                        shut = ""
                        block += 1
                continue
        if value not in INLINE:
            block += 1
        elif value == "br" and pieces:
            pieces.append(" ")
            blocks.append(block)
            scores.append(weights.get("br", weights["other"]))
            owner.append(len(pieces) - 1)
        if kind == "start" and value not in VOID and noisy(value, attributes):
            shut, depth = value, 1
            scores.append(weights["noise"])
            owner.append(-1)
        elif kind == "start" and value != "br":
            scores.append(weights.get(value, weights["other"]))
            owner.append(-1)
        if value in ROOTS or value == "html":
            owner.append(-2)
            scores.append(weights.get(value, weights["other"]))
    return pieces, blocks, np.array(scores), np.array(owner, np.int64)


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """First and last token of the contiguous run with the largest sum; ties: the shorter, then the earlier."""
    sums = np.r_[0.0, np.cumsum(scores)]
    least = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - least))
    begin = int(np.flatnonzero(sums[: end + 1] == least[end])[-1])
    return begin, end


def extract(page: str, weights: dict[str, float]) -> str:
    """Main text of one page: blocks joined by an empty line."""
    pieces, blocks, scores, owner = read_page(page, weights)
    if not any(p.strip() for p in pieces):
        return ""
    begin, end = best_region(scores)
    # The region is stretched to the border of its element, so that short blocks at its ends are not lost.
    borders = np.flatnonzero(owner == -2)
    left, right = borders[borders <= begin], borders[borders > end]
    begin, end = (left[-1] if len(left) else 0), (right[0] if len(right) else len(owner) - 1)
    found: dict[int, list[str]] = {}
    for i in owner[begin : end + 1]:
        if i >= 0:
            found.setdefault(blocks[i], []).append(pieces[i])
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in found.values())
    return "\n\n".join(t for t in texts if t)


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: its main text and the number of its code points.

    Null or empty html, and a page without words, give the empty text. Each row is read
    alone and whole; ids may be null or repeat.
    """
    weights = learn_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches):
            texts = [extract(b.decode("utf-8", "replace"), weights) for b in raw]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return columns(pages, page_id=id, url=url, html=page).mapInArrow(run, SCHEMA)
