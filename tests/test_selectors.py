"""Selectors against a matcher that walks a tree, on random trees and random selectors."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators.extraction import filters as fl
from gleaner.operators.extraction import pages as pg
from gleaner.operators.extraction import tree as tr
from gleaner.operators.extraction.selectors import SelectorError, compile_selector, flag_selectors, longest

TAGS, CLASSES, VALUES = ["div", "span", "section", "em"], ["a", "b", "c"], ["von hier", "von dort", "en", "en-GB", "x"]


class Node:
    def __init__(self, rng, up=None, depth=0):
        self.tag, self.up, self.kids = rng.choice(TAGS), up, []
        self.cls = rng.sample(CLASSES, rng.randrange(3))
        self.id = f"i{rng.randrange(6)}" if rng.random() < 0.3 else None
        self.lang = rng.choice(VALUES) if rng.random() < 0.5 else None
        for _ in range(rng.randrange(4) if depth < 5 else 0):
            self.kids.append(Node(rng, self, depth + 1))

    def html(self):
        marks = (f' class="{" ".join(self.cls)}"' if self.cls else "") + (f" id={self.id}" if self.id else "") + (f" lang='{self.lang}'" if self.lang else "")
        return f"<{self.tag}{marks}>" + "".join(k.html() for k in self.kids) + f"</{self.tag}>"

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()

    @property
    def place(self):
        return self.up.kids.index(self) if self.up else 0


# A random compound is its text and a predicate of its own.
def compound(rng):
    tag, cls, ident, value = rng.choice(TAGS), rng.choice(CLASSES), f"i{rng.randrange(6)}", rng.choice(VALUES)
    first = [(tag, lambda n: n.tag == tag), ("*", lambda n: True), ("", None)]
    more = [
        (f".{cls}", lambda n: cls in n.cls),
        (f"#{ident}", lambda n: n.id == ident),
        ("[lang]", lambda n: n.lang is not None),
        (f'[lang="{value}"]', lambda n: n.lang == value),
        (f"[lang^='{value[:2]}']", lambda n: (n.lang or "").startswith(value[:2])),
        (f'[lang$="{value[-2:].upper()}" i]', lambda n: (n.lang or "").lower().endswith(value[-2:].lower())),
        ('[lang*="o"]', lambda n: "o" in (n.lang or "")),
        ("[lang|=en]", lambda n: n.lang == "en" or (n.lang or "").startswith("en-")),
        ("[lang~=von]", lambda n: "von" in (n.lang or "").split(" ")),
        (":first-child", lambda n: n.place == 0),
        (":last-child", lambda n: n.up is None or n is n.up.kids[-1]),
        (":only-child", lambda n: n.up is None or len(n.up.kids) == 1),
        (":empty", lambda n: not n.kids),
        (":nth-child(2n+1)", lambda n: n.place % 2 == 0),
        (":nth-child(-n + 2)", lambda n: n.place < 2),
        (":nth-child(3)", lambda n: n.place == 2),
        (f":not(.{cls})", lambda n: cls not in n.cls),
        (f":not({tag}, [lang])", lambda n: n.tag != tag and n.lang is None),
    ]
    parts = [rng.choice(first)] + rng.sample(more, rng.randrange(3))
    if all(p is None for _, p in parts):
        parts.append(more[0])
    return "".join(t for t, _ in parts), [p for _, p in parts if p]


def related(node, link):
    if link == " ":
        while node.up:
            node = node.up
            yield node
    elif link == ">":
        if node.up:
            yield node.up
    elif node.up:
        yield from node.up.kids[: node.place] if link == "~" else node.up.kids[max(0, node.place - 1) : node.place]


def fits(node, steps):
    link, tests = steps[-1]
    return all(t(node) for t in tests) and (len(steps) == 1 or any(fits(other, steps[:-1]) for other in related(node, link)))


def alternative(rng):
    texts, steps = "", []
    for k in range(rng.choice([1, 1, 2, 2, 3, 4])):
        link = rng.choice([" ", ">", "+", "~"]) if k else ""
        text, tests = compound(rng)
        texts += (f" {link} " if link not in ("", " ") and rng.random() < 0.5 else link) + text
        steps.append((link, tests))
    return texts, steps


def test_random_selectors_on_random_trees(spark):
    rng = random.Random(8)
    trees = [Node(rng) for _ in range(25)]
    listed = [[[alternative(rng) for _ in range(rng.choice([1, 1, 2]))] for _ in range(4)] for _ in trees]
    rows = [(k, t.html(), [" , ".join(text for text, _ in s) for s in own] + [None]) for k, (t, own) in enumerate(zip(trees, listed, strict=True))]
    pages = spark.createDataFrame(rows, "page_id long, html string, s array<string>")
    nodes = tr.html_tokens(pages).join(pages.select("page_id", "s"), "page_id")
    found = {}
    for r in flag_selectors(nodes, "s").collect():
        found[r.page_id, r.pos] = r.hits
    for k, (tree, own) in enumerate(zip(trees, listed, strict=True)):
        for pos, node in enumerate(tree.walk()):
            assert found[k, pos] == [i for i, s in enumerate(own) if any(fits(node, steps) for _, steps in s)], (rows[k][2], tree.html(), pos)
    assert sum(map(len, found.values())) > 100


@pytest.mark.parametrize("text", ["", " ", "p:hover", "p::before", "> p", "p >", "p, ", "a b c d e f", "p\\:x", ":not(p.k)", ":not(:not(p))", "[a=\"b]", "p > > a", "div(p)", "a|b", ":nth-child(x)"])
def test_unsupported_selectors_are_refused(text):
    with pytest.raises(SelectorError):
        compile_selector(text)
    with pytest.raises(SelectorError):
        fl.register_rule([], fl.SiteRule("r", ["e.org"], remove=[text]))


def test_longest():
    assert longest([]) == 1 and longest(["p", "div > p, a b + c"]) == 3
    assert fl.register_rule(list(fl.BUILTIN_RULES), fl.SiteRule("x", ["e.org"], ["article"]))[-1].rule_id == "x"


def test_rules_take_children_only(spark):
    body = f"<div class=k><p>{'one ' * 40}</p><section><p>{'two ' * 40}</p></section></div><p>three</p>"
    pages = spark.createDataFrame([(1, "https://e.org/a", f"<html><body>{body}</body></html>")], "page_id long, url string, html string")
    rules = fl.rules_frame(spark, [fl.SiteRule("r", ["e.org"], ["section > div", "div.k > section > p, nav"], ["div.k > p"], title="body > p")])
    matched = fl.match_site_rule(pages, rules)
    nodes = tr.html_tokens(pages)
    left = fl.remove_by_rules(nodes, matched.select("page_id", F.col("rule.remove").alias("remove")))
    assert [r.text[:3] for r in left.filter("text is not null").orderBy("pos").collect()] == ["two", "thr"]
    assert [r.text[:3] for r in pg.rule_content(left, matched, fl.rule_steps(rules)).filter("text is not null").collect()] == ["two"]


def test_rule_content_counts_the_text_as_it_stands(spark):
    """100 characters with the white space between blocks; references count as what they stand for, ends do not count."""
    first = "a" * 49
    bodies = [
        f"<article>\n <p>{first}</p>\n\n<p>{'b' * 49}</p>\n </article>",  # 49 + 2 + 49
        f"<article> <p>{first}</p>\n<p>{'b' * 49}</p>   </article>",  # 49 + 1 + 49
        f"<article><p>{first}</p><p>&quot;{'b' * 49}&quot;</p></article>",  # 49 + 51
        f"<article><p>{first}</p><p>{'b' * 48}&quot;&quot;</p></article>",  # 49 + 50
        f"<p>{first * 3}</p><article> <p> </p> </article><p>{first * 3}</p>",
        f"<article><p>{first}   {'b' * 48}</p></article>",  # 49 + 3 + 48
    ]
    pages = spark.createDataFrame([(k, "https://e.org/a", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)], "page_id long, url string, html string")
    rules = fl.rules_frame(spark, [fl.SiteRule("r", ["e.org"], ["article"])])
    found = pg.rule_content(tr.html_tokens(pages), fl.match_site_rule(pages, rules), fl.rule_steps(rules))
    assert sorted(r.page_id for r in found.select("page_id").distinct().collect()) == [0, 2, 5]


def test_selectors_are_read_for_pages_not_for_nodes(spark):
    pages = spark.createDataFrame([(1, "https://e.org/a", "<p class=x>a</p><p>b</p>")], "page_id long, url string, html string")
    rules = fl.rules_frame(spark, [fl.SiteRule("r", ["e.org"], ["article"], ["p.x"])])
    removal = fl.match_site_rule(pages, rules).select("page_id", F.col("rule.remove").alias("remove"))
    left = fl.remove_by_rules(tr.html_tokens(pages), removal)
    plan = left._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [line.index("_programs(") for line in plan if "ArrowEvalPython" in line and "_programs(" in line]
    join = [k for k, line in enumerate(plan) if "Join" in line]
    at = [k for k, line in enumerate(plan) if "ArrowEvalPython" in line and "_programs(" in line]
    assert len(depth) == 1 and min(join) < at[0]
    assert [r.text for r in left.filter("text is not null").collect()] == ["b"]
