"""HTML → node table, and the interval operations on it."""

from __future__ import annotations

import html.entities
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.core import extract_all, let
from ...functions.text import code_point

# Element classes of the HTML tree rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()
)
# Start tags that end an open sibling, and the elements that stop the search for it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset({"td", "th", "caption", "table", "html", "button"})
NEAREST = 5

_TREE_DDL = (
    "array<struct<src: int, parent: int, last: int, depth: int, ctx: string, near: array<int>, ptag: string, cells: array<int>, table_pos: int>>"
)


def link_nodes(names) -> list[tuple]:
    """Nest the tokens of one page: the stack rules of HTML, nothing more.

    ``names`` holds ``tag``, ``/tag`` or ``#`` per token.  Formatting elements
    cut off by the end of a block open again in the next one.
    """
    return list(zip(*_link_columns(names)))


def _link_columns(names) -> list[list]:
    """The fields of the nodes of one page, each as a list."""
    columns = srcs, parents, lasts, depths, ctxs, nears, ptags, cellss, tables = [], [], [], [], [], [], [], [], []
    # An open element: its node, name and token, and what its children have from it: ctx, near, cells and table.
    stack: list[tuple] = []
    reopen: list[tuple] = []
    outermost = (-1, "", -1, "", [], [], -1)

    def push(src, name, leaf=False):
        index = len(srcs)
        parent, above, _, ctx, near, cells, table = stack[-1] if stack else outermost
        srcs.append(src)
        parents.append(parent)
        lasts.append(index)
        depths.append(len(stack))
        ctxs.append(ctx)
        nears.append(near)
        ptags.append(above)
        cellss.append(cells)
        tables.append(table)
        if not leaf:
            # Enclosing cells and nearest table: what a table needs to find its content.
            stack.append((
                index, name, src, ctx + name[0] if name in ("li", "blockquote") else ctx, [index, *near[: NEAREST - 1]],
                [*cells, index] if name in ("td", "th") else cells, index if name == "table" else table,
            ))

    def pop(keep_formatting=True):
        index, name, src = stack.pop()[:3]
        lasts[index] = len(srcs) - 1
        if keep_formatting and name in FORMATTING:
            reopen.insert(0, (name, src))
            same = [entry for entry in reopen if entry[0] == name]
            if len(same) > 3:
                reopen.remove(same[0])

    def pop_through(index):
        while len(stack) > index:
            pop()

    def find(wanted, stop):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][1] in wanted:
                return k
            if stack[k][1] in stop:
                return None
        return None

    def restore():
        while reopen:
            name, src = reopen.pop(0)
            push(src, name)

    for src, name in enumerate(names):
        if name == "#":
            if reopen:
                restore()
            push(src, name, leaf=True)
        elif name == "~":
            push(src, name, leaf=True)
        elif name.startswith("/"):
            tag = name[1:]
            if tag in ("html", "body") or tag in VOID:
                continue
            k = find({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"html"})
            if k is None:
                for entry in reversed(reopen):
                    if entry[0] == tag:
                        reopen.remove(entry)
                        break
                continue
            if tag in FORMATTING:
                while len(stack) > k + 1:
                    pop()
                pop(keep_formatting=False)
            else:
                pop_through(k)
        elif name:
            if name in CLOSES_P:
                k = find({"p"}, SCOPE)
                if k is not None:
                    pop_through(k)
            if name in IMPLIED:
                siblings, stop = IMPLIED[name]
                k = find(siblings, stop)
                while k is not None:
                    pop_through(k)
                    k = find(siblings, stop)
            if name == "body":
                k = find({"head"}, {"html"})
                if k is not None:
                    pop_through(k)
            if name == "a":
                k = find({"a"}, SCOPE)
                if k is not None:
                    pop_through(k)
                    reopen[:] = [entry for entry in reopen if entry[0] != "a"]
            if name not in CLOSES_P and name not in IMPLIED and name not in ("html", "head", "body"):
                restore()
            push(src, name, leaf=name in VOID)
    while stack:
        pop(keep_formatting=False)
    return columns


_NODE_TYPES = {
    "src": pa.int32(), "parent": pa.int32(), "last": pa.int32(), "depth": pa.int32(), "ctx": pa.string(),
    "near": pa.list_(pa.int32()), "ptag": pa.string(), "cells": pa.list_(pa.int32()), "table_pos": pa.int32(),
}
#: Tokens whose nodes a Python step holds at once; a page is never cut.
CHUNK_TOKENS = 20_000


def chunks(names: pa.Array, size: int = CHUNK_TOKENS) -> Iterator[pa.Array]:
    """Slices of the pages with about ``size`` tokens, one page at least."""
    start = total = 0
    for i, n in enumerate(names.value_lengths().to_pylist()):
        total += n or 0
        if total >= size:
            yield names.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(names):
        yield names.slice(start)


def _link(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for pages in chunks(batch):
            fields, ends = [[] for _ in _NODE_TYPES], [0]
            for page in pages:
                for field, column in zip(fields, _link_columns(page.as_py() or [])):
                    field += column
                ends.append(len(fields[0]))
            values = [pa.array(field, kind) for field, kind in zip(fields, _NODE_TYPES.values())]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, names=list(_NODE_TYPES)))


# Named character references: the HTML 4 set, taken from the standard library.
_ENTITIES = {**{name: chr(code) for name, code in html.entities.name2codepoint.items()}, "apos": "'"}


def decode_entities(text: Column) -> Column:
    """Resolve all character references of HTML text in one pass."""
    table = F.from_json(F.lit(json.dumps(_ENTITIES)), "map<string,string>")
    pieces = extract_all(text, r"&(?:#[xX]?[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]++|&")

    def resolve(piece: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(piece, r"#[xX]?([0-9a-fA-F]+);", 1), r"\A0+", "")
        value = F.when(piece.rlike(r"\A&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        code = F.when(F.length(digits) > 8, F.lit(0)).otherwise(F.coalesce(value, F.lit(0)))
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        number = let(F.when(bad, F.lit(0xFFFD)).otherwise(code), code_point)
        name = F.regexp_extract(piece, r"\A&([A-Za-z0-9]+);\z", 1)
        return F.when(piece.rlike(r"\A&#"), number).when(
            F.length(piece) > 1, F.coalesce(F.try_element_at(table, name), piece)
        ).otherwise(piece)

    resolved = F.array_join(
        F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("&")), resolve(p)).otherwise(p)), ""
    )
    return F.when(text.contains("&"), resolved).otherwise(text)


def parse_attributes(raw: Column) -> Column:
    """Attribute map of a start tag; the first of equal names counts."""
    body = F.regexp_replace(raw, r"(?s)\A<[^\s/>]+|/?>\z", "")
    pattern = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
    entries = F.transform(
        extract_all(body, pattern),
        lambda a: F.struct(
            F.lower(F.regexp_extract(a, r"\A([^\s=]+)", 1)).alias("key"),
            F.regexp_replace(F.regexp_extract(a, r"(?s)\A[^\s=]+\s*=\s*(.*)\z", 1), r"""\A["']|["']\z""", "").alias("value"),
        ),
    )

    def first_only(items: Column) -> Column:
        names = F.transform(items, lambda e: e["key"])
        return let(
            names,
            lambda ks: F.map_from_entries(
                F.transform(
                    F.filter(items, lambda e, i: F.array_position(ks, e["key"]) == i + 1),
                    lambda e: F.struct(e["key"].alias("key"), decode_entities(e["value"]).alias("value")),
                )
            ),
        )

    none = F.create_map().cast("map<string,string>")
    return F.when(raw.rlike(r"\A<[^\s/>]++>\z"), none).when(body.rlike(r"\S"), let(entries, first_only)).otherwise(none)


_REMOVED = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\z)"
    r"|<[!?][^>]*>"
)
_TOKEN = r"""</?[A-Za-z](?:[^"'>]|"[^"]*"|'[^']*')*+>|[^<]++|<"""


#: Bytes of HTML in a task: its nodes take some ten times of that in every sort.
TASK_BYTES = 8 << 20


def task_count(pages: DataFrame) -> int:
    """Tasks for the pages, by their bytes: a task holds as much whatever the size of the whole."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    least = min(pages.sparkSession.sparkContext.defaultParallelism, math.ceil(size / 65_536))
    return max(1, least, math.ceil(size / TASK_BYTES))


def html_tokens(pages: DataFrame) -> DataFrame:
    """Pages → node table in document order; text nodes have the tag ``#text``."""
    # Partitioned by page before the rows multiply: every later window reuses it.
    tasks = task_count(pages)
    placed = pages.select("page_id", "html").repartition(tasks, "page_id")
    clean = F.regexp_replace("html", _REMOVED, "")
    tokens = placed.select("page_id", extract_all(clean, _TOKEN).alias("tokens"))
    tag = F.transform(
        "tokens",
        lambda t: F.when(t.rlike(r"\A</?[a-z][a-z0-9]*+>"), F.regexp_extract(t, r"\A<(/?[a-z][a-z0-9]*+)", 1))
        .when(t.rlike(r"\A</?[A-Za-z]"), F.lower(F.regexp_extract(t, r"\A<(/?[A-Za-z][^\s/>]*)", 1)))
        .when(t.rlike(r"(?U)\A\s*\z"), F.lit("~"))
        .otherwise(F.lit("#")),
    )
    # A Python step forgets how its input was placed. Placed again by number, the windows need no exchange of their own,
    # whose few large partitions would follow the size of the whole.
    named = tokens.withColumn("names", tag).withColumn(
        "nodes", F.arrow_udf(_link, _TREE_DDL)("names")
    ).repartition(tasks, "page_id")
    # The outer form keeps the optimizer from running the UDF twice for a size filter.
    # Each node takes its own token along before the rows multiply, so that no row holds the page.
    owned = F.transform(
        "nodes",
        lambda n: F.struct(n.alias("at"), F.get("names", n["src"]).alias("name"), F.get("tokens", n["src"]).alias("raw")),
    )
    rows = named.select("page_id", F.posexplode_outer(owned).alias("pos", "node")).filter(F.col("node").isNotNull())
    flat = rows.select(
        "page_id",
        "pos",
        F.col("node.at.parent").alias("parent"),
        F.col("node.at.last").alias("last"),
        F.col("node.at.depth").alias("depth"),
        F.col("node.at.ctx").alias("ctx"),
        F.col("node.at.near").alias("near"),
        F.col("node.at.ptag").alias("ptag"),
        F.col("node.at.cells").alias("cells"),
        F.col("node.at.table_pos").alias("table_pos"),
        F.col("node.name").alias("name"),
        F.col("node.raw").alias("raw"),
    )
    is_text = F.col("name").isin("#", "~")
    return flat.select(
        "page_id", "pos", "parent", "last", "depth", "ctx", "near", "ptag", "cells", "table_pos",
        F.when(is_text, F.lit("#text")).otherwise(F.col("name")).alias("tag"),
        F.when(~is_text, parse_attributes(F.col("raw"))).alias("attrs"),
        F.when(is_text, decode_entities(F.col("raw"))).alias("text"),
    )


# --- interval operations ----------------------------------------------------
def by_page(*order: str):
    return Window.partitionBy("page_id").orderBy(*(order or ("pos",)))


def inside(flag: Column, or_self: bool = True, part: tuple[str, ...] = ()) -> Column:
    """True within the subtree of a flagged node.  Subtrees nest or are disjoint,
    so the largest end seen so far tells whether one of them is still open.
    ``part``: columns that set nodes of a page apart."""
    end = -1 if not or_self else 0
    w = Window.partitionBy("page_id", *part).orderBy("pos").rowsBetween(Window.unboundedPreceding, end)
    return F.coalesce(F.max(F.when(flag, F.col("last"))).over(w) >= F.col("pos"), F.lit(False))


def without(nodes: DataFrame, flag: Column) -> DataFrame:
    """Drop the subtrees of all flagged nodes."""
    return nodes.withColumn("_gone", inside(flag)).filter(~F.col("_gone")).drop("_gone")


class Pages:
    """Nodes of whole pages in document order as numpy columns: ``page`` (a rising number), ``pos`` and ``last``."""

    #: Positions of a page lie below this, so page and position make one rising key.
    ROOM = 1 << 32

    def __init__(self, page: np.ndarray, pos: np.ndarray, last: np.ndarray):
        self.page, self.pos, self.last = page, pos, last
        self.key, self.end = page * self.ROOM + pos, page * self.ROOM + last
        self.first = np.flatnonzero(self.changes(page))

    def __len__(self) -> int:
        return len(self.pos)

    @staticmethod
    def changes(*keys: np.ndarray) -> np.ndarray:
        """True where a row is the first one or a key differs from that of the row before."""
        out = np.zeros(len(keys[0]), bool)
        out[:1] = True
        for key in keys:
            out[1:] |= key[1:] != key[:-1]
        return out

    def inside(self, flag: np.ndarray, or_self: bool = True) -> np.ndarray:
        """True within the subtree of a flagged node, as ``inside`` has it."""
        reach = np.maximum.accumulate(np.where(flag, self.end, -1))
        if not or_self:
            reach = np.concatenate(([-1], reach[:-1]))[: len(reach)]
        return reach >= self.key

    def subtree_sum(self, value: np.ndarray) -> np.ndarray:
        """Total over each node's subtree (itself included)."""
        if not len(value):
            return value
        value = value.astype(np.float64 if value.dtype.kind == "f" else np.int64)
        until = np.concatenate((value[:1] * 0, np.cumsum(value)))
        below = until[np.searchsorted(self.key, self.end, "right")] - until[1:]
        # Of nodes with one position, as a repeated page has them, the last one stands for the rest.
        same = np.zeros(len(value), bool)
        same[:-1] = self.key[1:] == self.key[:-1]
        following = np.concatenate((value[1:], value[:1]))
        return value + np.where(self.key == self.end, 0, np.where(same, following, below))

    def latest(self, flag: np.ndarray) -> np.ndarray:
        """Row of the last flagged node of the page up to each node, -1 where there is none."""
        row = np.maximum.accumulate(np.where(flag, np.arange(len(self)), -1))
        return np.where((row >= 0) & (self.page[row] == self.page), row, -1)

    def latest_pos(self, flag: np.ndarray) -> np.ndarray:
        """Position of the last flagged node of the page up to each node, -1 where there is none."""
        row = self.latest(flag)
        return np.where(row >= 0, self.pos[row], -1)

    def of_page(self, value: np.ndarray, best: np.ufunc) -> np.ndarray:
        """Best value of each page, on all its nodes."""
        return self.of_run(value, best, self.page)

    def of_run(self, value: np.ndarray, best: np.ufunc, *keys: np.ndarray) -> np.ndarray:
        """Best value of each run of nodes with equal keys, on all of them."""
        if not len(value):
            return value
        change = self.changes(*keys)
        return best.reduceat(value, np.flatnonzero(change))[np.cumsum(change) - 1]


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes of a page together in document order, as a page step needs them; ``_no`` stays with them where some are dropped."""
    return nodes if "_no" in nodes.columns else nodes.withColumn("_no", F.row_number().over(by_page()))


def step(rows: DataFrame, args: dict[str, Column], fn: Callable[[Pages, dict[str, pa.Array]], pa.Array], ddl: str, name: str = "_found") -> DataFrame:
    """Adds what ``fn`` finds for each node from ``args`` of all nodes of its page; ``rows`` are numbered.

    The rows stay where they are, so one step may follow another without a new sort. Only
    ``args`` go to Python, in batches of whole pages.
    """
    names = list(args)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def found(columns: list[pa.Array]) -> pa.Array:
            pos, last = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[1:3])
            return fn(Pages(np.cumsum(_starts(columns[0])), pos, last), dict(zip(names, columns[3:])))

        held: list[tuple[pa.Array, ...]] = []
        for batch in batches:
            before = held[-1][0].slice(len(held[-1][0]) - 1) if held else batch[0].slice(0, 0)
            starts = np.flatnonzero(_starts(pa.concat_arrays([before, batch[0]]))[len(before) :])
            cut = int(starts[-1]) if len(starts) else 0
            if len(starts) and (held or cut):
                held.append(tuple(c.slice(0, cut) for c in batch))
                yield found([pa.concat_arrays(c) for c in zip(*held)])
                held = []
            if len(batch[0]):
                held.append(tuple(c.slice(cut) for c in batch))
        if held:
            yield found([pa.concat_arrays(c) for c in zip(*held)])

    # Nodes must not be filtered before the step sees them. The number is asked for, as it puts them in order.
    counted = F.arrow_udf(run, ddl).asNondeterministic()
    return rows.withColumn(name, counted(F.col("page_id"), F.when(F.col("_no") > 0, F.col("pos")), F.col("last"), *args.values()))


def _starts(ids: pa.Array) -> np.ndarray:
    """True where another page begins; pages without an id count as one."""
    starts = np.ones(len(ids), bool)
    if len(ids) > 1:
        one, other = ids.slice(1), ids.slice(0, len(ids) - 1)
        differ = pc.fill_null(pc.not_equal(one, other), False).to_numpy(zero_copy_only=False)
        starts[1:] = differ | (one.is_null().to_numpy(zero_copy_only=False) != other.is_null().to_numpy(zero_copy_only=False))
    return starts


def page_step(nodes: DataFrame, args: dict[str, Column], fn: Callable[[Pages, dict[str, pa.Array]], pa.Array], ddl: str) -> DataFrame:
    """One step over nodes in any place and order; adds ``_found``. Numbered nodes stay numbered."""
    found = step(numbered(nodes), args, fn, ddl)
    return found if "_no" in nodes.columns else found.drop("_no")


def without_numbered(rows: DataFrame, flag: Column) -> DataFrame:
    """``without`` for numbered nodes, which stay where they are."""
    gone = step(rows, {"flag": F.coalesce(flag, F.lit(False))}, _inside_flag, "boolean", "_gone")
    return gone.filter(~F.col("_gone")).drop("_gone")


def _inside_flag(pages: Pages, args: dict[str, pa.Array]) -> pa.Array:
    return pa.array(pages.inside(args["flag"].to_numpy(zero_copy_only=False)))


def subtree_sums(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add the total of each value over every node's subtree (itself included)."""
    kinds = {f.name: f.dataType.typeName() for f in nodes.select(*[v.alias(n) for n, v in values.items()]).schema}
    ddl = ", ".join(f"{n}: {'double' if kind == 'double' else 'bigint'}" for n, kind in kinds.items())

    def found(pages: Pages, args: dict[str, pa.Array]) -> pa.Array:
        sums = [pa.array(pages.subtree_sum(column.fill_null(0).to_numpy(zero_copy_only=False))) for column in args.values()]
        return pa.StructArray.from_arrays(sums, names=list(args))

    rows = page_step(nodes, values, found, f"struct<{ddl}>")
    return rows.withColumns({n: F.col("_found")[n] for n in values}).drop("_found")


def attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def has_attr(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attrs", name), F.lit(False))


def is_tag(*names: str) -> Column:
    return F.col("tag").isin(*names)


def text_length() -> Column:
    """Length of a text node after white-space collapsing, 0 where it is blank."""
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"(?U)\S")
    # A single white space keeps its length whatever it is.
    return F.when(blank, F.lit(0)).otherwise(F.length(F.regexp_replace("text", r"(?U)\s\s+", " ")))


def inner_text(nodes: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Text of the nodes of each group in document order, white space collapsed; ``more``: other aggregates of these nodes."""
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), ""
    )
    return (
        nodes.filter(F.col("text").isNotNull())
        .groupBy(*keys)
        .agg(F.trim(F.regexp_replace(joined, r"(?U)\s+", " ")).alias("inner_text"), *[value.alias(name) for name, value in more.items()])
    )
