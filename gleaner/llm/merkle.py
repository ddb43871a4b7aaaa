"""Merkle manifest of a dataset: 16-ary hash trees per source and over sources, kept in van Emde Boas layout.

A tree is cut into aligned subtrees, one row of a table each. Such a block is an array
of digests in van Emde Boas order: its levels are split at half height, the upper part
comes first, then the lower parts from left to right, each laid out the same way. All
reading and writing of nodes, also of siblings, goes through ``addresses``. The block
roots are the leaves of the next tree of blocks, until one block is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

from .common import ascii_lower, columns

DIGEST = 32
PATH = "array<struct<left: binary, right: binary>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


@dataclass(frozen=True)
class Shape:
    """``fan`` children of a node, ``height`` levels of parents in a block: fan ** height leaves."""

    fan: int = 16
    height: int = 3

    @property
    def leaves(self) -> int:
        return self.fan**self.height


# --- layout of one block
def nodes_of(levels: int, fan: int) -> int:
    return (fan**levels - 1) // (fan - 1)


def addresses(depth: int, index: np.ndarray, levels: int, fan: int) -> np.ndarray:
    """Places in van Emde Boas order of nodes of one depth (0 is the root) in a tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return addresses(depth, index, upper, fan)
    lower = levels - upper
    part = fan ** (depth - upper)
    return nodes_of(upper, fan) + index // part * nodes_of(lower, fan) + addresses(depth - upper, index % part, lower, fan)


def levels_of(leaves_in_tree: int, shape: Shape) -> int:
    """Levels of the blocks of a tree: as few as will do if it has one block only, else all."""
    levels, width = 1, 1
    while width < leaves_in_tree and levels <= shape.height:
        levels, width = levels + 1, width * shape.fan
    return levels


def sha(*parts: bytes) -> bytes:
    """SHA-256 of digests as hexadecimal text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def lay_out(leaves: list[bytes], levels: int, fan: int) -> bytes:
    """The block over these leaves, up to its root; what no leaf needs is zero, and not kept at the end."""
    counts = [len(leaves)]
    for _ in range(levels - 1):
        counts.append(-(-counts[-1] // fan))
    counts.reverse()
    place = [addresses(depth, np.arange(n), levels, fan) for depth, n in enumerate(counts)]
    nodes = bytearray(DIGEST * (1 + max(int(p.max()) for p in place)))
    for at, digest in zip(place[-1].tolist(), leaves, strict=True):
        nodes[at * DIGEST : (at + 1) * DIGEST] = digest
    for depth in range(levels - 2, -1, -1):
        below = place[depth + 1].tolist()
        for i, at in enumerate(place[depth].tolist()):
            children = [bytes(nodes[c * DIGEST : (c + 1) * DIGEST]) for c in below[i * fan : (i + 1) * fan]]
            nodes[at * DIGEST : (at + 1) * DIGEST] = sha(*children)
    return bytes(nodes)


def siblings(nodes: bytes, count: int, levels: int, fan: int) -> list[list[tuple[bytes, bytes]]]:
    """For every leaf of a block, level by level from below: its siblings to the left and to the right, joined."""
    by_depth: list[list[tuple[bytes, bytes]]] = []
    for depth in range(levels - 1, 0, -1):
        place = addresses(depth, np.arange(count), levels, fan).tolist()
        digests = [nodes[a * DIGEST : (a + 1) * DIGEST] for a in place]
        pairs = []
        for first in range(0, count, fan):
            run = digests[first : first + fan]
            pairs += [(b"".join(run[:i]), b"".join(run[i + 1 :])) for i in range(len(run))]
        by_depth.append(pairs)
        count = -(-count // fan)
    return [[pairs[leaf // fan**k] for k, pairs in enumerate(by_depth)] for leaf in range(len(by_depth[0]))] if by_depth else [[]]


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to; a level of a lone node is hashed as well."""
    for left, right in path:
        digest = sha(left, digest, right)
    return digest


# --- rows to blocks
def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows (grp, digest, item) with pos, their place in their group, and total, the group's rows.

    Sorted by ranges, checkpointed (a rerun might cut the ranges elsewhere). A group may
    go over many partitions: what earlier ones hold of it comes from one small row for each partition.
    """
    rows = cut_lineage(rows.withColumn("read", F.monotonically_increasing_id()))
    keys = ["grp", *order, "read"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("grp", "digest", "item")
    placed = cut_lineage(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    runs = placed.groupBy("part", "grp").agg(F.count("*").alias("n"))
    ends = runs.groupBy("part").agg(
        F.min("grp").alias("first"), F.min_by("n", "grp").alias("first_n"), F.max("grp").alias("last"), F.max_by("n", "grp").alias("last_n"),
        F.max("n").alias("most"),
    ).orderBy("part").collect()  # one row for each partition
    before, totals = {}, {}
    group, seen = None, 0
    for r in ends:
        before[r["part"]] = seen if r["first"] == group else 0
        totals[r["first"]] = totals.get(r["first"], 0) + r["first_n"]
        if r["last"] != r["first"]:
            totals[r["last"]] = totals.get(r["last"], 0) + r["last_n"]
            group, seen = r["last"], r["last_n"]
        else:
            group, seen = r["first"], before[r["part"]] + r["first_n"]
    carried = rows.sparkSession.createDataFrame(
        [(r["part"], r["first"], before[r["part"]], totals[r["first"]], r["last"], totals[r["last"]]) for r in ends],
        "part int, first string, before long, first_total long, last string, last_total long",
    )
    run = Window.partitionBy("part", "grp")
    counted = placed.select("*", (F.row_number().over(run.orderBy("at")) - 1).cast("long").alias("row"), F.count("*").over(run).alias("n"))
    total = F.when(F.col("grp") == F.col("first"), F.col("first_total")).when(F.col("grp") == F.col("last"), F.col("last_total")).otherwise(F.col("n"))
    pos = F.col("row") + F.when(F.col("grp") == F.col("first"), F.col("before")).otherwise(0)
    return counted.join(F.broadcast(carried), "part").select("grp", pos.alias("pos"), total.alias("total"), "digest", "item")  # one row for each partition


def runs_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows of sorted batches that agree in the keys, one table for each run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def blocks(rows: DataFrame, shape: Shape) -> DataFrame:
    """One row for each block of leaves: (grp, block, total, count, root, nodes, items)."""
    fan = shape.fan
    fields = f"grp string, block long, total long, count int, root binary, nodes binary, items array<{rows.schema['item'].dataType.simpleString()}>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, "grp", "block"):
            total = run.column("total")[0].as_py()
            nodes = lay_out(run.column("digest").to_pylist(), levels_of(total, shape), fan)
            items = run.column("item").combine_chunks()
            items = items if isinstance(items, pa.Array) else items.chunk(0)
            yield pa.RecordBatch.from_arrays(
                [run.column("grp").slice(0, 1).combine_chunks(), pa.array([run.column("block")[0].as_py()], pa.int64()), pa.array([total], pa.int64()),
                 pa.array([run.num_rows], pa.int32()), pa.array([nodes[:DIGEST]]), pa.array([nodes], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, run.num_rows], pa.int32()), items)],
                names=["grp", "block", "total", "count", "root", "nodes", "items"],
            )

    keyed = rows.withColumn("block", F.floor(F.col("pos") / shape.leaves).cast("long"))
    return cut_lineage(keyed.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos").mapInArrow(pack, fields))


def forest(rows: DataFrame, shape: Shape) -> list[DataFrame]:
    """Blocks of numbered rows, then blocks of block roots, until every group is one block."""
    found = [blocks(rows, shape)]
    while found[-1].filter(F.col("total") > shape.leaves).limit(1).count():
        below = found[-1].filter(F.col("total") > shape.leaves)
        found.append(blocks(below.select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("total") / shape.leaves).cast("long").alias("total"),
            F.col("root").alias("digest"), F.struct(F.col("block").alias("pos")).alias("item"),
        ), shape))
    return found


def tops(found: list[DataFrame], shape: Shape) -> DataFrame:
    """(grp, tier, root): the root of each group and the number of its last tree of blocks."""
    last = [b.filter(F.col("total") <= shape.leaves).select("grp", F.lit(k).alias("tier"), "root") for k, b in enumerate(found)]
    whole = last[0]
    for more in last[1:]:
        whole = whole.unionByName(more)
    return whole


def descend(found: list[DataFrame], above: DataFrame, shape: Shape, last: Callable, schema: str) -> DataFrame:
    """Follow the trees of blocks downwards: the path of a block's root is the end of its leaves' paths.

    ``above`` has (grp, tier, path, facts...) for every group's root; ``last`` makes result rows of a joined lowest block.
    """
    facts = [c for c in above.columns if c not in ("grp", "tier", "path")]
    paths = None
    for k in range(len(found) - 1, -1, -1):
        ends = above.filter(F.col("tier") == k).select("grp", F.lit(0).cast("long").alias("block"), "path", *facts)
        ends = ends if paths is None else ends.unionByName(paths)
        joined = found[k].join(ends, ["grp", "block"])
        if k == 0:
            return joined.mapInArrow(last, schema)
        ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in above.schema if f.name in facts)
        paths = cut_lineage(joined.mapInArrow(children(shape, "item.pos", facts), f"grp string, block long, path {PATH}" + f", {ids}" * bool(ids)))
    raise ValueError("no trees")


def children(shape: Shape, name: str, facts: list[str]):
    """Rows for the leaves of upper blocks: the group, the leaf's own block number and its path to the root."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = siblings(row["nodes"], row["count"], levels_of(row["total"], shape), shape.fan)
                end = [(p["left"], p["right"]) for p in row["path"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * row["count"], pa.string()), pa.array([x["pos"] for x in row["items"]], pa.int64()), path_array([p + end for p in own]),
                     *[pa.array([row[f]] * row["count"]) for f in facts]],
                    names=["grp", "block", "path", *facts],
                )

    return rows


def path_array(paths: list[list[tuple[bytes, bytes]]]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], PATH_TYPE)


# --- the operator
def field(value: Column) -> Column:
    """A column as its UTF-8 byte count, a colon and its text; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def merkle_manifest(
    documents: DataFrame, shape: Shape = Shape(), id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", tamper: int = 5
) -> DataFrame:
    """Every row with its leaf, the roots above it, a digest of its proof, and what a tampered copy would lead to.

    A leaf is the SHA-256 of the five columns, each written with its length, so that null,
    empty and shifted contents differ. Leaves of a source ascend by id (null first, equal
    ids by leaf; equal rows have equal leaves but a place each). Sources ascend bytewise,
    null first. Rows whose CRC of the id is divisible by ``tamper`` are folded from a text
    in lower case (A-Z only); a null id is never tampered. Other columns are not read. An
    empty table gives no rows; one row alone is its own root and has the proof of no siblings.

    Only digests and ids leave the scan. A source of any size is cut into blocks of
    fan ** height leaves, which are hashed apart from each other.
    """
    rows = columns(documents, doc_id=id, source=source, lang=lang, n_chars=n_chars, text=text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper == 0
    ids = ("doc_id", "source", "lang", "n_chars")
    leaves = rows.select(
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string"))).alias("grp"),
        leaf_digest(*map(F.col, ids), F.col("text")).alias("digest"),
        F.struct("doc_id", F.when(tampered, leaf_digest(*map(F.col, ids), ascii_lower(F.col("text").cast("string")))).alias("tampered")).alias("item"),
    )
    found = forest(numbered(leaves, F.col("item.doc_id"), "digest"), shape)
    subroots = tops(found, shape)
    upper = numbered(subroots.select(F.lit("").alias("grp"), F.col("root").alias("digest"), F.struct(F.col("grp").alias("of"), "tier").alias("item")), F.col("item.of"))
    over = forest(upper, shape)
    root = [r["root"] for r in tops(over, shape).select("root").collect()]  # one row, none of an empty table
    above = tops(over, shape).select("grp", "tier", F.array().cast(PATH).alias("path"))
    id_type = leaves.schema["item"].dataType["doc_id"].dataType.simpleString()
    paths = cut_lineage(descend(over, above, shape, subroot_paths(shape), f"grp string, tier int, path {PATH}, subroot binary"))
    root = bytes(root[0]) if root else b""
    return descend(found, paths, shape, proofs(shape, root), f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def subroot_paths(shape: Shape):
    """Paths of the sources' roots to the root of all."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = levels_of(row["total"], shape)
                own = siblings(row["nodes"], row["count"], levels, shape.fan)
                end = [(p["left"], p["right"]) for p in row["path"]]
                at = addresses(levels - 1, np.arange(row["count"]), levels, shape.fan).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["of"] for x in row["items"]], pa.string()), pa.array([x["tier"] for x in row["items"]], pa.int32()), path_array([p + end for p in own]),
                     pa.array([row["nodes"][a * DIGEST : (a + 1) * DIGEST] for a in at], pa.binary())],
                    names=["grp", "tier", "path", "subroot"],
                )

    return rows


def proofs(shape: Shape, root: bytes):
    """Result rows of the lowest blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {name: one.column(name)[0].as_py() for name in ("nodes", "count", "total", "path", "subroot")}
                items = one.column("items").flatten()
                levels = levels_of(row["total"], shape)
                own = siblings(row["nodes"], row["count"], levels, shape.fan)
                end = [(p["left"], p["right"]) for p in row["path"]]
                tail = b"".join(left + right for left, right in end)
                at = addresses(levels - 1, np.arange(row["count"]), levels, shape.fan).tolist()
                leaves = [row["nodes"][a * DIGEST : (a + 1) * DIGEST] for a in at]
                folded = [fold(t or leaf, p + end) for leaf, t, p in zip(leaves, items.field(1).to_pylist(), own, strict=True)]
                count = row["count"]
                yield pa.RecordBatch.from_arrays(
                    [items.field(0), pa.array([x.hex() for x in leaves]), pa.array([row["subroot"].hex()] * count), pa.array([root.hex()] * count),
                     pa.array([sha(b"".join(left + right for left, right in p), tail).hex() for p in own]), pa.array([x.hex() for x in folded]),
                     pa.array([x == root for x in folded], pa.bool_())],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return rows


# --- the same in SQL
CRC_SQL = """
remainders AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
""".strip()


def oracle(fan: int = 16, levels: int = 6) -> str:
    """Levels unrolled, siblings by windows; enough levels for fan ** levels rows."""
    wrote = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    head = " || ".join(wrote(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    id_bytes = "CAST(doc_id AS VARCHAR)"
    sql = [f"""
WITH {CRC_SQL}
leaves AS (
  SELECT *, sha256({head} || {wrote("text")}) AS leaf, sha256({head} || {wrote(lower)}) AS lowered,
    coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({id_bytes})), lambda i: ascii(substr({id_bytes}, i + 1, 1))::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 5 = 0, false) AS tampered
  FROM documents, remainders),
a0 AS (SELECT doc_id, leaf, source AS grp, CASE WHEN tampered THEN lowered ELSE leaf END AS folded, '' AS path,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM leaves)"""]

    def climb(first: str, keep: str) -> str:
        """Each level: nodes once, siblings of each, parents; rows of the tree carry path and fold along."""
        last = first
        for k in range(levels):
            now = f"{first}_{k}"
            sql.append(f"""
n{now} AS (SELECT DISTINCT grp, pos, n, node FROM {last}),
s{now} AS (SELECT grp, pos, n, coalesce(string_agg(node, '') OVER (w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (w ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, node FROM n{now} WINDOW w AS (PARTITION BY grp, pos // {fan})),
{now} AS (SELECT {keep}, a.grp, CASE WHEN a.n > 1 THEN sha256(s.l || a.folded || s.r) ELSE a.folded END AS folded, CASE WHEN a.n > 1 THEN path || s.l || s.r ELSE path END AS path,
    a.pos // {fan} AS pos, (a.n + {fan - 1}) // {fan} AS n, CASE WHEN a.n > 1 THEN sha256(s.l || s.node || s.r) ELSE a.node END AS node
  FROM {last} a JOIN s{now} s ON a.grp IS NOT DISTINCT FROM s.grp AND a.pos = s.pos)""")
            last = now
        return last

    low = climb("a0", "a.doc_id, a.leaf")
    sql.append(f"""
subs AS (SELECT grp AS source, node AS subroot, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT grp, node FROM {low})),
b0 AS (SELECT doc_id, leaf, subroot, 0 AS grp, folded, path, subs.pos, subs.n, subroot AS node FROM {low} a JOIN subs ON a.grp IS NOT DISTINCT FROM subs.source)""")
    high = climb("b0", "a.doc_id, a.leaf, a.subroot")
    return ",".join(sql).strip() + f"""
SELECT doc_id, leaf, subroot, node AS root, sha256(path) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM {high}"""
