"""Nearest neighbours by cosine: stable projections to few dimensions, indexed by kd-trees, verified up to a chi-square test.

Components of a projection by independent normal draws are stable: for two unit vectors
at distance d, the squared projected distance over d squared is chi-square with m degrees
of freedom. Neighbours are therefore taken by rising projected distance and verified by
their exact cosine until the projected distance of the next ones is so large that, with
the chosen probability, none of them can be among the k nearest found so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

from .common import columns

#: More than what two ways of summing a double product differ by, far less than what tells neighbours apart.
MARGIN = 1e-9
NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    """``dims`` is even; ``certainty`` is that of the stopping test. ``sample`` rows fit the split of the
    index, ``block`` query vectors are sent out at once, ``leaf`` rows go to a leaf where the sample allows."""

    k: int = 5
    dims: int = 8
    certainty: float = 0.95
    seed: int = 12
    sample: int = 16_384
    bounds: int = 1_024
    leaf: int = 4_096
    bucket: int = 256
    block: int = 16_384
    salts: int = 16


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, m even."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(length: int, s: Settings) -> np.ndarray:
    return np.random.default_rng([s.seed, length]).standard_normal((length, s.dims))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near 1: exact, and squares cannot overflow."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision; the same pair of vectors always gives the same number."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


# --- kd-trees
def split_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Axis and value of every inner node of a complete binary tree, in level order: medians of the widest axis."""
    nodes, level = [], [points]
    while len(level) < leaves:
        below = []
        for part in level:
            spread = np.ptp(part, axis=0) if len(part) else np.zeros(points.shape[1])
            axis = int(spread.argmax())
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            nodes.append((axis, value))
            below += [part[part[:, axis] < value], part[part[:, axis] >= value]]
        level = below
    return nodes


def leaf_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axes, values = np.array([t[0] for t in tree], np.int64), np.array([t[1] for t in tree])
    while len(tree) and at[0] < len(tree):
        at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] >= values[at])
    return at - len(tree)


def buckets(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree over one block: halves along the widest axis until they are small."""
    found, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            found.append(rows)
            continue
        part = points[rows]
        order = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], len(rows) // 2)
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return found


@dataclass
class Best:
    """Running best rows of each query: score descending, then id."""

    query: np.ndarray
    score: np.ndarray
    id: np.ndarray
    same: np.ndarray

    def merged(self, other: Best, keep: int) -> Best:
        q, s, i, same = (np.concatenate(x) for x in zip((self.query, self.score, self.id, self.same), (other.query, other.score, other.id, other.same), strict=True))
        order = np.lexsort((i, -s, q))
        q, s, i, same = q[order], s[order], i[order], same[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < keep
        return Best(q[kept], s[kept], i[kept], same[kept])


def nothing() -> Best:
    return Best(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))


def search_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, s: Settings) -> tuple[Best, int]:
    """Best rows of one block for every query that can improve on ``floor``, its k-th best cosine so far.

    All queries walk the block's kd-tree side by side: in each round every query still
    open verifies its next bucket by projected distance. A query ends when the
    chi-square test holds for its next bucket. Returns also the number of cosines taken.
    """
    keep, limit = s.k + 1, chi_square_quantile(s.certainty, s.dims)
    matrix = projection(rows.shape[1], s)
    unit, asked = units(rows), units(queries)
    points, at = unit @ matrix, asked @ matrix
    leaves = buckets(points, s.bucket)
    boxes = [(points[leaf].min(axis=0), points[leaf].max(axis=0)) for leaf in leaves]
    apart = np.stack([((np.maximum(low - at, 0) + np.maximum(at - high, 0)) ** 2).sum(axis=1) for low, high in boxes], axis=1)
    order = np.argsort(apart, axis=1, kind="stable")
    top = np.full((len(queries), keep), -np.inf)
    kth = floor.copy()
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    verified = 0
    open_ = np.arange(len(queries))
    for turn in range(len(leaves)):
        leaf = order[open_, turn]
        alive = apart[open_, leaf] <= limit * np.maximum(2 - 2 * kth[open_], 0) + MARGIN
        open_, leaf = open_[alive], leaf[alive]
        if not len(open_):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for group in np.split(by_leaf, cuts):
            q, members = open_[group], leaves[leaf[group[0]]]
            near = asked[q] @ unit[members].T
            verified += near.size
            both = np.concatenate([top[q], near], axis=1)
            top[q] = -np.partition(-both, keep - 1, axis=1)[:, :keep]
            kth[q] = np.maximum(kth[q], top[q].min(axis=1))
            a, b = np.nonzero(near >= kth[q][:, None] - MARGIN)
            hits.append((q[a], members[b], near[a, b]))
    if not hits:
        return nothing(), verified
    q, r, near = (np.concatenate(x) for x in zip(*hits, strict=True))
    good = near >= kth[q] - MARGIN
    q, r = q[good], r[good]
    found = Best(q, cosines(queries[q], rows[r]), ids[r], (queries[q] == rows[r]).all(axis=1))
    return nothing().merged(found, keep), verified


# --- Spark
def nearest_neighbours(embeddings: DataFrame, settings: Settings = Settings(), every: int = 50, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, the k nearest other rows: (query_id, rank, vec_id, score).

    Vectors that are null, empty, zero, or hold null or non-finite components take no
    part. Only vectors of one length are compared. Rows count one by one: repeated rows
    are candidates of each other, each query leaves out one row, its own. Ties go to the
    smaller id, rows without an id come last. Fewer candidates than k are all returned;
    an empty table gives no rows. Every row is indexed. Of equal vectors only the k + 1
    smallest ids can be among the results, so the others are dropped before the index.

    Rows are placed by a kd-tree over their projections (fitted on ``sample`` rows) and
    never move again. Distinct query vectors go out in blocks of ``block``; each task
    walks the kd-trees of its rows and returns at most k + 1 rows for each query.
    """
    s = settings
    rows = usable(columns(embeddings, id=id, vector=vector))
    index, sample = build_index(rows, s)
    asked = rows.filter(F.col("id") % every == 0)
    distinct = numbered(asked.select("vector").distinct())
    found = None
    for low in range(0, distinct.agg(F.max("query")).first()[0] + 1 if distinct.limit(1).count() else 0, s.block):
        part = cut_lineage(best_rows(search(index, distinct.filter(F.col("query").between(low, low + s.block - 1)), sample, s), s.k + 1))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score", "same"))).alias("near"))  # k + 1 at most
    # A popular query vector: its rows are dealt over salts, its one list goes to each.
    salt = F.pmod(F.xxhash64("id"), F.lit(s.salts)).cast("int")
    lists = distinct.join(lists, "query").select("vector", "near", F.explode(F.sequence(F.lit(0), F.lit(s.salts - 1))).alias("salt"))
    own = F.array_position(F.transform("near", lambda x: x["same"] & x["id"].eqNullSafe(F.col("asked"))), True)
    answers = asked.select(F.col("id").alias("asked"), "vector", salt.alias("salt")).join(lists, ["vector", "salt"]).select("asked", F.col("near"), own.alias("own"))
    others = answers.select("asked", F.slice(F.filter("near", lambda x, i: i + 1 != F.col("own")), 1, s.k).alias("near"))
    return others.select(F.col("asked").alias("query_id"), F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score")
    )


def usable(rows: DataFrame) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col("id").cast("long").alias("id"), "vector").filter((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


def numbered(vectors: DataFrame) -> DataFrame:
    """Rows with gapless numbers ``query`` from 0."""
    placed = cut_lineage(vectors.select("vector", F.monotonically_increasing_id().alias("at")))
    part, row = F.shiftright("at", 33), F.col("at") % (1 << 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each partition
    starts, before = [], 0
    for r in counts:
        starts.append((r["part"], before))
        before += r["count"]
    starts = placed.sparkSession.createDataFrame(starts, "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("before") + row).alias("query"), "vector")


def build_index(rows: DataFrame, s: Settings) -> tuple[DataFrame, list]:
    """Candidates placed by leaf, and the vectors of a bounded sample.

    Of each vector the smallest ids stay: first within salted groups, which Spark also
    cuts before the shuffle, so that copies of one vector never meet in one task.
    """
    first = Window.partitionBy("vector", "salt").orderBy(F.col("id").asc_nulls_last())
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(s.salts)))
    kept = cut_lineage(salted.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= s.k + 1).select("id", "vector"))
    sample = [r["vector"] for r in kept.orderBy(F.xxhash64("id", "vector")).limit(s.sample).select("vector").collect()]
    leaves = max(1, min(-(-kept.count() // s.leaf), len(sample) // 16))
    sent = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(split_tree(projected(sample, s), leaves) if leaves > 1 else []))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = cloudpickle.loads(sent.value)
        for batch in batches:
            if batch.num_rows:
                points = projected(batch.column("vector"), s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf_of(points, tree), pa.int32()), pa.array(points[:, 0]), batch.column("id"), batch.column("vector")], names=["leaf", "axis", "id", "vector"]
                )

    vector_type = rows.schema["vector"].dataType.simpleString()
    placed = kept.mapInArrow(place, f"leaf int, axis double, id long, vector {vector_type}")
    return cut_lineage(placed.repartition("leaf").sortWithinPartitions("leaf", "axis").select("id", "vector")), sample


def by_length(vectors) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length."""
    array = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.float64()))
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        flat = array.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        yield at, scaled(flat.reshape(len(at), length))


def projected(vectors, s: Settings) -> np.ndarray:
    points = np.zeros((len(vectors), s.dims))
    for at, x in by_length(vectors):
        points[at] = units(x) @ projection(x.shape[1], s)
    return points


def search(index: DataFrame, block: DataFrame, sample: list, s: Settings) -> DataFrame:
    """Rows (query, id, score, same): of each task's rows the best for each query of one block.

    The block has a bounded number of vectors. Sampled rows give each query a first
    bound: its k-th best cosine over all rows is not below that over some of them.
    """
    asked = block.orderBy("query").collect()
    numbers, vectors = np.array([r["query"] for r in asked], np.int64), [r["vector"] for r in asked]
    floors = np.full(len(asked), -np.inf)
    some = {x.shape[1]: units(x) for _, x in by_length(sample[: s.bounds])}
    by = []
    for at, x in by_length(vectors):
        known = some.get(x.shape[1])
        if known is not None and len(known) > s.k:
            floors[at] = np.sort(units(x) @ known.T, axis=1)[:, -s.k - 1] - MARGIN
        by.append((at, x))
    sent = index.sparkSession.sparkContext.broadcast(cloudpickle.dumps((numbers, by, floors)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, by, floors = cloudpickle.loads(sent.value)
        best = nothing()
        for batch in batches:
            ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for rows_at, rows in by_length(batch.column("vector")) if batch.num_rows else ():
                for at, queries in by:
                    if queries.shape[1] == rows.shape[1]:
                        found, _ = search_block(rows, ids[rows_at], queries, floors[at], s)
                        found.query = at[found.query]
                        best = best.merged(found, s.k + 1)
            full = np.bincount(best.query, minlength=len(numbers)) > s.k
            last = np.flatnonzero(np.diff(best.query, append=-1))
            ends = last[full[best.query[last]]]
            floors[best.query[ends]] = np.maximum(floors[best.query[ends]], best.score[ends] - MARGIN)
        for start in range(0, len(best.query), 10_000):
            part = slice(start, start + 10_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[best.query[part]]), pa.array(best.id[part], mask=best.id[part] == NO_ID), pa.array(best.score[part]), pa.array(best.same[part])],
                names=["query", "id", "score", "same"],
            )

    return index.mapInArrow(run, "query long, id long, score double, same boolean")


def best_rows(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
