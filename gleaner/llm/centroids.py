"""Exact integer k-means with LAESA: distances to fixed pivots, stored once, rule out centroids in every round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

from .common import columns

#: Scaled components are held within this bound, so that a squared distance fits into a long.
LIMIT = 1 << 27
#: Rows whose distances are worked out at once.
ROWS = 8_192
MAX_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Settings:
    """``pivots`` are picked among the ``pool`` rows of smallest hash, far from each other."""

    clusters: int = 16
    rounds: int = 3
    dimensions: int = 64
    scale: int = 64
    pivots: int = 8
    pool: int = 256


def assign_clusters(embeddings: DataFrame, settings: Settings = Settings(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every usable vector with its cluster, its squared distance, the inertias and a digest of its centroid.

    A vector is kept if it has exactly ``dimensions`` components, none null, NaN or
    infinite. Each becomes the integer floor(scale * x), held within 2**27 either way.
    The centroids start as the kept rows of smallest SHA-256 of ``1:<id>`` (a null id
    counts as no digits; equal ids go by their components); with fewer rows there are
    fewer centroids. Repeated rows count each time, ties go to the smaller cluster. An
    empty table, or one without usable vectors, gives no rows. Inertias beyond a long
    are given as the largest long.

    Rows never move: each round is one pass over the checkpointed table of integers and
    pivot distances, with k centroids (a bounded model) sent out and the component sums of
    each task added up by Spark, so a popular vector costs no more than others.
    """
    s = settings
    kept = cut_lineage(pivot_table(columns(embeddings, id=id, vector=vector), s))
    centroids, pivots = starting_points(kept, s)
    if not len(centroids):
        return kept.select(*result_columns(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(""))).limit(0)
    table = cut_lineage(with_pivots(kept, pivots))
    for _ in range(s.rounds):
        centroids = moved(table, centroids, pivots)
    return measured(table, centroids, pivots)


def result_columns(cluster, distance, cluster_inertia, inertia, digest) -> list:
    return [
        F.col("id").alias("vec_id"), cluster.cast("int").alias("cluster"), distance.cast("long").alias("distance"),
        cluster_inertia.cast("long").alias("cluster_inertia"), inertia.cast("long").alias("inertia"), digest.alias("centroid_sha256"),
    ]


def pivot_table(rows: DataFrame, s: Settings) -> DataFrame:
    """Kept rows as integers: id, little-endian 32-bit components, hash of the id."""
    dimensions, scale = s.dimensions, s.scale

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dimensions), False))
            x = whole.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            usable = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                data = np.clip(np.floor(x[usable] * scale), -LIMIT, LIMIT).astype("<i4")
            ids = whole.column(0).filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays([ids, pa.array([row.tobytes() for row in data], pa.binary())], names=["id", "data"])

    id_type = rows.schema["id"].dataType.simpleString()
    kept_rows = rows.mapInArrow(kept, f"id {id_type}, data binary")
    return kept_rows.withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))


def starting_points(kept: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """First centroids, and pivots: of ``pool`` rows, each time the one farthest from those already taken."""
    first = kept.orderBy("hash", "data").select("data").limit(max(s.pool, s.clusters)).collect()  # a bounded number of rows
    points = np.array([np.frombuffer(r["data"], "<i4") for r in first], np.int64).reshape(-1, s.dimensions)
    if not len(points):
        return points, points
    chosen = [0]
    nearest = squared(points, points[0])
    while len(chosen) < s.pivots and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(points, points[chosen[-1]]))
    return points[: s.clusters], points[chosen]


def squared(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to a row, or to a row each."""
    apart = points - to
    return np.einsum("ij,ij->i", apart, apart)


def with_pivots(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The pivot table: distances of each vector to every pivot, as doubles."""
    sent = kept.sparkSession.sparkContext.broadcast(cloudpickle.dumps(pivots))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = cloudpickle.loads(sent.value)
        for batch in blocks(batches):
            points = integers(batch.column("data"), fixed.shape[1])
            apart = np.sqrt(np.stack([squared(points, p) for p in fixed], axis=1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("data"), pa.array([row.tobytes() for row in apart], pa.binary())], names=["id", "data", "apart"])

    return kept.select("id", "data").mapInArrow(add, f"id {kept.schema['id'].dataType.simpleString()}, data binary, apart binary")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def integers(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)


def nearest_centroids(points: np.ndarray, apart: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row, and how many exact distances that took.

    |d(v, p) - d(c, p)| is never more than d(v, c). Centroids are tried by rising bound;
    a row leaves as soon as its bound is surely above its best exact distance.
    """
    to_pivots = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))
    bound = np.zeros((len(points), len(centroids)))
    for j in range(len(pivots)):
        np.maximum(bound, np.abs(apart[:, j, None] - to_pivots[None, :, j]), out=bound)
    # Roots are off by a few units in the last place at most; far less than this margin.
    bound -= 1e-9 * (apart.max(axis=1, initial=0)[:, None] + to_pivots.max(initial=0))
    order = np.argsort(bound, axis=1, kind="stable")
    cluster = np.zeros(len(points), np.int64)
    best = np.full(len(points), MAX_LONG)
    exact = 0
    for rank in range(len(centroids)):
        c = order[:, rank]
        alive = np.flatnonzero(np.take_along_axis(bound, c[:, None], 1)[:, 0] <= np.sqrt(best.astype(np.float64)))
        if not len(alive):
            break
        c, exact = c[alive], exact + len(alive)
        distance = squared(points[alive], centroids[c])
        better = (distance < best[alive]) | ((distance == best[alive]) & (c < cluster[alive]))
        cluster[alive[better]], best[alive[better]] = c[better], distance[better]
    return cluster, best, exact


def sweep(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray):
    """A function over batches that gives each batch with points, cluster, distance and exact distances taken."""
    sent = table.sparkSession.sparkContext.broadcast(cloudpickle.dumps((centroids, pivots)))

    def run(batches: Iterator[pa.RecordBatch]):
        middles, fixed = cloudpickle.loads(sent.value)
        for batch in blocks(batches):
            points = integers(batch.column("data"), middles.shape[1])
            apart = np.frombuffer(b"".join(batch.column("apart").to_pylist())).reshape(len(points), -1)
            yield batch, points, *nearest_centroids(points, apart, middles, fixed)

    return run


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the componentwise means; an empty cluster stays."""
    run, count = sweep(table, centroids, pivots), len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(count, np.int64)
        total = np.zeros((count, centroids.shape[1]), object)  # Python integers: no number of rows is too many
        for _, points, cluster, _, _ in run(batches):
            rows += np.bincount(cluster, minlength=count)
            part = np.zeros(total.shape, np.int64)
            np.add.at(part, cluster, points)
            total += part
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(used, pa.int32()), "rows": pa.array(rows[used], pa.int64()),
            "sums": pa.array([[str(x) for x in total[c]] for c in used], pa.list_(pa.string())),
        })

    parts = table.select("data", "apart").mapInArrow(sums, "cluster int, rows long, sums array<string>")
    added = (
        parts.select("cluster", "rows", F.posexplode("sums").alias("at", "sum"))
        .groupBy("cluster", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("rows").alias("rows"))
        .collect()  # clusters x dimensions rows
    )
    after = centroids.copy()
    for r in added:
        after[r["cluster"], r["at"]] = int(r["sum"]) // r["rows"]
    return after


def measured(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """The last assignment with inertias."""
    run = sweep(table, centroids, pivots)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance, _ in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    rows = cut_lineage(table.mapInArrow(assigned, f"id {table.schema['id'].dataType.simpleString()}, cluster int, distance long"))
    sums = {r["cluster"]: int(r["total"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = table.sparkSession.createDataFrame(
        [(c, min(total, MAX_LONG), digests[c]) for c, total in sums.items()], "cluster int, cluster_inertia long, digest string"
    )  # one row for each cluster
    inertia = F.lit(min(sum(sums.values()), MAX_LONG))
    joined = rows.join(F.broadcast(facts), "cluster")
    return joined.select(*result_columns(F.col("cluster"), F.col("distance"), F.col("cluster_inertia"), inertia, F.col("digest")))


def oracle(s: Settings = Settings()) -> str:
    """The same in DuckDB: every distance worked out, rounds unrolled."""
    sql = [f"""
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({s.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {s.dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {s.dimensions}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS middle FROM whole QUALIFY cluster < {s.clusters})"""]
    for k in range(s.rounds + 1):
        sql.append(f"""
d{k} AS (SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, middle), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM whole, c{k}),
a{k} AS (SELECT * FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if k < s.rounds:
            sql.append(f"""
m{k} AS (SELECT cluster, list(floored ORDER BY slot) AS middle FROM (
  SELECT cluster, slot, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floored
  FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS slot FROM a{k}) GROUP BY cluster, slot) GROUP BY cluster),
c{k + 1} AS (SELECT cluster, CAST(coalesce(m{k}.middle, c{k}.middle) AS BIGINT[]) AS middle FROM c{k} LEFT JOIN m{k} USING (cluster))""")
    last = s.rounds
    return ",".join(sql).strip() + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(middle, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} USING (cluster)"""
