"""Clusters and nearest neighbours against brute force, and odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from gleaner.llm import centroids, neighbours

ROWS = "vec_id long, embedding array<float>, cluster string, id int, vector string, score string"


def frame(spark, vectors, schema=ROWS):
    return spark.createDataFrame([(i, v, "c", 1, "v", "s") for i, v in vectors], schema)


def vectors(n, length=64, seed=0):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((7, length))
    return [(i, (middles[rng.integers(7)] + 0.5 * rng.standard_normal(length)).astype(np.float32).tolist()) for i in range(n)]


def odd(length=64):
    one = [0.5] * length
    return [(1000, None), (1001, []), (1002, [math.nan] + one[1:]), (1003, [math.inf] + one[1:]), (1004, [None] + one[1:]), (1005, one[:-1])]


# --- clusters
def brute_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()))
    middles = [v for _, v in kept[:clusters]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [min((away(v, m), c) for c, m in enumerate(middles)) for _, v in kept]
        if r < rounds:
            for c in range(len(middles)):
                own = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == c]
                if own:
                    middles[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = sum(d for d, _ in at)
    return sorted(
        ((i, c, d, sum(x for x, y in at if y == c), total, hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at, strict=True)), key=repr
    )


def found_clusters(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    out = centroids.assign_clusters(df)
    assert out.columns == names
    return sorted((tuple(r[n] for n in names) for r in out.collect()), key=repr)


def test_clusters_by_brute_force(spark):
    rows = [*vectors(300), *odd(), (5, [0.25] * 64), (5, [0.25] * 64), (None, [1.0] * 64)]  # repeated rows, no id
    assert found_clusters(frame(spark, rows)) == brute_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 9])
def test_few_clusters(spark, n):
    rows = [*vectors(n), *odd()]
    assert found_clusters(frame(spark, rows)) == brute_clusters(rows)


def test_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(60)]  # three places, sixteen centroids
    assert found_clusters(frame(spark, rows)) == brute_clusters(rows)


def test_huge_components_are_held(spark):
    found = found_clusters(frame(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)]))
    assert [r[:3] for r in found] == [(1, 1, 0), (2, 0, 0)] or [r[:3] for r in found] == [(1, 0, 0), (2, 1, 0)]


def test_pivots_rule_out_and_stay_exact():
    rng = np.random.default_rng(3)
    middles = rng.integers(-2_000, 2_000, (16, 64))
    points = middles[rng.integers(16, size=2_000)] + rng.integers(-20, 20, (2_000, 64))
    pivots = points[:8]
    apart = np.sqrt(np.stack([centroids.squared(points, p) for p in pivots], axis=1).astype(float))
    cluster, best, exact = centroids.nearest_centroids(points, apart, middles, pivots)
    every = ((points[:, None] - middles[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert exact < 0.5 * every.size


# --- neighbours
def brute_neighbours(rows, every=50, k=5):
    usable = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = []
    for a, (i, v) in enumerate(usable):
        if i is None or i % every:
            continue
        near = []
        for b, (j, w) in enumerate(usable):
            if a != b and len(v) == len(w):
                near.append((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), math.inf if j is None else j))
        found += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(sorted(near)[:k])]
    return sorted(found, key=repr)


def found_neighbours(df, settings=neighbours.Settings()):
    return sorted((tuple(r) for r in neighbours.nearest_neighbours(df, settings).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def recall(found, want):
    at = lambda rows: {(q, v) for q, _, v, _ in rows}
    return len(at(found) & at(want)) / max(1, len(at(want)))


def test_recall_on_clustered_and_plain_vectors(spark):
    rng = np.random.default_rng(5)
    for rows in (vectors(3_000), [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(3_000)]):
        found, want = found_neighbours(frame(spark, rows), neighbours.Settings(leaf=500, block=20, bucket=64)), brute_neighbours(rows)
        assert len(found) == len(want) and recall(found, want) >= 0.9
        scores = {(q, v): s for q, _, v, s in want}
        assert all(scores[q, v] == pytest.approx(s, abs=1e-12) for q, _, v, s in found if (q, v) in scores)


def test_neighbours_of_copies_and_odd_vectors(spark):
    copies = [(10_000 + i, [1.0] + [0.0] * 63) for i in range(300)]  # six queries among them, ties by id
    rows = [*vectors(60), *copies, *odd(), (0, [0.0] * 64), (None, [1.0] + [0.0] * 63), (2_000, [1.0, 2.0]), (2_001, [2.0, 4.0]), (50, vectors(51)[50][1])]
    found = found_neighbours(frame(spark, rows))
    want = brute_neighbours(rows)
    assert len(found) == len(want) and recall(found, want) == 1
    assert [(r, v) for q, r, v, _ in found if q == 10_000] == [(r, 10_000 + r) for r in range(1, 6)]
    assert [(r, v) for q, r, v, _ in found if q == 10_050] == [(r, 9_999 + r) for r in range(1, 6)]
    assert [v for q, _, v, _ in found if q == 2_000] == [2_001]
    assert {v for q, r, v, _ in found if q == 50 and r == 1} == {50}  # a repeated row is another row


def test_few_or_no_neighbours(spark):
    assert found_neighbours(frame(spark, [])) == [] and found_neighbours(frame(spark, [(50, [1.0] * 64)])) == []
    assert found_neighbours(frame(spark, [(7, [1.0] * 64), (9, [1.0] * 64)])) == []
    wide = spark.createDataFrame([(50, [1e200, 0.0]), (51, [1e200, 1e-200])], "vec_id long, embedding array<double>")
    assert found_neighbours(wide) == [(50, 1, 51, 1.0)]


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    draws = np.random.default_rng(1).chisquare(10, 200_000)
    assert (draws <= neighbours.chi_square_quantile(0.9, 10)).mean() == pytest.approx(0.9, abs=0.005)
