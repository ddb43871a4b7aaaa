"""Merkle manifest: layout, roots, proofs and tampered rows against a plain tree."""

import hashlib
import zlib

import numpy as np
import pytest

from gleaner.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars int, text string, grp string, pos long, item string, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Root of a list of digests, and each leaf's siblings (left, right) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i // 16 * 16
            paths[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], paths


def brute(rows):
    wrote = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    ascii_lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r: h(*map(wrote, r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots, below = [], []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in own])
        roots.append(root)
        below.append((own, root, paths))
    top, tops = climb(roots) if roots else ("", [])
    found = []
    for (own, root, paths), end in zip(below, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], ascii_lower(r[4]))) if changed else leaf(r)
            for left, right in path + end:
                node = h(left, node, right)
            found.append((r[0], leaf(r), root, top, h(*[x for pair in path + end for x in pair]), node, node == top))
    return sorted(found, key=repr)


def found(spark, rows, shape=merkle.Shape()):
    df = spark.createDataFrame([(*r, "g", 1, "i", "l") for r in rows], DOCS)
    out = merkle.merkle_manifest(df, shape)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


ODD = [(None, None, None, None, None), (None, None, None, None, ""), (7, None, "", 0, ""), (7, "", "en", 1, "A"), (7, "", "en", 1, "A"), (8, "Ünï", "en", -3, "ÄB ab"), (9, "z", "x", 2, "W" * 100_000)]


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(16, 1), merkle.Shape(16, 2)], ids=str)
def test_manifest_by_brute_force(spark, shape):
    rows = [(i, f"s{i * i % 19}" if i % 3 else "hot", "en", i % 100, f"Text {i} UPPER" if i % 2 else f"plain {i}") for i in range(1_500)] + ODD
    assert found(spark, rows, shape) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_small_trees(spark, n):
    rows = [(i, "one", "en", 1, f"T{i}") for i in range(n)]
    assert found(spark, rows) == brute(rows)


def test_many_sources(spark):
    rows = [(i, f"source {i}", "en", 1, "A") for i in range(300)]
    assert found(spark, rows, merkle.Shape(16, 1)) == brute(rows)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_permutation_and_splits_at_half(levels):
    fan = 3
    places = [merkle.addresses(d, np.arange(fan**d), levels, fan) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_of(levels, fan)))
    upper = levels // 2
    if upper:  # the upper half fills the first places, each lower tree a run of its own
        assert sorted(np.concatenate(places[:upper]).tolist()) == list(range(merkle.nodes_of(upper, fan)))
        tree = np.concatenate([p[: fan**d] for d, p in zip(range(levels - upper), places[upper:], strict=True)])
        assert sorted(tree.tolist()) == list(range(merkle.nodes_of(upper, fan), merkle.nodes_of(upper, fan) + merkle.nodes_of(levels - upper, fan)))
