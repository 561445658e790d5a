import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import covertree as C


def plain_top(queries, data, k):
    """queries, data: lists of (id, vector) -> sorted rows, by all products in Python integers."""
    asked = {}
    for i, v in queries:
        asked[i] = min(v, asked.get(i, v))
    out = []
    for q, a in asked.items():
        clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
        found = sorted((-clamp(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in data if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def df(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<long>")


def got(found):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in found.collect())


def clusters(rng, n, dim, spread):
    centres = rng.integers(-40, 40, (5, dim))
    return [(i, [int(x) for x in centres[rng.integers(5)] + rng.integers(-spread, spread + 1, dim)]) for i in range(n)]


@pytest.mark.parametrize("spread", [1, 30])
def test_blocks_against_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(C, "BLOCK", 60)
    monkeypatch.setattr(C, "QUERY_BLOCK", 10)
    monkeypatch.setattr(C, "PIVOTS", 4)
    monkeypatch.setattr(C, "CHUNK", 3)
    monkeypatch.setattr(C, "LANE", 2)
    rows = clusters(np.random.default_rng(spread), 500, 8, spread)
    assert got(C.top_k(df(spark, rows[::7]), df(spark, rows), 6)) == plain_top(rows[::7], rows, 6)


@pytest.mark.parametrize("seed", range(4))
def test_dual_search_is_exact_and_prunes(seed):
    rng = np.random.default_rng(seed)
    rows = clusters(rng, 3000, 16, 2)
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    tree = (ids, vectors, C.cover_tree(vectors), int(abs(vectors).max()))
    asked = (ids[:200], vectors[:200], C.cover_tree(vectors[:200]), int(abs(vectors).max()))
    best = C.Best(200, 5, np.full(200, np.iinfo(np.int64).min))
    formed = C.dual_search(asked, tree, best)
    for q in range(200):
        s = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert best.id[q].tolist() == order and best.score[q].tolist() == s[order].tolist()
    assert formed < 0.8 * 200 * 3000


def test_vectors_without_structure_are_one_leaf_and_still_exact():
    rng = np.random.default_rng(3)
    vectors, ids = rng.integers(-60, 60, (900, 400)), np.arange(900)
    root = C.cover_tree(vectors)
    assert not root.children and len(root.rows) == 900
    best = C.Best(50, 7, np.full(50, np.iinfo(np.int64).min))
    C.dual_search((ids[:50], vectors[:50], C.cover_tree(vectors[:50]), 60), (ids, vectors, root, 60), best)
    for q in range(50):
        s = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:7]
        assert best.id[q].tolist() == order and best.score[q].tolist() == s[order].tolist()


def test_cover_tree_covers_its_points():
    vectors = np.random.default_rng(0).integers(-50, 50, (1500, 12))
    vectors[200:900] = vectors[0]

    def walk(node):
        away = np.sqrt(((vectors[node.rows] - node.centre) ** 2).sum(axis=1))
        assert away.max() <= node.radius + 1e-6
        if not node.children:
            return sorted(node.rows.tolist())
        below = sorted(x for c in node.children for x in walk(c))
        assert below == sorted(node.rows.tolist())
        return below

    assert walk(C.cover_tree(vectors)) == list(range(1500))


def test_edges(spark):
    big = 2**40
    rows = [(0, [1, 2]), (0, [1, 1]), (20, [0, 0]), (1, [3, 3]), (2, [3, 3]), (3, [3, 3]), (3, [3, 3]), (4, [1, 2, 3]), (5, []), (6, []), (7, [big, -big]), (8, [big, big]), (9, [2**62, 2**62])]
    assert got(C.top_k(df(spark, rows), df(spark, rows), 4)) == plain_top(rows, rows, 4)
    assert C.top_k(df(spark, []), df(spark, []), 4).count() == 0
    assert got(C.top_k(df(spark, [(1, [1])]), df(spark, [(1, [1]), (None, [5])]), 4)) == []


def test_usable_and_floored(spark):
    vectors = [None, [1.0, None], [float("nan")], [float("inf")], [], [0.999 / 64, -0.001]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, e array<float>")
    kept = frame.where(C.usable(F.col("e"))).select("id", C.floored(F.col("e"), 64).alias("v")).collect()
    assert sorted((r["id"], r["v"]) for r in kept) == [(4, []), (5, [0, -1])]
    assert math.floor(64 * float(np.float32(0.999 / 64))) == 0
