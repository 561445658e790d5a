import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import chosen_path
from storyloom.llm.simhash import shingle_set

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}


def set_of(text, k):
    words = (text or "").translate(UPPER).encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows, k=2, share=80):
    """(id, size, component) of every row, by comparing all pairs."""
    sets = [set_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j]) if a and sets[j] else 0
            if both and 100 * both >= share * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return sorted((str(r[0]), len(s), str(least.get(find(i)))) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def found(docs, **more):
    return sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in chosen_path.near_duplicates(docs, **more).collect())


def corpus(rng, groups, size):
    """Texts and near copies of them about the threshold."""
    words = [f"w{i}" for i in range(800)]
    rows = []
    for g in range(groups):
        base = rng.choices(words, k=rng.randrange(1, 80))
        for _ in range(rng.randrange(1, size)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 9)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("leaf", "depth"), [(256, 10), (4, 3)])
def test_against_all_pairs(spark, docs_of, monkeypatch, leaf, depth):
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    monkeypatch.setattr(chosen_path, "DEPTH", depth)
    rng = random.Random(leaf + depth)
    texts = corpus(rng, 60, 14)
    rows = [(rng.choice([None, i, i, i]), t) for i, t in enumerate(texts)]
    rows += [(9001, None), (9002, ""), (9003, " \t\n"), (None, None), (9004, "One"), (9005, "one"), (9006, "one two"), (9007, "ONE\x0btwo"), (9008, "\x85"), (9009, "long word " * 30_000)]
    rows += [(3, texts[0]), (3, texts[0]), *((10_000 + i, texts[1]) for i in range(40))]
    docs = docs_of(rows).withColumns({"name": F.lit("x"), "id": F.lit(7), "tokens": F.lit(None)})
    assert found(docs.repartition(4), shingle=2) == plain(rows)


def test_other_similarities(spark, docs_of):
    rng = random.Random(12)
    rows = list(enumerate(corpus(rng, 40, 8)))
    assert found(docs_of(rows), shingle=1, similarity=0.9) == plain(rows, 1, 90)


def test_a_pair_at_the_threshold_is_lost_in_few_trees_and_never_in_all(spark):
    rng, lost, together, pairs = random.Random(1), 0, 0, 300
    for k in range(pairs):
        base = [f"{k} {i}" for i in range(90)]
        a, b = ([f"{k} {side} {i}" for i in range(10)] + base[:80] for side in "ab")  # 80 of 100 in common
        sets = [np.unique(np.array([hash((k, x)) & (1 << 64) - 1 for x in s], np.uint64)) for s in (a, b)]
        sig = [chosen_path.tokens(chosen_path.selected(s))[None, :] for s in sets]
        in_trees = 0
        for tree in range(chosen_path.TREES):
            paths = []
            for s in sig:
                level, keys = [(np.zeros(1, np.int64), np.full(1, tree << 16 | 1, np.int64))], set()
                for _ in range(3):
                    level = [(c, n) for key, node in level for c, n in chosen_path.branched(key, node, s)]
                    keys = {int(c[0]) for c, _ in level}
                paths.append(keys)
            in_trees += bool(paths[0] & paths[1])
        together += in_trees
        lost += in_trees == 0
    assert lost == 0 and together / (pairs * chosen_path.TREES) > 0.8, (lost, together)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(4)
    for n in (5, 50, 3000):
        apart = []
        for _ in range(60):
            both = rng.integers(0, 2**64, n * 8, dtype=np.uint64)
            a, b = (np.unique(np.r_[both, rng.integers(0, 2**64, n, dtype=np.uint64)]) for _ in range(2))
            words = chosen_path.fingerprints(np.stack([chosen_path.selected(a), chosen_path.selected(b)]))
            apart.append(int(np.bitwise_count((words[0] ^ words[1]).view(np.uint64)).sum()))
        assert max(apart) <= chosen_path.radius_of(0.8) and 20 < np.mean(apart) < 32, (n, apart)


def test_empty(spark, docs_of):
    assert chosen_path.near_duplicates(docs_of([])).count() == 0
    assert found(docs_of([(1, None), (2, "")])) == [("1", 0, "1"), ("2", 0, "2")]


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(spark.read.parquet(f"{SF}/documents.parquet"), shingle=2) == plain(rows)
    assert len(shingle_set(b"a b c", 2)) == 2
