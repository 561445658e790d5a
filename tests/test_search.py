"""Indexes for keyword and vector search against plain scans."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators.cells import CellIndex
from storyloom.operators.inverted import BlockIndex, words
from storyloom.shared import new_path, written


def texts_of(rng, n):
    """Zipf-like words, and a few rare ones that stand together."""
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40))) + (f" rare{i // 5} odd{i // 5}" if i % 7 == 0 else "") for i in range(n)]


def scan(items, queries, k, weighted):
    sets = {i: set(t.split()) for i, t in items if t}
    df = Counter(w for s in sets.values() for w in s)
    weight = lambda w: (len(items) // df[w]).bit_length() if weighted else 1
    out = []
    for q, terms in queries:
        scores = {i: sum(weight(w) for w in set(terms) & s) for i, s in sets.items() if set(terms) & s}
        out += [(q, r, i, v) for r, (i, v) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("weighted", [False, True])
def test_block_index_gives_what_a_scan_gives(spark, weighted):
    rng = random.Random(5)
    items = list(enumerate(texts_of(rng, 600))) + [(9000, None), (9001, ""), (9002, "!?")]
    rng.shuffle(items)
    queries = [(q, rng.choices([f"w{i}" for i in range(400)] + [f"rare{i}" for i in range(9)], k=rng.randrange(1, 6))) for q in range(30)]
    queries += [(100, ["absent"]), (101, []), (102, None), (103, [None, "w1", "w1"])]
    index = BlockIndex(spark, new_path(spark, "index"), block=8)
    made = spark.createDataFrame(items, "id int, text string")
    for part in range(3):
        index.append(made.where(f"id % 3 = {part}"), "id", "text")
    hits, report = index.search(spark.createDataFrame(queries, "query_id int, terms array<string>"), 4, weighted)
    got = sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in hits.collect())
    assert got == scan(items, [(q, [x for x in t or [] if x]) for q, t in queries], 4, weighted)
    read = report.agg(F.sum("blocks"), F.sum("blocks_read")).first()
    assert read[1] < read[0] * (0.7 if weighted else 0.9), read




def test_long_queries_of_common_words_score_all_blocks_where_they_lie(spark, monkeypatch):
    looked_up, plain = [], BlockIndex._scored

    def scored(*tables):
        looked_up.append(1)
        return plain(*tables)

    monkeypatch.setattr(BlockIndex, "_scored", staticmethod(scored))
    rng = random.Random(6)
    items = list(enumerate(texts_of(rng, 300)))
    queries = [(q, rng.sample([f"w{i}" for i in range(40)], 25)) for q in range(12)]
    index = BlockIndex(spark, new_path(spark, "index"), block=8)
    made = spark.createDataFrame(items, "id int, text string")
    for part in range(2):
        index.append(made.where(f"id % 2 = {part}"), "id", "text")
    hits, report = index.search(spark.createDataFrame(queries, "query_id int, terms array<string>"), 4, True)
    assert sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in hits.collect()) == scan(items, queries, 4, True)
    assert len(looked_up) == 1 and report.where("blocks_read <> blocks").count() == 0


def clustered(rng, n, spread):
    centres = rng.normal(size=(12, 16))
    return centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, 16))


@pytest.mark.parametrize(("spread", "share"), [(0.05, 0.4), (5.0, 1.0)])
def test_cells_give_what_a_scan_gives(spark, spread, share):
    rng = np.random.default_rng(7)
    vectors = clustered(rng, 700, spread).astype(np.float32)
    vectors[50:60] = vectors[49]  # copies tie exactly
    rows = [(i, i % 5, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(9000, 0, None), (9001, 0, [1.0]), (9002, 0, [float("nan")] * 16), (9003, 0, [None] * 16), (9004, 0, [0.0] * 16)]
    queries = [(q, v.tolist()) for q, v in enumerate(np.r_[clustered(rng, 40, spread), vectors[49:52]].astype(np.float32))] + [(900, None), (901, [0.0] * 16)]
    index = CellIndex(spark, new_path(spark, "cells"), 16)
    index.build(spark.createDataFrame(rows, "id int, label int, embedding array<float>").repartition(3), cells=30)
    asked = spark.createDataFrame(queries, "query_id int, vector array<float>")
    for scope, wanted in ((None, range(5)), ("label in (1, 2)", (1, 2))):
        hits, report = index.search(asked, 6, ["id"], scope)
        own = [i for i in range(700) if i % 5 in wanted]
        x = vectors[own].astype(np.float64)
        want = []
        for q, v in queries[:43]:
            v = np.array(v, np.float32).astype(np.float64)
            s = np.array([(a * v).sum() for a in x]) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum()))
            best = sorted(zip(-np.round(s, 12), own, strict=True))[:6]
            want += [(q, r, i) for r, (_, i) in enumerate(best, 1)]
        assert sorted((r["query_id"], r["rank"], r["id"]) for r in hits.collect()) == sorted(want)
    read = report.agg(F.sum("cells"), F.sum("cells_read")).first()
    assert read[1] <= share * read[0], read


def test_nothing_is_written_for_each_query_and_cell(spark, monkeypatch):
    from storyloom.operators import cells

    tables = []

    def kept(df, name="table"):
        out = written(df, name)
        tables.append((name, out.count()))
        return out

    monkeypatch.setattr(cells, "written", kept)
    monkeypatch.setattr(cells, "LEAST", 16)  # many blocks
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[100:140] = vectors[99]  # more copies than k, in several blocks
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, embedding array<float>")
    index = CellIndex(spark, new_path(spark, "cells"), 8)
    index.build(made, cells=25)
    hits, report = index.search(made.selectExpr("id as query_id", "embedding as vector"), 4, ["id"])
    x = vectors.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    near = np.round(x @ x.T, 12)
    want = sorted((q, r, int(i)) for q in range(400) for r, i in enumerate(np.lexsort((np.arange(400), -near[q]))[:4], 1))
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in hits.collect()) == want
    assert max(n for _, n in tables) <= 400, tables
    assert report.count() == 400 and report.agg(F.max("cells")).first()[0] == 25


def test_an_empty_index(spark):
    index = CellIndex(spark, new_path(spark, "cells"), 3)
    index.build(spark.createDataFrame([(1, None)], "id int, embedding array<float>"))
    assert index.search(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id int, vector array<float>"), 3, ["id"])[0].count() == 0


def test_distinct_words(spark):
    got = spark.createDataFrame([("Ab ab, Ça 12!",), (None,)], "t string").select(words(F.col("t"))).collect()
    assert [r[0] for r in got] == [["ab", "ça", "12"], None]
