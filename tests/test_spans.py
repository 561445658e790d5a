"""Linear text spans, interval sweeps and as-of merges against plain versions and on long inputs."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.functions.arrays import running
from storyloom.operators import history as H
from storyloom.operators import spans as S
from storyloom.operators.intervals import sweep

FAR = 1 << 62


def test_running_sums_of_arrays(spark):
    rows = [(0, [3, 1, 4]), (1, []), (2, None), (3, [None, 2, None, 5]), (4, [7])]
    got = spark.createDataFrame(rows, "i int, x array<int>").repartition(2).select("i", running("x").alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {0: [0, 3, 4], 1: [], 2: None, 3: [0, 0, 2, 2], 4: [0]}


def test_long_texts_cost_what_their_length_does(spark):
    """Folds that copy their array at each step do not end here."""
    n = 60_000
    text = "\n".join(f'line {i} "said {i}" the end' for i in range(n))
    docs = spark.createDataFrame([(1, text)], "d int, text string")
    rows = S.paragraphs(docs, ["d"]).agg(F.count("*"), F.max("char_end")).first()
    assert tuple(rows) == (n, len(text))
    assert docs.select(F.size(X.occurrences(F.col("text"), F.lit("the")))).first()[0] == n
    tiles = docs.select(F.inline(S.cover(X.matches(F.col("text"), '"[^"\\n]*"'), F.length("text")))).agg(F.count("*"), F.sum(F.expr("char_end - char_start"))).first()
    assert tuple(tiles) == (2 * n + 1, len(text))


def test_a_needle_that_looks_like_a_quoting_mark(spark):
    docs = spark.createDataFrame([("a\\Eb\\E", "\\E"), ("x.x", "."), ("", "a"), (None, "a")], "t string, n string")
    assert [r[0] for r in docs.select(X.occurrences(F.col("t"), F.col("n"))).collect()] == [[1, 4], [1], [], None]


def spans_of(rng, n):
    out = []
    for i in range(n):
        start = rng.choice([None, *[rng.randrange(200)] * 6])
        end = None if rng.random() < 0.15 else (start or 0) + rng.randrange(-2, 30)
        out.append((rng.choice([1, 1, 1, 2, None]), i, start, end))
    return out


@pytest.mark.parametrize("crowd", [1 << 20, 60, 5])
def test_sweep_against_all_pairs(spark, crowd):
    rng = random.Random(crowd)
    a, b = spans_of(rng, 250), spans_of(rng, 250)
    end = lambda x: FAR if x[3] is None else x[3]
    fine = lambda x: x[0] is not None and x[2] is not None and x[2] < end(x)
    want = sorted((x[1], y[1]) for x in a for y in b if fine(x) and fine(y) and x[0] == y[0] and max(x[2], y[2]) < min(end(x), end(y)))
    left, right = spark.createDataFrame(a, "k int, a int, s1 int, e1 int"), spark.createDataFrame(b, "k int, b int, s2 int, e2 int")
    met = sweep(left.repartition(3), right, ["k"], (F.col("s1"), F.col("e1")), (F.col("s2"), F.col("e2")), crowd=crowd)
    assert met.columns == ["k", "a", "s1", "e1", "b", "s2", "e2"]
    assert sorted((r["a"], r["b"]) for r in met.collect()) == want
    assert sweep(left.limit(0), right, ["k"], (F.col("s1"), F.col("e1")), (F.col("s2"), F.col("e2"))).count() == 0


def test_sweep_of_a_large_document(spark):
    n = 30_000
    left = spark.range(n).select(F.lit(1).alias("d"), F.col("id").alias("a"), (F.col("id") * 7).alias("char_start"), (F.col("id") * 7 + 5).alias("char_end"))
    right = spark.range(n).select(F.lit(1).alias("d"), F.col("id").alias("b"), (F.col("id") * 7 + 3).alias("s_start"), (F.col("id") * 7 + 9).alias("s_end"))
    assert S.overlaps(left, right, ["d"]).agg(F.count("*"), F.sum(F.expr("char_end - char_start"))).first()[0] == 2 * n - 1


def history_of(rng, keys):
    out = []
    for k in range(keys):
        at = rng.randrange(5)
        for v in range(rng.randrange(8)):
            until = at + rng.randrange(4)
            out.append((k, v, at, None if v == 7 else until))
            at = until + rng.randrange(2)
    return out


def test_as_of_and_held_at_against_all_pairs(spark):
    rng = random.Random(3)
    facts = history_of(rng, 30) + [(None, 0, 0, None), (3, 99, None, None)]
    asked = [(rng.choice([None, *range(31)]), rng.choice([None, *range(25)]), i) for i in range(200)]
    held = lambda f, p: f[0] is not None and f[0] == p[0] and p[1] is not None and f[2] is not None and f[2] <= p[1] and (f[3] is None or p[1] < f[3])
    want = sorted((p[2], f[1]) for f in facts for p in asked if held(f, p))
    history, points = spark.createDataFrame(facts, "k int, v int, s int, e int"), spark.createDataFrame(asked, "k int, at int, p int")
    merged = H.as_of(history, points, ["k"], "s", "e", "at")
    assert sorted((r["p"], r["v"]) for r in merged.collect()) == want
    assert "Join" not in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["p"], r["v"]) for r in H.held_at(history, points, ["k"], "s", "e", "at").collect()) == want


def test_greedy_longest_streams_a_key(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), s := rng.randrange(300), s + rng.randrange(1, 12), str(i)) for i in range(600)]
    want = []
    for d in range(3):
        until = -1
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], -r[2], r[3])):
            if r[1] >= until:
                want.append(r)
                until = r[2]
    got = S.greedy_longest(spark.createDataFrame(rows, "d int, char_start int, char_end int, n string"), ["d"]).collect()
    assert sorted(map(tuple, got)) == sorted(want)
