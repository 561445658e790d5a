import hashlib
import random
import re
from collections import Counter, defaultdict
from math import comb

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storyloom.llm import mixing
from storyloom.llm.queries import op5_source_mixing

SF = "/root/testdata/sf0.01"


def plain_targets(sizes):
    """{source: size} -> {source: target}, sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, money = {}, list(order), 1.5 * sum(sizes.values())
    while left:
        share = {s: money * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] > 2 * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            money -= target[s]
            left.remove(s)
    return target


def test_query(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for d, x in zip(t["doc_id"], t["text"], strict=True)}
    sums = Counter()
    for d, s in zip(t["doc_id"], t["source"], strict=True):
        sums[s] += size[d]
    want, rows = plain_targets(sums), op5_source_mixing(spark, SF).collect()
    source, taken = dict(zip(t["doc_id"], t["source"], strict=True)), Counter()
    assert len(rows) == len(size)
    for r in rows:
        draws = [tuple(map(int, x.split(":"))) for x in r["shards"].split(",") if x]
        assert sum(n for _, n in draws) == r["taken"] and all(0 <= k < mixing.SHARDS[0] and n > 0 for k, n in draws)
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sums[s]) and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(rows) == sorted(op5_source_mixing(spark, SF).collect())


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 100, 10_000]) for s in [None, *"abcdéZ", "aa"][: rng.randrange(1, 9)]}
    got = {r["_src"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "_src string, source_size long")).collect()}
    assert got.keys() == sizes.keys()
    assert all(got[s] == pytest.approx(x) for s, x in plain_targets(sizes).items())


def test_tree_gives_every_draw_to_one_shard(spark):
    quotas = {0: 1000, 1: 0, 2: 7, 3: 350, 4: 1}
    df = spark.createDataFrame(list(quotas.items()), "rank int, draws long")
    for shards in (1, 2, 5, 16):
        ends = {r["rank"]: r["ends"] for r in mixing.splitting_tree(df, shards, 3).collect()}
        counts = {k: [b - a for a, b in zip([0, *e], e, strict=False)] for k, e in ends.items()}
        assert all(len(c) == shards and min(c) >= 0 and sum(c) == quotas[k] for k, c in counts.items())
        totals = [sum(c[i] for c in counts.values()) for i in range(shards)]
        assert max(totals) - min(totals) <= 1 + shards.bit_length()


def plain_split(counts, first, width, seed, out):
    """The tree's quotas, each draw by the exact distribution function."""
    if width == 1:
        out[first] = counts
        return out
    half, total = width // 2, sum(counts)
    draws, left = total * half // width, []
    for i, good in enumerate(counts):
        u = (int(hashlib.md5(f"tree{seed}:{first}:{width}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        goal, done, v = u * comb(total, draws), 0, max(0, draws - (total - good))
        while (done := done + comb(good, v) * comb(total - good, draws - v)) < goal:
            v += 1
        left.append(v)
        total, draws = total - good, draws - v
    plain_split(left, first, half, seed, out)
    return plain_split([a - b for a, b in zip(counts, left, strict=True)], first + half, width - half, seed, out)


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_shard_quotas_against_exact_hypergeometric_draws(spark, shards):
    counts = [40, 0, 7, 350, 1, 93]
    df = spark.createDataFrame(list(enumerate(counts)), "rank int, draws long")
    ends = {r["rank"]: [0, *r["ends"]] for r in mixing.splitting_tree(df, shards, 5).collect()}
    got = {k: [ends[i][k + 1] - ends[i][k] for i in range(len(counts))] for k in range(shards)}
    assert got == plain_split(counts, 0, shards, 5, {})


def test_cut_of_a_block_by_slices(spark, docs_of, monkeypatch):
    """However a block's order is cut into ranges, the same words are taken."""
    rng = random.Random(2)
    docs = docs_of([(rng.choice([None, i]), "w " * rng.randrange(6), None, rng.choice("abc")) for i in range(400)])
    key = lambda r: (str(r["_id"]), r["_size"], str(r["draws"]))
    want = sorted(map(key, mixing.plan(docs).collect()))
    for slices in (1, 2**20):
        monkeypatch.setattr(mixing, "SLICES", slices)
        assert sorted(map(key, mixing.plan(docs).collect())) == want


def test_shards_follow_the_mix_and_their_parts_are_bounded(spark, monkeypatch):
    assert [mixing.shards_for(x) for x in (None, 0, 16 << 24, 40 << 24, 10**15)] == [16, 16, 16, 40, 1024]
    monkeypatch.setattr(mixing, "PART_WORDS", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held, places = Counter(), defaultdict(list)
    for r in mixing.mixed(docs, shards=2).collect():
        held[r["shard"], r["part"]] += r["words"]
        places[r["shard"], r["part"]].append(r["_place"])
    assert len(held) > 20 and sum(n <= 6000 for n in held.values()) > 0.9 * len(held)
    for shard in (0, 1):  # parts are ranges of a shard's order
        parts = [places[k] for k in sorted(places) if k[0] == shard]
        assert all(max(a) <= min(b) for a, b in zip(parts, parts[1:], strict=False))


def test_hypergeometric_has_the_right_moments(spark):
    u = (F.col("id") + 0.5) / 4000
    x = mixing.hypergeometric(F.lit(60), F.lit(200), F.lit(50), u)
    r = spark.range(4000).select(x.alias("x")).agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    assert r["m"] == pytest.approx(15, abs=0.05) and r["v"] == pytest.approx(50 * 0.3 * 0.7 * 150 / 199, rel=0.02)
    assert 0 <= r["lo"] <= r["hi"] <= 50
    edge = spark.range(1).select(*[mixing.hypergeometric(F.lit(g), F.lit(t), F.lit(n), F.lit(0.4)) for g, t, n in ((0, 0, 0), (5, 5, 3), (0, 9, 4), (5, 9, 9), (1, 9, 0))]).first()
    assert tuple(edge) == (0, 3, 0, 5, 0)


def test_mixed_rows_are_the_plan(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planned = defaultdict(list)
    for r in mixing.plan(docs, shards=5).collect():
        planned[r["_id"]] += [(x["shard"], x["words"], x["copy"]) for x in r["draws"]]
    got, shards = defaultdict(list), Counter()
    for r in mixing.mixed(docs, shards=5).collect():
        got[r["_id"]].append((r["shard"], r["words"], r["copy"]))
        shards[r["shard"]] += r["words"]
        assert r["_row"]["doc_id"] == r["_id"] and r["words"] <= r["_size"]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in planned.items() if v}
    assert sorted(shards) == list(range(5)) and max(shards.values()) < 2 * min(shards.values())


def test_edges(spark, docs_of):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "x y", None, None), (None, "x y z", None, None), (4, "one", None, "b"), (4, "one", None, "b"), (5, "w " * 50_000, None, "c")]
    docs = docs_of(rows).withColumn("rank", F.lit("clash")).withColumn("_h", F.lit(1)).withColumn("shard", F.lit(2))
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    want, taken = plain_targets({"a": 0, None: 5, "b": 2, "c": 50_000}), Counter()
    for r in got:
        taken[r["_src"]] += sum(x["words"] for x in r["draws"])
    assert all(abs(taken[s] - x) <= 2 for s, x in want.items())
    assert mixing.plan(docs_of([])).count() == 0
    assert [r["draws"] for r in mixing.plan(docs_of([(1, None, None, "a")])).collect()] == [[]]
    assert len(mixing.mixed(docs).collect()) == sum(len(r["draws"]) for r in got)
