import random
import re

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from storyloom.llm import simhash
from storyloom.llm.graph import components

UPPER = {i: i + 32 for i in range(65, 91)}


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, radius):
    """marks: (id, fp) -> component of each row, by comparing all pairs."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if ((marks[i][1] ^ marks[j][1]) & (1 << 64) - 1).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(marks):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(marks))]


def check(found, rows, k=4, radius=4):
    marks = [(d, plain_fingerprint(t, k)) for d, t in rows]
    want = sorted(map(str, zip((d for d, _ in marks), (f"{f:016x}" for _, f in marks), plain_components(marks, radius), strict=True)))
    got = sorted(str((r["id"], r["fingerprint"], r["component_id"])) for r in found.collect())
    assert got == want


def test_driver_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    t = pq.read_table(path)
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    check(simhash.near_duplicates(spark.read.parquet(path), shingle=4), rows)


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c"), (None, "A B C"), (7, "x y z w v"), (7, "x y z w v"), (8, "w " * 70000)]
    check(simhash.near_duplicates(docs_of(rows), shingle=4), rows)
    assert simhash.near_duplicates(docs_of([])).count() == 0
    kept = simhash.survivors(docs_of(rows), shingle=4).collect()
    assert sorted((r["doc_id"] for r in kept)) == [1, 4, 6, 7, 8]


def test_hot_cells_are_cut(spark, monkeypatch):
    """Random fingerprints and chains of near ones, with cells far beyond the limit: nothing is lost."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng, marks = random.Random(5), set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            marks.add(f)
            for b in rng.sample(range(64), rng.choice([2, 4, 5])):
                f ^= 1 << b
    base = rng.getrandbits(64)
    marks |= {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    signed = [f - (1 << 64) if f >> 63 else f for f in marks]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(df, 4)).collect()}
    parts = {}
    for f in signed:
        parts.setdefault(found.get(f, f), set()).add(f)
    want = {}
    for f, c in zip(signed, plain_components([(f, f) for f in signed], 4), strict=True):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_components_of_many_links(spark, monkeypatch):
    """Stars, chains and pairs, with the tables that large inputs get."""
    from storyloom.llm import graph

    rng = random.Random(4)
    edges = [(7, k) for k in range(100, 400)] + [(k, k + 1) for k in range(1000, 1100)] + [(2 * k, 2 * k + 1) for k in range(2000, 2050)] + [(5, 5), (400, 7)]
    edges += [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(120)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {n: min(g) for g in plain_groups(edges) for n in g}
    for many in (graph.MANY, 1):
        monkeypatch.setattr(graph, "MANY", many)
        assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def plain_groups(edges):
    groups = []
    for a, b in edges:
        if a != b:
            joined = [g for g in groups if a in g or b in g]
            groups = [g for g in groups if g not in joined] + [set().union({a, b}, *joined)]
    return groups


def test_more_blocks_for_more_fingerprints():
    assert len(simhash.block_masks(1000, 4)) == 5
    assert len(simhash.block_masks(10**9, 4)) > 5


def test_survivors_keep_columns(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(400))
    docs = docs_of([(5, text, "en"), (3, text + " tail", "de"), (9, "else entirely", "fr")]).withColumn("fp", F.lit("mine")).withColumn("id", F.lit(1))
    kept = {r["doc_id"]: r for r in simhash.survivors(docs).collect()}
    assert sorted(kept) == [3, 9] and kept[3]["lang"] == "de" and kept[3]["fp"] == "mine" and kept[9].asDict().keys() == set(docs.columns)


def jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_survivors_drop_near_copies(spark, docs_of):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, near = [], []
    for d in range(300):
        base = [word() for _ in range(300)]
        rows.append((d, " ".join(base)))
        if d % 3 == 0:
            for i in rng.sample(range(300), 2):
                base[i] = word()
            near.append((1000 + d, " ".join(base)))
            assert jaccard(rows[-1][1], near[-1][1]) > 0.9
    kept = {r["doc_id"] for r in simhash.similar_survivors(docs_of(rows + near)).collect()}
    assert {d for d, _ in rows} <= kept
    assert len(kept) - len(rows) <= 2


def test_similar_survivors_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (4, "One"), (5, "one"), (6, "a b c"), (None, "A B C"), (7, "x y z w v"), (7, "x y z w v"), (8, "w " * 70000)]
    docs = docs_of(rows).withColumn("name", F.lit("mine")).withColumn("w0", F.lit(1))
    out = simhash.similar_survivors(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 4, 6, 7, 8]
    assert simhash.similar_survivors(docs_of([])).count() == 0


def test_candidates_may_differ_by_seven_deviations_more_than_the_mean():
    assert simhash.wide_radius(0.8) == 38 and simhash.candidate_radius(0.8) == 78


def pairs_at(rng, similarity, n):
    """n pairs of texts of 100 to 300 words whose shingles have that Jaccard similarity or slightly more."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    for _ in range(n):
        a = [word() for _ in range(rng.randint(100, 300))]
        b = list(a)
        while jaccard(" ".join(a), " ".join(b)) > similarity + 0.03:
            b.append(word())
        while jaccard(" ".join(a), " ".join(b)) < similarity:
            b.pop()
        yield " ".join(a), " ".join(b)


def test_similar_survivors_lose_no_pair_at_the_threshold(spark, docs_of):
    pairs = list(pairs_at(random.Random(5), 0.8, 150))
    assert all(0.8 <= jaccard(a, b) <= 0.83 for a, b in pairs)
    rows = [x for i, (a, b) in enumerate(pairs) for x in ((i, a), (1000 + i, b))]
    # Few words: four of five shingles; a line that one of the texts repeats makes it no less similar.
    rows += [(500, "a b c d e f g h"), (1500, "a b c d e f g h i"), (501, pairs[0][0].upper() + " zz"), (502, "q r s t u " * 400 + " ".join(f"v{i}" for i in range(60))), (1502, "q r s t u q r s t u " + " ".join(f"v{i}" for i in range(60)))]
    kept = {r["doc_id"] for r in simhash.similar_survivors(docs_of(rows)).collect()}
    assert kept == {*range(150), 500, 502}


def test_similar_survivors_keep_what_is_below_the_threshold(spark, docs_of):
    pairs = [x for k, s in enumerate((0.6, 0.7, 0.75)) for x in pairs_at(random.Random(k), s, 40)]
    assert all(jaccard(a, b) < 0.8 for a, b in pairs)
    rows = [x for i, (a, b) in enumerate(pairs) for x in ((i, a), (1000 + i, b))]
    assert simhash.similar_survivors(docs_of(rows)).count() == len(rows)


def test_names_are_joined_by_shuffle_beyond_their_bound(spark, docs_of, monkeypatch):
    pairs = list(pairs_at(random.Random(7), 0.85, 20))
    rows = [x for i, (a, b) in enumerate(pairs) for x in ((i, a), (1000 + i, b), (2000 + i, a.upper()))] + [(None, "some words of no id"), (None, "SOME words of no id")]
    monkeypatch.setattr(simhash, "NAMES", 0)
    kept = [r["doc_id"] for r in simhash.similar_survivors(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted([*range(20), None], key=str)


def test_crowded_candidates_are_cut(spark, docs_of, monkeypatch):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base, *(f"t{i}x{k}" for k in range(rng.randint(0, 60)))])) for i in range(120)]
    want = {min(c) for c in plain_linked(rows)}
    monkeypatch.setattr(simhash, "CHUNK", 3000)
    assert {r["doc_id"] for r in simhash.similar_survivors(docs_of(rows)).collect()} == want


def plain_linked(rows):
    """Components of rows of Jaccard similarity 0.8 or more, by comparing all pairs."""
    groups = []
    for d, t in rows:
        joined = [g for g in groups if any(jaccard(t, o) >= 0.8 for _, o in g)]
        groups = [g for g in groups if g not in joined] + [[(d, t), *(x for g in joined for x in g)]]
    return [[d for d, _ in g] for g in groups]
