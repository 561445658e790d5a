import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import phrases
from storyloom.llm.perfect_hash import PerfectHash
from storyloom.llm.queries import op12_phrase_collocations

UPPER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09]+")


def plain(rows, least, longest=5, top=2000):
    """What the contract says, by counting everything."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = WORD.findall(piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in frequent.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def told(found):
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def corpus(rng, n):
    words = [f"w{i}" for i in range(30)] + ["É", "A", "a", "日本", "x y", "q\x1cq"]
    fixed = [" ".join(rng.choices(words, k=k)) for k in (2, 3, 5, 6, 7) for _ in range(3)]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(rng.randrange(0, 12))]
        text = "".join(p + rng.choice([" ", "\t", ". ", ",", "\n", "\x0b", "! ? ", "..", " "]) for p in parts)
        out.append((rng.choice([text, text, text.upper(), None]), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize(("slots", "tokens", "dense"), [(1 << 21, 1 << 20, 1 << 22), (60, 900, 100)])
def test_against_plain_counts(spark, monkeypatch, slots, tokens, dense):
    """Whatever is cut into shards, batches and sparse counters."""
    for name, value in (("SLOTS", slots), ("TOKENS", tokens), ("DENSE", dense), ("VOCABULARY", 20 if slots == 60 else 1 << 19), ("CHARS", 16 if slots == 60 else 1 << 20)):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(random.Random(slots), 700)
    docs = spark.createDataFrame(rows + rows[:5], "text string, lang string").withColumns({"id": F.lit(1), "n": F.lit("x")})
    found = phrases.collocations(docs.repartition(5), min_count=12, top=20)
    want = plain(rows + rows[:5], 12, top=20)
    assert len(want) > 30 and told(found) == want


def test_repeats_overlap_and_parts_drop(spark):
    rows = [("a a a a a a", "en")] * 30 + [("only here now.", "de")] * 30 + [("x y", "de")] * 29
    found = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), min_count=30)
    got = told(found)
    assert got == plain(rows, 30)
    assert [r[2] for r in got if r[0] == "de"] == ["only here now"] and [r[3] for r in got if r[2] == "a a"] == [150]


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**12
    rows = [("en", "p", "w", big, [big, big], [big, big])]
    made = spark.createDataFrame(rows, "lang string, phrase string, word string, a long, firsts array<long>, lasts array<long>").withColumn("n", F.lit(10**14))
    assert made.select(F.expr(phrases.best_cut("n")).alias("c")).first()["c"]["score"] == 1000 * big * 10**14 // (big * big)


def test_nothing_frequent(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "x"), ("one two.", None)], "text string, lang string")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**63), 2**63, n))
        made = PerfectHash.load(PerfectHash.of(keys).dump())
        slots = made.slots(keys)
        assert (np.sort(slots) == np.arange(len(keys))).all() and (made.keys[slots] == keys).all()
        assert (made.slots(rng.integers(0, 2**40, 5000) - 2**50) == -1).all()
        assert len(made.bits) * 64 < 6 * len(keys) + 1000


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert told(op12_phrase_collocations(spark, sf)) == plain(rows, 100)


def test_words_of_rows_given_out_are_freed():
    import gc

    import pyarrow as pa

    from storyloom.llm import phrases as P

    texts = [" ".join(f"w{i * P.DISTINCT + k}" for k in range(P.DISTINCT)) for i in range(3)]
    gc.collect()
    gc.disable()
    try:
        rows = sum(1 for _ in P._coded(iter([pa.record_batch({"lang": ["en"] * 3, "text": texts})])))
        left = sum(len(x) for x in gc.get_objects() if isinstance(x, dict) and b"w1" in x)
    finally:
        gc.enable()
    assert rows == 3 and left == 0


def test_tables_of_large_rows_have_small_row_groups(spark, tmp_path):
    import os

    import pyarrow.parquet as pq

    from storyloom.llm import common

    rows = spark.createDataFrame([(i, bytearray(os.urandom(1 << 20))) for i in range(24)], "id long, blob binary").coalesce(1)
    held = common.settle(rows, "blobs", large=True)
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in held.inputFiles()]
    assert sum(m.num_rows for m in found) == 24
    assert max(m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)) <= 8


def test_a_key_is_given_out_a_few_times_however_many_tasks_meet_it(spark, monkeypatch):
    given, plain_step = spark.sparkContext.accumulator(0), phrases._candidates

    def step(batches, **told):
        for b in plain_step(batches, **told):
            given.add(b.num_rows)
            yield b

    monkeypatch.setattr(phrases, "_candidates", step)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(" ".join(rng.choices(words, k=400)), "en") for _ in range(48)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a task for each file
    try:
        found = told(phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(24), min_count=60, longest=2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 144 and found == plain(rows, 60, longest=2)
    assert given.value <= 6 * 144


@pytest.mark.parametrize("known", [0, 50])
def test_keys_that_tasks_are_not_told_of_count_once(spark, monkeypatch, known):
    monkeypatch.setattr(phrases, "KNOWN", known)
    monkeypatch.setattr(phrases, "FIRST", 1)
    rows = corpus(random.Random(known), 400)
    assert told(phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(7), min_count=12, top=50)) == plain(rows, 12, top=50)
