import random

from pyspark.sql import functions as F

from storyloom.operators import segmentation as G
from storyloom.shared import written

NAMES = ["沈舟", "顾远", "白术", "陆离", "青禾", "赵安平", "钱若水", "孙长庚", "李云起", "周怀瑾"]
FILLER = "的了是在有他我你们这那就说道问看走来去上下里外前后山水火土风雨日月天地人心手口"


def story(rng, lines):
    """Names among characters that follow one another at random; returns the texts and their names in order."""
    texts, told = [], []
    for _ in range(lines):
        own, parts = [], []
        for _ in range(rng.randrange(1, 5)):
            parts.append("".join(rng.choices(FILLER, k=rng.randrange(1, 6))))
            if rng.random() < 0.7:
                own.append(rng.choice(NAMES))
                parts.append(own[-1])
        texts.append("".join(parts) + rng.choice(["。", "，Abc 12", ""]))
        told.append(own)
    return texts, told


def test_a_learned_lexicon_finds_the_names(spark):
    rng = random.Random(2)
    texts, told = story(rng, 4000)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9000, None), (9001, ""), (9002, "no Han")], "id int, text string")
    stats = G.statistics(docs.repartition(4), least=20)
    lexicon = G.learned(stats, cohesion=2.5, freedom=1.5)
    words = {r["word"] for r in lexicon.collect()}
    assert set(NAMES) <= words and len(words) <= len(NAMES) + 2
    cut = {r["id"]: r["words"] for r in G.segmented(docs, lexicon, ["id"]).collect()}
    assert cut[9000] == cut[9001] == cut[9002] == []
    found = right = wanted = 0
    for i, own in enumerate(told):
        assert "".join(cut[i]) == "".join(c for c in texts[i] if "一" <= c <= "鿿")
        got = [w for w in cut[i] if len(w) > 1]
        found, wanted = found + len(got), wanted + len(own)
        right += sum(min(got.count(w), own.count(w)) for w in set(own))
    assert 2 * right / (found + wanted) > 0.97


def test_statistics_by_hand(spark):
    stats = G.statistics(spark.createDataFrame([("ab abc xab",)], "text string"), pattern=r"[a-z]+", longest=2, least=2)
    row = {r["gram"]: r for r in stats.collect()}
    import math

    assert set(row) == {"ab"} and row["ab"]["n"] == 3
    assert abs(row["ab"]["cohesion"] - math.log(3 * 8 / (3 * 3))) < 1e-9
    # before: two beginnings of runs and an x; after: two ends and a c: three neighbours each
    assert abs(row["ab"]["free_before"] - math.log(3)) < 1e-9 and abs(row["ab"]["free_after"] - math.log(3)) < 1e-9


def test_a_word_is_cut_once_however_often_it_occurs(spark, monkeypatch):
    tables = []

    def kept(df, name="table"):
        tables.append(written(df, name))
        return tables[-1]

    monkeypatch.setattr(G, "written", kept)
    text = " ".join(["ab abc xab"] * 500)
    once, often = (G.statistics(spark.createDataFrame([(t,)] * 3, "text string"), pattern=r"[a-z]+", longest=2, least=2) for t in ("ab abc xab", text))
    want = {r["gram"]: (r["n"] * 500, round(r["cohesion"], 9), round(r["free_before"], 9)) for r in once.collect()}
    got = {r["gram"]: (r["n"], round(r["cohesion"], 9), round(r["free_before"], 9)) for r in often.collect()}
    assert set(got) == set(want) == {"ab", "bc", "xa"}
    assert all(got[g][:2] == want[g][:2] for g in got)
    assert len(tables) == 2 and tables[0].count() == tables[1].count()


def test_the_cheapest_path():
    cost = {"ab": 1.0, "bc": 0.5, "c": 1.0, "a": 1.0}
    assert G.cheapest("abc", cost, 3.0, 2) == ["a", "bc"]
    assert G.cheapest("", cost, 3.0, 2) == [] and G.cheapest("zz", cost, 3.0, 2) == ["z", "z"]
    assert G.cheapest("abcz", {"abcz": 1.0, **cost}, 3.0, 4) == ["abcz"]


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "白术")], "id int, text string")
    lexicon = G.learned(G.statistics(docs))
    assert lexicon.count() == 0
    assert G.segmented(docs, lexicon, ["id"]).first()["words"] == ["白", "术"]
    assert docs.select(G.word_set(F.array(F.lit("白术"), F.lit("白"), F.lit("白术")))).first()[0] == ["白术"]
