import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from storyloom.llm import language
from storyloom.llm.queries import op10_language_id

SF = "/root/testdata/sf0.001"


def plain_vector(text):
    """One 3-gram at a time."""
    low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text} ")
    low = f" {' '.join(low.split())} "
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(low, low[1:], low[2:], strict=False):
        total += np.roll(language.letter_vector(ord(a)), 2).astype(int) * np.roll(language.letter_vector(ord(b)), 1) * language.letter_vector(ord(c))
    return total


def test_vectors():
    for text in ["Él año, y?", "x", "The the THE 12 ß İ", "汉字 汉", "a" * 50]:
        assert np.array_equal(language.Bundler().vector(text), plain_vector(text))
    assert language.Bundler().vector("12 .. \n") is None


def test_long_text_and_small_table(monkeypatch):
    text = "lorem ipsum dolor sit amet " * 300
    whole = language.Bundler().vector(text)
    monkeypatch.setattr(language, "GRAMS", 64)
    monkeypatch.setattr(language, "TOGETHER", 32)
    assert np.array_equal(language.Bundler().vector(text), whole)


def test_a_text_in_parts_has_the_grams_of_the_whole(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "É", " ", "  ", ".", "12", "汉", "bc", "\n"], k=rng.randrange(60))) for _ in range(300)]
    whole = [language.grams(t) for t in texts]
    for chars in (1, 2, 3, 7):
        monkeypatch.setattr(language, "CHARS", chars)
        for t, (ids, counts) in zip(texts, whole, strict=True):
            got = language.grams(t)
            assert np.array_equal(got[0], ids) and np.array_equal(got[1], counts), (t, chars)


def test_held_out_accuracy(spark):
    labels = dict(zip(*pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pydict().values(), strict=True))
    rows = op10_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in out) >= 0.97 * len(out)


def test_query_against_plain_profiles(spark):
    """Every prediction and score of the table, from vectors made one 3-gram at a time."""
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    vectors = {d: plain_vector(r["text"]) if r["text"] and any(c.isalpha() for c in r["text"]) else None for d, r in rows.items()}
    known = {}
    for d, v in vectors.items():
        if v is not None and v.any() and rows[d]["lang"] is not None and zlib.crc32(str(d).encode()) % 5:
            known[rows[d]["lang"]] = known.get(rows[d]["lang"], 0) + np.rint(v * (language.UNIT / np.sqrt(v @ v)))
    names = sorted(known)
    matrix = np.stack([known[n] / np.linalg.norm(known[n]) for n in names])
    for r in op10_language_id(spark, SF).collect():
        v = vectors[r["doc_id"]]
        if v is None or not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosines = matrix @ v / np.linalg.norm(v)
        assert r["lang_pred"] == names[int(np.argmax(cosines))] and abs(r["score"] - min(1, max(0, cosines.max()))) < 1e-9


def test_labels_are_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = language.learn_from(docs)
    plain = language.identified(docs, known)[0].select("c0", "lang_pred", "score")
    other = language.identified(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), known)[0].select("c0", "lang_pred", "score")
    assert plain.exceptAll(other).count() == 0


def test_prototypes_do_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = language.learn_from(docs.coalesce(1)), language.learn_from(docs.repartition(9))
    assert one.keys() == many.keys() and all(np.array_equal(one[k], many[k]) for k in one)


def test_edges(spark, docs_of):
    rows = [(1, None, "en"), (2, "", "en"), (3, "42 !", None), (None, "the cat", "en"), (4, "the cat", None), (4, "the cat", None), (5, "the dog and the cat " * 20, "en"), (6, "el perro y el gato " * 20, "es"), (7, "el perro y el gato", "es"), (8, "the dog", "en")]
    docs = docs_of(rows).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("s"))
    found, names = language.identified(docs, language.learn_from(docs))
    got = {(r["c0"], r["c1"]): r for r in found.collect()}
    assert names == docs.columns and found.count() == len(rows)
    assert [got[k]["lang_pred"] for k in ((1, None), (2, ""), (3, "42 !"))] == ["und"] * 3
    assert got[7, "el perro y el gato"]["lang_pred"] == "es" and got[4, "the cat"]["lang_pred"] == "en"
    none = language.identified(docs, {})[0].collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.learn_from(docs_of([])) == {}
