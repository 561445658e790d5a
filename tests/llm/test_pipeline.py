import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall(text.translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of each stage, written and read as the driver does."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out["input"] = docs.collect()
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mixing", "packing"]
    for name, _ in C.STAGES[:-1]:
        assert stages[name] and stages[name][0].__fields__ == C.COLUMNS


def test_language(stages):
    want = sorted(r["doc_id"] for r in stages["input"] if r["text"] and any(c.isalpha() for c in r["text"]))
    assert sorted(r["doc_id"] for r in stages["language_id"]) == want


def test_exact(stages):
    best = {}
    for r in stages["language_id"]:
        low = r["text"].translate(UPPER)
        best[low] = max(r["doc_id"], best.get(low, r["doc_id"]))
    assert sorted(r["doc_id"] for r in stages["exact_dedup"]) == sorted(best.values())
    before = {r["doc_id"]: r for r in stages["input"]}
    assert all(r.asDict() == before[r["doc_id"]].asDict() for r in stages["exact_dedup"])


def test_near(stages):
    """Of each component of texts of similarity 0.8 or more, by comparing all pairs, the smallest id stays."""
    before = {r["doc_id"]: shingles(r["text"]) for r in stages["exact_dedup"]}
    root = {d: d for d in before}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in stages["simhash_near_dedup"]) == sorted({find(d) for d in ids})
    rows = {r["doc_id"]: r.asDict() for r in stages["exact_dedup"]}
    assert all(r.asDict() == rows[r["doc_id"]] for r in stages["simhash_near_dedup"])


def test_mix(stages):
    words = lambda r: len(WORD.findall(r["text"]))
    before = {r["doc_id"]: r for r in stages["simhash_near_dedup"]}
    taken, per_source, sizes = Counter(), Counter(), Counter()
    for r in before.values():
        sizes[r["source"]] += words(r)
    for r in stages["source_mixing"]:
        assert r["n_chars"] == len(r["text"]) and r["source"] == before[r["doc_id"]]["source"]
        taken[r["doc_id"]] += words(r)
        per_source[r["source"]] += words(r)
    assert all(n <= 2 * words(before[d]) for d, n in taken.items())
    assert sum(per_source.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    assert all(per_source[s] <= 2 * n for s, n in sizes.items())


def test_pack(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(tuple([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]) for r in stages["source_mixing"])
    windows = defaultdict(list)
    for r in stages["packing"]:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(k) * n for k, n in want.items())
    assert sum(r["length"] for r in stages["packing"]) == total
    once = defaultdict(list)
    for r in stages["packing"]:
        once[r["doc_id"], r["doc_tokens"]].append(r)
    ids = {len(k): k for k in want}
    for (_, n), pieces in once.items():
        starts = [p["start"] for p in pieces]
        if len(starts) == len(set(starts)) and sum(len(k) == n for k in want) == 1:
            whole = np.frombuffer(b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["start"])), "<u4")
            assert tuple(whole.tolist()) == ids[n]


def test_run_is_its_stages(spark, stages):
    got = Counter((r["doc_id"], r["doc_tokens"]) for r in C.run(spark, SF).where("start = 0").collect())
    assert got == Counter((r["doc_id"], r["doc_tokens"]) for r in stages["packing"] if r["start"] == 0)


def test_stages_on_empty_and_odd_tables(spark):
    """Nulls in every column, empty, repeated and long texts, through all stages; each has a defined result."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    assert C.STAGES[-1][1](spark, C.mix_sources(spark, C.drop_near_copies(spark, C.drop_copies(spark, C.identify_language(spark, spark.createDataFrame([], kind), SF), SF), SF), SF), SF).count() == 0
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", None, None, 15), (3, "word " * 5000, "en", "b", 25000), (4, "42 !", "en", "b", 4), (5, "Some WORDS here", "en", "a", 15), (5, "Some WORDS here", "en", "a", 15)]
    docs, kept = spark.createDataFrame(rows, kind), {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        kept[name] = sorted(((r["doc_id"], r["text"][:4].lower(), r["lang"]) for r in docs.collect()), key=str)
    assert kept["language_id"] == [(3, "word", "en"), (5, "some", "en"), (5, "some", "en"), (None, "some", "en")]  # no letter: gone; the null label is filled
    assert kept["exact_dedup"] == kept["simhash_near_dedup"] == [(3, "word", "en"), (5, "some", "en")]
    words = {r["doc_id"]: 0 for r in docs.collect()}
    for r in docs.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == {3: 7499, 5: 6}  # half as much again in all, 7504.5: a takes twice its 3 words, b the rest, rounded
    pieces = C.pack_windows(spark, docs, SF).collect()
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


def test_clashing_columns_do_no_harm(spark):
    """Columns beside those of documents, with names that stages use inside, are not carried and change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clash = docs.selectExpr("*", "1 as name", "'x' as lang_pred", "2 as key", "3 as row", "4 as _size", "'y' as w0", "5 as stays", "6 as bucket", "7 as n_parts")
    for plain, other in ((docs, clash),):
        for _, stage in C.STAGES[:3]:
            plain, other = stage(spark, plain, SF), stage(spark, other.selectExpr("*", "1 as root") if "root" not in other.columns else other, SF)
            assert plain.columns == other.columns == C.COLUMNS
        assert sorted(map(str, plain.collect())) == sorted(map(str, other.collect()))


def test_language_keeps_texts_when_no_label_is_usable(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    held = next(i for i in range(99) if spark.range(i, i + 1).where("crc32(cast(id as string)) % 5 = 0").count())
    for rows in ([(1, "some words", None, "a", 10)], [(held, "some words", "en", "a", 10), (None, "more words", "en", "a", 10)]):
        docs = spark.createDataFrame([*rows, (7, "12 34", None, "a", 5)], kind)
        assert C.identify_language(spark, docs, SF).count() == len(rows)
