import random
from collections import defaultdict

from pyspark.sql import functions as F

from storyloom.llm import sentences as S
from storyloom.llm.queries import op2_sentence_span_dedup

SF = "/root/testdata/sf0.001"


def plain_spans(rows):
    """rows: (id, text) -> {(row number, start, end, first id)} by looking at every run of every document."""
    seen, later = {}, defaultdict(list)
    for k, (d, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        found = S.sentences(text or "")
        for i in range(len(found)):
            for j in range(i + 1, len(found) + 1):
                n = sum(s[3] for s in found[i:j])
                if n >= S.MIN_WORDS and j - i >= S.SPAN or n >= max(S.LONG, S.MIN_WORDS):
                    key = tuple(s[2] for s in found[i:j])
                    if key in seen:
                        later[k].append((found[i][0], found[j - 1][1], seen[key]))
                    else:
                        seen[key] = d
                    break
    out = []
    for k, spans in later.items():
        whole = []
        for a, b, first in spans:
            if whole and a <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], b)
            else:
                whole.append([a, b, first])
        out += [(rows[k][0], a, b, first) for a, b, first in whole]
    return sorted(out, key=str)


def spans(df):
    return sorted(((r["id"], r["start"], r["end"], r["first_id"]) for r in df.collect()), key=str)


def test_driver_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    want = plain_spans(rows)
    assert spans(S.repeated_spans(docs)) == want and want
    got = op2_sentence_span_dedup(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["first_doc_id"]) for r in got) == sorted(want)


def test_random_small_texts(spark, docs_of):
    rng = random.Random(8)
    parts = ["One two three four. ", "Five six seven eight nine! ", "ten", "eleven twelve\n", "A b? ", "...", " \n", "thirteen fourteen fifteen sixteen seventeen. ", "so " * 45 + ". ", "一二三四五六七八九十。", "一二三四五六七八九十" * 9]
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choices(parts, k=rng.randrange(24)))) for _ in range(60)]
    rows = [(d if d not in [x for x, _ in rows[:i]] else 100 + i, t) for i, (d, t) in enumerate(rows)]
    assert spans(S.repeated_spans(docs_of(rows).coalesce(1))) == plain_spans(rows)


def test_shared_passage(spark, docs_of):
    passage = "Here begins a passage of several sentences. It goes on for quite some words indeed. Then it says something else again. At last it ends."
    rows = [(1, f"Start of one {passage} tail of one."), (2, f"Quite another head, {passage} And another tail."), (3, "Nothing shared here at all. Just own words for this text.")]
    out = {r["doc_id"]: r["text"] for r in S.deduplicated(docs_of(rows), min_words=8).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1]
    assert "goes on for" not in out[2] and "something else" not in out[2] and out[2].startswith("Quite another head,") and out[2].endswith("And another tail.")


def test_passages_of_over_50_words_go_and_common_lines_stay(spark, docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    line = "All rights are reserved by the maker of this page."
    rows, passages = [], []
    for k in range(40):
        passage, n = [], 0
        while n <= 50:
            m = rng.randrange(4, 13)
            passage.append(" ".join(word() for _ in range(m)) + rng.choice([".", "!", "?"]))
            n += m
        passages.append(" ".join(passage))
        for d in (k, 100 + k):
            head, tail = (" ".join(word() for _ in range(30)) for _ in range(2))
            rows.append((d, f"{head}, {passages[-1]} {tail}.\n{line}\n{word()} {word()}.\n{line}"))
    out = {r["doc_id"]: r["text"] for r in S.deduplicated(docs_of(rows)).collect()}
    for (d, text), passage in zip(rows, [p for p in passages for _ in range(2)], strict=True):
        if d < 100:
            assert out[d] == text
        else:
            inner = passage[len(S.sentences(passage)[0][2]) + 1 :].strip()  # the first sentence goes with what stands before it
            assert inner not in out[d] and out[d].count(line) == 2 and len(out[d].split()) < len(text.split()) - 30


def test_edges(spark, docs_of):
    text = "One two three four five six seven eight nine ten. One two three four five six seven eight nine. Eleven twelve thirteen fourteen fifteen."
    rows = [(1, None), (2, ""), (3, "short."), (4, text), (4, text), (None, text), (5, (text + " ") * 3000)]
    docs = docs_of(rows).withColumn("row", F.lit("clash")).withColumn("spans", F.lit(1))
    out = S.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = sorted((r["text"] for r in out.where("doc_id = 4").collect()), key=len)
    assert texts == ["", text]
    assert out.where("doc_id is null").first()["text"] == "" and out.where("doc_id = 1").first()["text"] is None
    assert len(out.where("doc_id = 5").first()["text"]) < 100
    assert S.repeated_spans(docs_of([])).count() == 0 and S.deduplicated(docs_of([])).count() == 0


def test_long_sentences_and_scripts_without_spaces():
    assert [k for *_, k in S.runs("a " * 38 + "a.", S.SPAN, S.MIN_WORDS)] == []
    assert len(list(S.runs("a " * 39 + "a. b.", S.SPAN, S.MIN_WORDS))) == 1
    assert len(list(S.runs("一二三四五六七八九十" * 3 + "。" + "一二三四五六七八九十" * 3 + "。", S.SPAN, S.MIN_WORDS))) == 1
    assert list(S.runs("A short line of seven words here.\nAnother short line of seven words here.", S.SPAN, S.MIN_WORDS)) == []


def test_a_passage_inside_long_sentences_is_found_by_its_clauses(spark, docs_of):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    clause = lambda n: " ".join(word() for _ in range(n))
    shared = ", ".join(clause(9) for _ in range(7))
    rows = [(d, f"{clause(12)}, {shared}, {clause(15)}.") for d in (1, 2)]
    out = {r["doc_id"]: r["text"] for r in S.deduplicated(docs_of(rows)).collect()}
    assert out[1] == rows[0][1] and shared not in out[2] and len(out[2].split()) == 12 + 15
    assert [x[3] for x in S.sentences("a, b: c. " + "d " * 19 + "e, f")] == [3, 20, 1]
