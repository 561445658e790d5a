import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.functions.headings import heading_of_label, parse_heading, same_heading
from storyloom.functions.numerals import number_column, numeral_column, parse_number, write_number
from storyloom.operators import spans as S
from storyloom.operators.attribution import Entity, find_mentions, resolve, scenes_of, speech_clauses, structure
from storyloom.operators.quotes import paragraph_spans, quotes, quotes_of

NUMBERS = {"12": 12, "０７": 7, "十": 10, "十五": 15, "二十": 20, "一百零八": 108, "三百二十五": 325, "一〇八": 108, "二零二四": 2024, "两千": 2000, "一万二千": 12000, "百": 0, "": None, "甲": None, "三x": None}


@pytest.mark.parametrize("text,value", NUMBERS.items())
def test_numbers(text, value):
    assert parse_number(text) == value


def test_number_column(spark):
    rows = [(t, v) for t, v in NUMBERS.items()] + [(write_number(n), n) for n in range(1, 3000, 37)]
    df = spark.createDataFrame(rows, "t string, v long").withColumn("got", number_column(F.col("t")))
    assert [(r["t"], r["v"], r["got"]) for r in df.where("not got <=> v").collect()] == []


def test_written_columns(spark):
    got = spark.range(-3, 10_050).select("id", numeral_column(F.col("id")).alias("t")).collect()
    assert [(r["id"], r["t"]) for r in got if r["t"] != write_number(r["id"])] == []


@given(st.integers(1, 9999))
def test_written_numbers_read_back(n):
    assert parse_number(write_number(n)) == n


HEADINGS = [
    ("第十二章 夜渡", False, ("chapter", 12, "夜渡")),
    ("第一章断剑", False, ("chapter", 1, "断剑")),
    ("第3回：归来", False, ("chapter", 3, "归来")),
    ("第二卷 北境", False, ("volume", 2, "北境")),
    ("第一章", False, ("chapter", 1, None)),
    ("第三章的内容真精彩", False, None),
    ("第五章他走了，没有回头", False, None),
    ("第六章 他走了。", False, None),
    ("楔子", False, ("prologue", None, None)),
    ("楔子 雨夜", False, ("prologue", None, "雨夜")),
    ("番外一：旧事", False, ("extra", None, "旧事")),
    ("序号为三", False, None),
    ("作者：某人", True, None),
    ("请一天假", True, ("note", None, "请一天假")),
    ("请一天假", False, None),
    ("他说今天不更新了。", True, None),
    ("第" + "一" * 45 + "章", False, None),
]


@pytest.mark.parametrize("line,out,want", HEADINGS)
def test_headings(line, out, want):
    got = parse_heading(line, out)
    assert (None if got is None else (got.kind, got.number, got.title)) == want


def test_labels():
    assert heading_of_label("版权信息", False).kind == "front_matter"
    assert heading_of_label("Contents", False).kind == "front_matter"
    assert (heading_of_label("北境", True).kind, heading_of_label("北境", False).kind) == ("volume", "chapter")
    h = heading_of_label("001 初雪", False)
    assert (h.number, h.title) == (1, "初雪")
    assert same_heading("第三章 夜谈", heading_of_label("夜谈", False)) and same_heading("第三章夜谈", heading_of_label("第三章 夜谈", False))
    assert not same_heading("别的话", heading_of_label("夜谈", False))


TEXTS = st.text(alphabet="ab\n“”\"「」说道：，。é😀 ", max_size=60)


@settings(max_examples=200)
@given(TEXTS)
def test_segments_tile_every_text(text):
    found = structure("b", text, [Entity("e1", "character", "ab")], None)
    at = 0
    for i, s in enumerate(found.segments):
        assert s["index"] == i and s["char_start"] == at < s["char_end"]
        at = s["char_end"]
    assert at == len(text) if text else not found.segments
    assert all(text[a:b] == n for _, n, a, b in found.mentions)
    assert all(x[3] <= y[2] for x, y in zip(found.mentions, found.mentions[1:], strict=False))


def test_quotes():
    inner = lambda t, **k: [q.inner for q in quotes_of(t, paragraph_spans(t), **k)]
    assert inner("他说：“走吧。”她不动。「好」") == ["走吧。", "好"]
    assert inner("“没有关上\n下一段“也没有") == ["没有关上", "也没有"]
    assert inner("“”“ ”") == []
    assert inner("他是所谓“外乡人”的身份。") == [] and inner("他是所谓“外乡人”的身份。", terms=True) == ["外乡人"]
    assert inner("他说“外乡人”的身份？") == [] and inner("他：“外乡人”的身份") == ["外乡人"]
    assert inner('plain "one" and "two') == ["one", "two"]


def test_quotes_of_a_table(spark):
    df = spark.createDataFrame([(1, "“甲”\n“乙"), (2, None), (3, "")], "id long, text string")
    assert [(r["id"], r["paragraph"], r["char_start"], r["char_end"], r["inner"]) for r in quotes(df, "id").orderBy("id", "index").collect()] == [(1, 0, 0, 3, "甲"), (1, 1, 4, 6, "乙")]


def speakers(text, known=()):
    found = structure("b", text, [Entity(f"e_{n}", "character", n) for n in known])
    return [(s["surface"], s["confidence"]) for s in found.segments if s["kind"] != "narration"]


def test_speakers():
    assert speakers("白术说道：“天黑了。”", ["白术"]) == [("白术", 0.7)]
    assert speakers("“天黑了。”白术说。", ["白术"]) == [("白术", 0.7)]
    assert speakers("白术：“天黑了。”") == [("白术", 0.6)]
    assert speakers("“天黑了。”他说。") == [("他", 0.3)]
    assert speakers("“天黑了。”") == [("[unknown]", 0)]
    assert speakers("白术回答道。\n“天黑了。”", ["白术"]) == [("白术", 0.7)]
    assert speakers("白术也知道。\n“天黑了。”", ["白术"]) == [("[unknown]", 0)]
    assert speakers("看着转身的白术继续说道：“走。”", ["白术"]) == [("[unknown]", 0)]
    found = structure("b", "“走。”陆离问。\n陆离问：“去哪？”", [])
    assert [s["surface"] for s in found.segments if s["kind"] != "narration"] == ["陆离", "陆离"]
    assert [(e.canonical, e.is_new, e.confidence) for e in found.entities] == [("陆离", True, 0.5)]
    assert speech_clauses("白术定了定神，说道。") == ["说道", "白术定了定神"] and speech_clauses("没有人。") == []


def test_entities():
    known = [Entity("k1", "character", "白术", ["小白"])]
    met, ids = resolve("b", known, [("character", "小白", ["阿白"], 0.5), ("place", "白术", [], 0.9), ("character", "新人", [" 新人 ", "老新"], 0.4), ("character", "老新", [], 0.8)])
    assert [(e.canonical, e.type, e.aliases, e.is_new) for e in met] == [("白术", "character", ["阿白"], False), ("白术", "place", [], True), ("新人", "character", ["老新"], True)]
    assert ids["character", "阿白"] == "k1" and met[2].confidence == 0.8
    assert find_mentions("老白术和白术", [("a", ["白术"]), ("b", ["老白术"]), ("c", ["术"])]) == [("b", "老白术", 0, 3), ("a", "白术", 4, 6)]
    assert scenes_of([0, 2], [(0, 2), (3, 5), (6, 8)], 8) == [(0, 6), (6, 8)] and scenes_of([1], [(0, 2), (3, 5)], 5) == [(0, 5)]


def naive_occurrences(text, needle):
    out, at = [], text.find(needle) if needle else -1
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + len(needle))
    return out


def test_offsets_against_python(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("ab.\n é😀", k=rng.randrange(30))), "".join(rng.choices("ab.", k=rng.randrange(1, 3)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, n string")
    c, n = F.col("t"), F.col("n")
    got = df.select("t", "n", X.occurrences(c, n).alias("o"), X.unique_at(c, n).alias("u"), X.utf16_length(c).alias("w"), X.token_estimate(c).alias("k"), X.excerpt(c, F.lit(3), F.lit(5), 2).alias("e")).collect()
    for r in got:
        t, needle = r["t"], r["n"]
        assert r["o"] == naive_occurrences(t, needle)
        first = t.find(needle)
        assert r["u"] == (first if first >= 0 and t.find(needle, first + 1) < 0 else None)
        assert r["w"] == len(t.encode("utf-16-le")) // 2 and r["k"] == sum(1 if ord(x) < 128 else 2 for x in t) and r["e"] == t[1:7]


def test_gaps_and_segments(spark):
    rng = random.Random(2)
    texts, spoken = [], []
    for d in range(40):
        n, at = rng.randrange(1, 60), 0
        texts.append((d, n))
        while (at := at + rng.randrange(0, 15)) < n:
            end = min(n, at + rng.randrange(1, 8))
            spoken.append((d, at, end))
            at = end
    lengths = spark.createDataFrame(texts, "doc int, length int")
    spans = spark.createDataFrame(spoken, "doc int, char_start int, char_end int")
    scenes = lengths.selectExpr("doc", "explode(sequence(0, length - 1, 10)) as s_start", "length").selectExpr("doc", "s_start", "s_start as scene", "least(s_start + 10, length) as s_end")
    rows = S.segments(spans, scenes, lengths, ["doc"]).orderBy("doc", "index").collect()
    for d, n in texts:
        own = [r for r in rows if r["doc"] == d]
        assert [r["index"] for r in own] == list(range(len(own)))
        assert own[0]["char_start"] == 0 and own[-1]["char_end"] == n
        assert all(a["char_end"] == b["char_start"] for a, b in zip(own, own[1:], strict=False))
        assert sorted((r["char_start"], r["char_end"]) for r in own if r["kind"] == "dialogue") == sorted((a, b) for x, a, b in spoken if x == d)


def test_trim_and_collapse(spark):
    df = spark.createDataFrame([("　 a b　\xa0", "Hello\n World 你\n 好  x"), ("", "a \n 你")], "a string, b string")
    assert [tuple(r) for r in df.select(X.trimmed(F.col("a")), X.collapse_whitespace(F.col("b"))).collect()] == [("a b", "Hello World 你好 x"), ("", "a你")]


def test_greedy_longest(spark):
    rows = [(1, 0, 3, "x"), (1, 0, 5, "y"), (1, 4, 6, "z"), (1, 5, 7, "w"), (2, 1, 2, "q")]
    found = S.greedy_longest(spark.createDataFrame(rows, "d int, char_start int, char_end int, n string"), ["d"]).collect()
    assert sorted((r["d"], r["n"]) for r in found) == [(1, "w"), (1, "y"), (2, "q")]


def test_formats(spark):
    r = spark.range(1).select(X.compact(F.lit(1234)), X.compact(F.lit(2_500_000)), X.compact(F.lit(12)), X.percent(F.lit(0.256)), X.escape_html(F.lit("<a & 'b'>")), X.truncated(F.lit("abcdef"), 4), X.display_width(F.lit("a你"))).first()
    assert tuple(r) == ("1.2K", "2.5M", "12", "25.6%", "&lt;a &amp; &#39;b&#39;&gt;", "abc…", 3)


def test_quote_places_both_ways(spark, monkeypatch):
    """Few quotes by an automaton, many by a join: the same places, whole quotes, overlaps counted."""
    rng = random.Random(4)
    word = lambda: rng.choice(["aa", "b", "aab", "c.", "é😀"])
    docs = [(d, " ".join(word() for _ in range(rng.randrange(40)))) for d in range(60)] + [(99, None), (98, "aaa aaa")]
    quotes = [(i, " ".join(word() for _ in range(rng.randrange(1, 7)))) for i in range(80)] + [(900, "aaa"), (901, ""), (902, "aa aa"), (903, "aa aa")]
    want = sorted((i, d, t.find(q)) for i, q in quotes for d, t in docs if q and t and t.find(q) >= 0 and t.find(q, t.find(q) + 1) < 0)
    asked, texts = spark.createDataFrame(quotes, "i long, quote string"), spark.createDataFrame(docs, "d long, text string")
    for most in (S.QUOTE_BYTES, 400):
        monkeypatch.setattr(S, "QUOTE_BYTES", most)
        assert sorted(map(tuple, S.quote_places(asked, texts, "i", "d").collect())) == want
    assert S.quote_places(asked.limit(0), texts, "i", "d").count() == 0


def test_matches_cover_and_lines(spark):
    texts = ['say "a" and "" then "b c"\n"open', "", '""', "plain\n\nlines\n", "é😀\nx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    import re

    for r in df.select("t", X.matches(F.col("t"), '"[^"\\n]*"').alias("m"), S.cover(X.matches(F.col("t"), '"[^"\\n]*"'), F.length("t")).alias("c")).collect():
        spans = [m.span() for m in re.finditer('"[^"\\n]*"', r["t"])]
        assert [(x["char_start"], x["char_end"]) for x in r["m"]] == spans
        at = 0
        for x in r["c"]:
            assert x["char_start"] == at < x["char_end"] and (x["kind"] == "dialogue") == ((at, x["char_end"]) in spans)
            at = x["char_end"]
        assert at == len(r["t"])
    for at in range(-1, 9):
        for r in df.select("t", X.line_at(F.col("t"), F.lit(at)).alias("l")).collect():
            t = r["t"]
            want = (t.rfind("\n", 0, at) + 1, min(x for x in (t.find("\n", at), len(t)) if x >= 0)) if 0 <= at < len(t) else None
            assert (None if r["l"] is None else tuple(r["l"])) == want, (t, at)


def test_fitted_streams_a_key(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randrange(1, 60), str(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i int, c int, x string")
    want = []
    for key in "ab":
        used = 0
        for k, i, c, x in rows:
            if k == key and used + c <= 500:
                used += c
                want.append((k, i, c, x))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(tuple, S.fitted(df, ["k"], ["i"], "c", 500).collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
