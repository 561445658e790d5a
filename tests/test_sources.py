import io
import json
import zipfile

import pytest


from storyloom.operators import attribution as A
from storyloom.operators import facts as K
from storyloom.operators import maintenance as M
from storyloom.operators import validate as V
from storyloom.sources import adapters, chapters, config, epub, gold, html, lines, store, synthetic

STORY = """断桥记
作者：无名

　　一段开场白。
楔子
　　“雪要停了。”她说。
第一卷 北境
　　卷首的话。
第一章 渡口
　　沈舟推开门，问：“船呢？”
　　第一章 渡口
　　“没有船。”沈舟听见有人说。
第二章 夜行
　　他没有回头😀。
第三章 空章
第四章　远灯
　　灯灭了。
"""


def test_decode():
    gb = STORY.encode("gb18030")
    assert lines.decode_novel(gb) == (STORY, "gb18030", 0)
    assert lines.decode_novel(b"\xef\xbb\xbf" + STORY.encode()) == (STORY, "utf-8", 0)
    assert lines.decode_novel(b"\xff\xfe" + STORY.encode("utf-16le"))[:2] == (STORY, "utf-16le")
    assert lines.decode_novel(b"\xfe\xff" + STORY.encode("utf-16be"))[:2] == (STORY, "utf-16be")
    text, name, n = lines.decode_novel(("好" * 1000).encode() + b"\xff")
    assert (name, n, len(text)) == ("utf-8", 1, 1001)
    assert lines.decode_novel(b"")[0] == ""


@pytest.mark.parametrize("name,want", [("断桥记(无名).txt", ("断桥记", "无名")), ("断桥记【完结】.epub", ("断桥记", None)), ("断桥记（无名）[精校].txt", ("断桥记", "无名")), ("断桥记 作者：无名.txt", ("断桥记", "无名")), ("a/b/断桥记.txt", ("断桥记", None)), ("(无名).txt", ("(无名)", None))])
def test_file_names(name, want):
    assert lines.title_and_author(name) == want


def test_text_to_chapters(spark, tmp_path):
    (tmp_path / "断桥记.txt").write_bytes(STORY.encode("gb18030"))
    (tmp_path / "book.epub").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "other.md").write_text("no")
    files = lines.read_files(spark, str(tmp_path))
    assert sorted(r["is_zip"] for r in files.select("is_zip").collect()) == [False, True]
    numbered = lines.lines(lines.decoded(files).select("path", "text"))
    rows = sorted(chapters.chapters(numbered, lines.layouts(numbered)).collect(), key=lambda r: r["index"])
    assert sorted(chapters.of_texts(lines.decoded(files)).collect(), key=lambda r: r["index"]) == rows
    assert [(r["kind"], r["number"], r["title"], r["volume_index"]) for r in rows] == [
        ("front_matter", None, "前言", None),
        ("prologue", None, None, None),
        ("front_matter", None, "卷首语", 0),
        ("chapter", 1, "渡口", 0),
        ("chapter", 2, "夜行", 0),
        ("chapter", 4, "远灯", 0),
    ]
    assert rows[3]["text"].split("\n")[1] == "第一章 渡口" and rows[3]["volume_title"] == "第一卷 北境"
    assert set(json.loads(rows[0]["warnings"])) == {"repeated:第一章 渡口:1", "empty:第三章 空章"}


def test_layout_lets_notes_in():
    body = [(f"第{i}段的正文。", True, []) for i in range(60)]
    walk = chapters.split_chapters([("第一章", False, []), *body[:30], ("请假一天", False, []), *body[30:]], True)
    assert [c["kind"] for c in walk.chapters] == ["chapter", "note"]
    assert [c["kind"] for c in chapters.split_chapters([("第一章", False, []), *body, ("请假一天", False, [])], False).chapters] == ["chapter"]


def page(body):
    return f"<html><head><title>x</title></head><body>{body}</body></html>"


def build_epub(files, opf):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", opf)
        for name, text in files.items():
            z.writestr(f"OEBPS/{name}", text)
    return out.getvalue()


ITEMS = '<item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="C2.xhtml" media-type="application/xhtml+xml"/>'
META = '<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>断桥记</dc:title><dc:creator> 无 名 </dc:creator></metadata>'
PAGES = {"c1.xhtml": page('<p>书影</p><h1 id="a">第一章 渡口</h1><p>雪落。<br/>船去。</p>'), "c2.xhtml": page('<h2>第二章 夜行</h2><p>灯<rt>deng</rt>灭\n了。</p>')}


def test_epub_with_nav(spark, tmp_path):
    nav = page('<nav epub:type="toc" xmlns:epub="http://www.idpf.org/2007/ops"><ol><li><span>上部</span><ol><li><a href="c1.xhtml#a">渡口</a></li><li><a href="c2.xhtml">第二章 夜行</a></li></ol></li></ol></nav>')
    opf = f'<package>{META}<manifest>{ITEMS}<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest><spine><itemref idref="n"/><itemref idref="c1"/><itemref idref="c2"/><itemref idref="gone"/></spine></package>'
    (tmp_path / "b.epub").write_bytes(build_epub(PAGES | {"nav.xhtml": nav}, opf))
    numbered = epub.lines(lines.read_files(spark, str(tmp_path)))
    assert numbered.first()["book_title"] == "断桥记" and numbered.first()["author"] == "无 名"
    rows = sorted(chapters.chapters(numbered, lines.layouts(numbered)).collect(), key=lambda r: r["index"])
    assert [(r["kind"], r["number"], r["title"], r["volume_title"], r["text"]) for r in rows] == [("front_matter", None, "前言", None, "书影"), ("chapter", 1, "渡口", "上部", "雪落。\n船去。"), ("chapter", 2, "夜行", "上部", "灯灭了。")]


def test_epub_with_ncx_and_broken_anchor():
    ncx = '<ncx><navMap><navPoint><navLabel><text>渡口</text></navLabel><content src="c1.xhtml#nowhere"/></navPoint><navPoint><navLabel><text>外页</text></navLabel><content src="x.xhtml"/></navPoint></navMap></ncx>'
    opf = f'<package>{META}<manifest>{ITEMS}<item id="t" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="t"><itemref idref="c1"/><itemref idref="c2" linear="no"/></spine></package>'
    _, found, warnings = epub.book_lines(build_epub(PAGES | {"t.ncx": ncx}, opf))
    assert found[0] == ("书影", [("渡口", False)]) and len(found) == 4
    assert warnings == ["outside the reading order: 外页", "put at the start: 渡口"]


def test_epub_without_contents():
    opf = f"<package>{META}<manifest>{ITEMS}</manifest><spine><itemref idref='c1'/><itemref idref='c2'/></spine></package>"
    _, found, warnings = epub.book_lines(build_epub(PAGES, opf))
    assert [x for x in found if x[1]] == [("第一章 渡口", [("第一章 渡口", False)]), ("第二章 夜行", [("第二章 夜行", False)])] and len(warnings) == 1
    with pytest.raises(ValueError):
        epub.book_lines(build_epub({}, "").replace(b"META-INF/container.xml", b"META-INF/container.xmm"))


def test_links():
    assert epub.resolve("OEBPS/text/a.xhtml", "../img/%E5%9B%BE.png#x") == ("OEBPS/img/图.png", "x")
    assert epub.resolve("OEBPS/a.xhtml", "#p") == ("OEBPS/a.xhtml", "p")


def test_blocks():
    found = html.text_blocks("<div id=x>Hello\n World <b>bold</b><p>two<br>three<script>no()</script></div><h3>四\n五</h3><a name=y></a><p>&amp;</p>tail")
    assert [(t, i, n) for t, i, n in found] == [("Hello World bold", ["x"], None), ("two", [], None), ("three", [], None), ("四五", [], 3), ("&", ["y"], None), ("tail", [], None)]


def test_gold(spark, tmp_path):
    at = tmp_path / "g.jsonl"
    at.write_text('# note\n\n{"chapter":1,"quote":"船呢","speaker":"沈舟"}\n{"chapter":1,"quote":"船","speaker":"沈舟","occurrence":2}\n{"chapter":1,"quote":"船","speaker":"x"}\n{"chapter":1,"quote":"没了","speaker":"x"}\n{"chapter":1,"quote":"船","speaker":"x","occurrence":9}\n')
    rows = gold.attribution_gold(spark, str(at))
    candidates = spark.createDataFrame([(1, 0, "船呢？", 5, 10), (1, 1, "没有船。", 20, 26)], "chapter int, index int, inner string, char_start int, char_end int")
    got = {(r["quote"], r["occurrence"]): (r["status"], r["char_start"]) for r in gold.located(rows, candidates).collect()}
    assert got == {("船呢", None): ("found", 5), ("船", 2): ("found", 20), ("船", None): ("ambiguous", 5), ("没了", None): ("missing", None), ("船", 9): ("out_of_range", None)}
    at.write_text('{"chapter":0,"quote":"a","speaker":"b"}')
    with pytest.raises(gold.InvalidGold):
        gold.attribution_gold(spark, str(at))
    at.write_text('{"kind":"evidence","chapter":1,"quote":"a","claim":"c","expected":"supports"}\n{"kind":"quote","chapter":1,"quote":"a","expected":"dialogue"}')
    assert gold.shadow_gold(spark, str(at)).count() == 2
    at.write_text('{"kind":"evidence","chapter":1,"quote":"a","expected":"supports"}')
    with pytest.raises(gold.InvalidGold):
        gold.shadow_gold(spark, str(at))


def test_store(spark, tmp_path):
    s = store.TableStore(spark, f"file://{tmp_path}/db")
    kind = "book_id string, n int"
    assert s.read("books", kind).count() == 0 and not s.exists("books")
    s.append("books", spark.createDataFrame([("a", 1), ("b", 2)], kind))
    old = s.read("books")
    s.upsert("books", spark.createDataFrame([("b", 3), ("c", 4)], kind), ["book_id"])
    s.insert_new("books", spark.createDataFrame([("c", 9), ("d", 5)], kind), ["book_id"])
    s.replace_scope("books", spark.createDataFrame([("a", 7), ("a", 8)], kind), ["book_id"])
    assert sorted(map(tuple, s.read("books").collect())) == [("a", 7), ("a", 8), ("b", 3), ("c", 4), ("d", 5)]
    assert sorted(map(tuple, old.collect())) == [("a", 1), ("b", 2)]
    s.publish("editions", spark.createDataFrame([("e1", "a"), ("e2", "b")], "edition_id string, book string"))
    s.publish("chapters", spark.createDataFrame([(i, "e1") for i in range(3)] + [(9, "e2")], "chapter int, edition string"))
    chain = [("editions", "book", "books", "book_id"), ("chapters", "edition", "editions", "edition_id")]
    assert store.delete_book(s, "a", chain) == {"chapters": 3, "editions": 1, "books": 2}
    assert s.read("chapters").count() == 1 and s.read("editions").first()["edition_id"] == "e2"
    store.Lease(s, "b", "worker").acquire()
    with pytest.raises(store.Conflict):
        store.delete_book(s, "b", chain)
    s.write_preview(f"file://{tmp_path}/p", s.read("books"))
    with pytest.raises(Exception, match="(?i)exist"):
        s.write_preview(f"file://{tmp_path}/p", s.read("books"))


def test_leases(spark, tmp_path):
    now = [100.0]
    s = store.TableStore(spark, f"file://{tmp_path}/db")
    a, b = (store.Lease(s, "book", o, 60, lambda: now[0]) for o in "ab")
    assert a.acquire() and a.acquire() and not b.acquire() and not b.renew() and not b.release()
    now[0] = 150
    assert a.renew()
    now[0] = 205
    assert not b.acquire()
    now[0] = 211
    assert b.acquire() and not a.renew() and not a.release() and b.release() and a.acquire()


def test_config():
    assert config.load({}) == config.Config()
    full = config.load({"CHAT_URL": "u", "CHAT_KEY": "k", "CHAT_MODEL": "m", "PRICE_INPUT": "0.5", "PRICE_OUTPUT": "1", "PARALLEL": "4"})
    assert full.chat == config.Service("u", "k", "m") and full.pricing.cost(2_000_000, 1_000_000) == 2 and full.parallel == 4
    for bad in ({"CHAT_URL": "u"}, {"PRICE_INPUT": "1"}, {"PARALLEL": "0"}, {"STALE_SECONDS": "x"}, {"KNOWLEDGE_KEY": "k"}):
        with pytest.raises(config.InvalidConfig):
            config.load(bad)


def test_adapters(spark):
    waits, calls = [], iter([adapters.Rejected(429, 3), adapters.Rejected(500), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert adapters.with_retries(call, sleep=waits.append) == "ok" and waits[0] == 3 and 2 <= waits[1] < 2.3
    with pytest.raises(adapters.Rejected):
        adapters.with_retries(lambda: (_ for _ in ()).throw(adapters.Rejected(400)), sleep=waits.append)
    assert adapters.streamed_text(['data: {"choices":[{"delta":{"content":"a"}}]}', ": ping", 'data: {"choices":[{"delta":{}}]}', 'data: {"choices":[{"delta":{"content":"b"}}]}', "data: [DONE]"]) == "ab"
    model = adapters.ScriptedModel(["no json", "```json\n{\"a\": 2}\n```", '{"a": 1}'])
    assert adapters.ask_json(model, "s", "u", lambda x: None if x["a"] == 1 else "a must be 1") == {"a": 1}
    with pytest.raises(ValueError):
        adapters.ask_json(adapters.ScriptedModel(lambda s, u: "{}"), "s", "u", lambda x: "bad")
    kb = adapters.MemoryKnowledgeBase()
    ids = [kb.create(f"t{i}", f"text {i}") for i in range(5)]
    assert len(kb.list(2, 3)) == 2 and kb.search("text 3", 2)[0]["title"] == "t3"
    kb.delete(ids[0])
    assert len(kb.list(1)) == 4
    rows = adapters.embedded(spark.createDataFrame([(i, f"scene {i}") for i in range(5)], "scene_id int, text string"), "scene_id", "text", adapters.HashEmbedder(8), 2).collect()
    assert len(rows) == 5 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in rows)


def test_structure_of_books_carries_entities(spark):
    novels = synthetic.novels(spark, 3, 4)
    files = synthetic.as_files(novels)
    numbered = lines.lines(files)
    split = chapters.chapters(numbered, lines.layouts(numbered))
    assert split.count() == 12 and {r["kind"] for r in split.collect()} == {"chapter"}
    rows = A.parse_books(novels).orderBy("book", "chapter").collect()
    for r in rows:
        entities, segments = json.loads(r["entities"]), json.loads(r["segments"])
        assert len(entities) == 2 and all(e["is_new"] == (r["chapter"] == 1) for e in entities)
        assert {s["confidence"] for s in segments if s["kind"] == "dialogue"} == {0.6 if r["chapter"] == 1 else 0.7}
        assert segments[0]["char_start"] == 0 and segments[-1]["char_end"] == r["char_count"]


def valid_parse(spark):
    text = "甲说：“走。”乙不动。"
    return {
        "chapters": ([("c", len(text), text)], "chapter_id string, char_count int, text string"),
        "scenes": ([("c", "s0", 0, 0, 6, ["e1"]), ("c", "s1", 1, 6, len(text), [])], "chapter_id string, id string, index int, char_start int, char_end int, character_ids array<string>"),
        "segments": ([("c", "g0", "s0", 0, "narration", 0, 3, None, None, None), ("c", "g1", "s0", 1, "dialogue", 3, 6, "e1", "甲", 0.7), ("c", "g2", "s1", 2, "dialogue", 6, 7, None, "?", 0.1), ("c", "g3", "s1", 3, "narration", 7, len(text), None, None, None)], "chapter_id string, id string, scene_id string, index int, kind string, char_start int, char_end int, entity_id string, surface string, confidence double"),
        "entities": ([("c", "e1", 0.9)], "chapter_id string, id string, confidence double"),
        "mentions": ([("c", 0, "e1", "甲", 0, 1)], "chapter_id string, index int, entity_id string, surface string, char_start int, char_end int"),
    }


MUTATIONS = [
    ("chapters", 0, 2, "甲说", {"IR-LENGTH"}),
    ("scenes", 1, 3, 7, {"IR-SCENE-PARTITION", "IR-SEG-SCENE"}),
    ("scenes", 1, 2, 2, {"IR-SCENE-PARTITION"}),
    ("scenes", 0, 5, ["e9"], {"IR-REF"}),
    ("segments", 3, 6, 9, {"IR-SEG-COVER"}),
    ("segments", 1, 1, "g0", {"IR-UNIQUE"}),
    ("segments", 2, 2, "s9", {"IR-REF"}),
    ("segments", 1, 7, "e9", {"IR-REF"}),
    ("segments", 1, 9, 1.5, {"IR-RANGE"}),
    ("segments", 2, 8, None, {"IR-DIALOGUE-SPEAKER"}),
    ("entities", 0, 2, float("nan"), {"IR-RANGE"}),
    ("mentions", 0, 3, "乙", {"IR-MENTION-EVIDENCE"}),
    ("mentions", 0, 5, 99, {"IR-MENTION-EVIDENCE"}),
    ("mentions", 0, 2, "e9", {"IR-REF"}),
]


@pytest.mark.parametrize("table,row,column,value,codes", [("chapters", 0, 0, "c", set()), *MUTATIONS])
def test_each_rule_of_a_parse(spark, table, row, column, value, codes):
    parts = valid_parse(spark)
    rows = [list(r) for r in parts[table][0]]
    rows[row][column] = value
    parts[table] = (rows, parts[table][1])
    found = V.chapter_errors(*[spark.createDataFrame(r, s) for r, s in parts.values()]).collect()
    assert {r["code"] for r in found} == codes


def proposal(i, kind="state", chapter=1, subject="e1", field="mood", obj=None, value="calm", confidence=0.9, a=0, b=2, quote="雪落"):
    return (f"f{i}", kind, "b", f"c{chapter}", chapter, subject, field, obj, value, confidence, a, b, quote, None)


def test_facts_and_memory(spark):
    texts = spark.createDataFrame([(f"c{i}", "雪落无声，雪停。") for i in range(1, 6)], "chapter_id string, text string")
    rows = [proposal(1), proposal(2, chapter=2), proposal(3, chapter=3, value="angry", confidence=0.59), proposal(4, "relation", 1, "e1", "knows", "e2", None, 0.6), proposal(5, "relation", 2, "e1", "knows", "e2", None), proposal(6, "thread", 2, field="seed", value="who left"), proposal(7, "event", 3, field="fight", value="they fight"), proposal(8, chapter=4, quote="没有"), proposal(9, chapter=5, confidence=2.0)]
    parts, errors = K.commit(spark.createDataFrame(rows, K.PROPOSALS), texts)
    assert sorted((r["fact_id"], r["code"]) for r in errors.collect()) == [("f8", "FACT-EVIDENCE"), ("f9", "FACT-CONFIDENCE")]
    assert [(r["fact_id"], r["valid_to"], r["superseded_by"]) for r in parts["states"].orderBy("chapter").collect()] == [("f1", 3, "f3"), ("f3", None, None)]
    assert [(r["fact_id"], r["valid_to"]) for r in parts["relations"].orderBy("chapter").collect()] == [("f4", 2), ("f5", None)]
    assert [tuple(r)[4:6] for r in parts["changes"].collect()] == [("calm", "angry")]
    assert [r["fact_id"] for r in parts["review"].collect()] == ["f3"]
    parts["threads"] = K.resolved_threads(parts["threads"], spark.createDataFrame([("f6", 4), ("f6", 5)], "fact_id string, resolved_at int"))
    items = K.memory(parts)
    assert items.count() == 6 and items.exceptAll(K.memory(parts)).count() == 0
    at = lambda n, who: [r["content"] for r in K.recalled(items, who, "b", n).collect()]
    assert at(2, ["e9", "e1", "e1"]) == ["mood: calm", "mood: calm"] and at(3, ["e1"]) == ["mood: angry"] and at(0, ["e1"]) == []
    assert [r["content"] for r in K.similar(items, ["ANGRY", "fight"], "b", 3, 5).collect()] and K.similar(items, ["seed", "who"], "b", 4, 5).count() == 0
    decided = K.reviewed(parts["review"], spark.createDataFrame([("f3", "approved", 1), ("f3", "rejected", 2)], "fact_id string, status string, seq int"))
    assert decided.first()["status"] == "approved"


def test_evidence_and_names(spark):
    texts = spark.createDataFrame([("c1", 1, "雪落无声，雪停了。", "h1"), ("c2", 5, "雪落无声", "h2")], "chapter_id string, chapter int, text string, content_hash string")
    hits = spark.createDataFrame([("x", "k1", "雪停了", 0.9), ("y", "k1", "雪", 0.8), ("z", "k2", "雪落", 0.7), ("w", "k1", "雪停了", 0.5)], "hit_id string, knowledge_id string, content string, score double")
    sources = spark.createDataFrame([("k1", "c1", "h1"), ("k2", "c2", "h2")], "knowledge_id string, chapter_id string, content_hash string")
    assert [(r["hit_id"], r["char_start"]) for r in K.evidence(hits, sources, texts, 5).collect()] == [("x", 5)]
    located = K.located(spark.createDataFrame([("f1", "c1", "雪停"), ("f2", "c1", "雪"), ("f3", "c1", "雨")], "fact_id string, chapter_id string, quote string"), texts)
    assert sorted((r["fact_id"], r["status"]) for r in located.collect()) == [("f1", "located"), ("f2", "not_unique"), ("f3", "missing")]
    chunks = spark.createDataFrame([("c1", "a", "雪落无声，"), ("c1", "b", "无声，雪停")], "chapter_id string, chunk_id string, content string")
    refs = spark.createDataFrame([("r1", "c1", 0, 2), ("r2", "c1", 2, 4)], "ref_id string, chapter_id string, char_start int, char_end int")
    assert [tuple(r) for r in K.linked_chunks(chunks, refs, texts).collect()] == [("r1", "a")]
    entities = spark.createDataFrame([("e1", "沈舟"), ("e2", "顾远")], "entity_id string, canonical_name string")
    aliases = spark.createDataFrame([("e1", "阿舟", 2, 5), ("e2", "阿舟", 4, None), ("e2", "远", None, None)], "entity_id string, alias string, valid_from int, valid_to int")
    names = lambda n: {r["name"]: r["entity_id"] for r in K.aliases_at(entities, aliases, n).collect()}
    assert names(1) == {"沈舟": "e1", "顾远": "e2", "远": "e2"} and names(3)["阿舟"] == "e1" and names(4)["阿舟"] is None and names(5)["阿舟"] == "e2"
    assert K.words_of_query("沈舟 去 渡口 Ferry 沈舟", ["沈舟"]) == ["沈舟", "去", "渡口", "ferry"]
    chain = spark.createDataFrame([("p", 1, "h1", None), ("p", 2, "h2", "h1"), ("p", 3, "h3", "h1")], "chain string, seq int, hash string, parent string")
    assert [r["seq"] for r in K.broken_chain(chain).collect()] == [3]
    part = lambda kind, *rows: spark.createDataFrame([(kind, r, c) for r, c in rows], "kind string, reference string, content string")
    fitted = K.context([part("state", ("r1", "x" * 40)), part("mention", ("r2", "y" * 4000), ("r1", "again")), part("clue", ("r3", "z"))], 300)
    assert sorted(r["reference"] for r in fitted.collect()) == ["r1", "r3"]
    with pytest.raises(ValueError):
        K.context([part("state", ("r", "x"))], 0)


def test_matching(spark):
    kind = "id long, k string, h string"
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "d", "q"), (5, "d", "r")], kind)
    new = spark.createDataFrame([(11, "z", "x"), (12, "b", "new"), (14, "d", "n1"), (15, "e", "n2")], kind)
    got = sorted((r["old_id"] or 0, r["new_id"] or 0, r["how"]) for r in M.matched(old, new, "id", "k", "h").collect())
    assert got == [(0, 14, "added"), (0, 15, "added"), (1, 11, "kept"), (2, 12, "edited"), (3, 0, "removed"), (4, 0, "removed"), (5, 0, "removed")]


def test_headings_take_references_with_their_semicolons_only():
    page = "<h1>a&amp</h1><h2>b&ampc;&amp;lt; & &#39;&lt;&#x41;</h2><h3><a href='?x=1&copy=2' id=n>c&copy</a></h3>"
    assert [(t, n) for t, _, n in html.text_blocks(page, strict=True)] == [("a&amp", 1), ("b&ampc;&lt; & '<A", 2), ("c&copy", 3)]
    assert [t for t, _, _ in html.text_blocks(page)] == ["a&", "b&c;&lt; & '<A", "c©"]
