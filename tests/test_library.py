import json
import random
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from xml.etree import ElementTree

import pytest
from pyspark import cloudpickle

from storyloom import library as L
from storyloom.functions import charts
from storyloom.jobs import JobQueue, work_off
from storyloom.operators import passes as P
from storyloom.sources import adapters
from storyloom.sources import store as store_module
from storyloom.sources.store import Conflict, Held, Lease, TableStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests

STORY = "第一章 渡口\n　　沈舟推开门。\n　　“船呢？”沈舟问。\n第二章 夜行\n　　“走。”顾远说。沈舟没有动，顾远看着他。\n"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("library")
    (at / "in").mkdir()
    (at / "in" / "断桥记(无名).txt").write_text(STORY, encoding="utf-8")
    s = TableStore(spark, f"file://{at}/db")
    s.folder = at / "in"
    return s


def test_the_whole_way(store):
    assert {r["how"] for r in L.import_books(store, str(store.folder)).collect()} == {"added"}
    book = L.list_books(store).first()
    assert (book["title"], book["author"], book["editions"], book["chapters"]) == ("断桥记", "无名", 1, 2)
    own = book["book_id"]
    assert L.parse_book(store, own, P.attributor("heuristic")) == {"succeeded": 2}
    assert L.parse_book(store, own, P.attributor("heuristic")) == {}
    listed = L.chapter_list(store, own).collect()
    assert [(r["title"], r["status"]) for r in listed] == [("渡口", "succeeded"), ("夜行", "succeeded")]
    rows = L.reader(store, listed[0]["chapter_id"]).collect()
    assert "".join(r["text"] for r in rows) == "沈舟推开门。\n“船呢？”沈舟问。"
    assert [(r["kind"], r["speaker"]) for r in rows] == [("narration", None), ("dialogue", "沈舟"), ("narration", None)]
    tasks = L.voice_tasks(store, listed[0]["chapter_id"], {"沈舟": "v1"}, "n1", "u1").collect()
    assert [t["voice"] for t in tasks] == ["n1", "v1", "n1"]
    assert L.index_chapters(store, adapters.HashEmbedder()) == 2 and L.index_chapters(store, adapters.HashEmbedder()) == 0
    assert L.search(store, "船呢", adapters.HashEmbedder(), [own], 1).first()["index"] == 0
    assert L.search(store, "船呢", adapters.HashEmbedder(), []).count() == 0
    page = L.report_html(store, own)
    assert page.count("<svg") == 2 and ElementTree.fromstring(page[page.index("<svg") : page.index("</svg>") + 6]).tag.endswith("svg")
    assert "断桥记" in page and "沈舟" in page and page.count("<tr>") == 8
    assert [(r["status"], r["runs"]) for r in L.usage(store).collect()] == [("succeeded", 2)]

    ids = {r["index"]: r["chapter_id"] for r in listed}
    (store.folder / "断桥记(无名).txt").write_text(STORY.replace("没有动", "没有走") + "第三章 远灯\n　　灯灭。\n", encoding="utf-8")
    assert sorted(r["how"] for r in L.import_books(store, str(store.folder)).collect()) == ["added", "edited", "kept"]
    again = {r["index"]: r["chapter_id"] for r in L.chapter_list(store, own).collect()}
    assert again[0] == ids[0] and again[1] == ids[1] and len(again) == 3


class Failing(P.RuleAttributor):
    name = "failing"

    def attribute(self, text, known):
        if "“" in text and "走" in text:
            raise RuntimeError("no answer")
        return super().attribute(text, known)


def test_failures_and_leases(store):
    if not store.exists("books"):
        L.import_books(store, str(store.folder))
    own = L.list_books(store).first()["book_id"]
    for _ in range(3):
        counts = L.parse_book(store, own, Failing(), stop_at_failure=True)
        assert counts.pop("failed") == 1
    assert L.parse_book(store, own, Failing()).get("failed") is None
    other = Lease(store, own, "somebody")
    assert other.acquire()
    with pytest.raises(Conflict):
        L.parse_book(store, own, Failing())
    other.release()


def test_chat_attributor():
    answer = json.dumps({"attributions": [{"id": "q0", "kind": "thought", "speaker": "沈舟", "confidence": 7, "emotion": "calm"}, {"id": "q9"}]})
    rows, warnings = P.ChatAttributor(adapters.ScriptedModel(["oops", answer])).attribute("“走。”“等等。”", [])
    assert [(r["kind"], r["speaker"], r["confidence"], r["emotion"]) for r in rows] == [("thought", "沈舟", 1.0, "calm"), ("dialogue", "[unknown]", 0.0, None)]
    assert warnings == ["unknown quote q9", "no answer for q1"]
    assert P.entity_type(" 宗门 ") == "organization" and P.entity_type("Person") == "character" and P.entity_type("x") is None
    with pytest.raises(ValueError):
        P.attributor("chat")


def test_proposals_and_judging(spark):
    found = P.proposals({"states": [{"subject": "a", "field": "f", "value": "v", "quote": "q", "confidence": 0.5}], "events": [{"value": "e", "quote": "q"}]})
    assert [(f["kind"], f["confidence"]) for f in found] == [("state", 0.5), ("event", 1.0)]
    for bad in ([], {"other": []}, {"states": [{"quote": ""}]}):
        with pytest.raises(ValueError):
            P.proposals(bad)

    class J:
        model = "j"

        def choose(self, question, choices):
            if "break" in question:
                raise RuntimeError("down")
            return "supports" if "yes" in question else "what"

    rows = [("c", i, "break" if i == 9 else "yes" if i % 2 else "no", "ctx") for i in range(12)]
    got = {r["seq"]: (r["choice"], r["error"]) for r in P.judged(spark.createDataFrame(rows, "chapter_id string, seq long, claim string, context string"), J(), "ok?", ["supports", "insufficient"]).collect()}
    first = spark.createDataFrame(rows, "chapter_id string, seq long, claim string, context string")
    later = spark.createDataFrame([("c", i, x if i else "yes, changed", "ctx") for _, i, x, _ in rows[:11]], first.schema)
    assert sorted(r["seq"] for r in P.still_judged(P.judged(first, J(), "ok?", ["supports", "insufficient"]), later).collect()) == list(range(1, 11))
    assert got[1] == ("supports", None) and got[0] == ("uncertain", None) and got[8] == (None, "down") and len(got) == 12


def test_revisions():
    first = {"book": "b", "facts": ["a", "b", "c", "d"]}
    second, r1 = P.revise(first, P.digest(first), [{"index": 1, "fact": None}, {"index": 3, "fact": "D"}])
    third, r2 = P.revise(second, P.digest(second), [{"index": 0, "fact": None}])
    assert second["facts"] == ["a", "c", "D"] and third["facts"] == ["c", "D"]
    assert P.chain_holds(third, [r1, r2]) and not P.chain_holds(third, [r2, r1]) and P.chain_holds(first, [])
    assert P.reversed_revision(P.reversed_revision(third, r2), r1) == first
    with pytest.raises(P.Stale):
        P.revise(third, P.digest(first), [])
    with pytest.raises(ValueError):
        P.revise(first, P.digest(first), [{"index": 9, "fact": None}])


def test_editions_of_a_book_do_not_mix(spark, tmp_path):
    """Two files of one title and author are two editions; importing one again leaves the other alone."""
    s = TableStore(spark, f"file://{tmp_path}/db")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "断桥记(无名).txt").write_text(STORY, encoding="utf-8")
    (tmp_path / "in" / "断桥记（无名）[精校].txt").write_text(STORY.replace("渡口", "渡头"), encoding="utf-8")
    L.import_books(s, str(tmp_path / "in"))
    book = L.list_books(s).collect()
    assert [(b["title"], b["editions"], b["chapters"]) for b in book] == [("断桥记", 2, 4)]
    own = book[0]["book_id"]
    editions = {r["label"]: r["edition_id"] for r in L.list_editions(s, own).collect()}
    before = {k: [r["chapter_id"] for r in L.chapter_list(s, own, e).collect()] for k, e in editions.items()}
    (tmp_path / "in" / "断桥记（无名）[精校].txt").unlink()
    (tmp_path / "in" / "断桥记(无名).txt").write_text(STORY + "第三章 远灯\n　　灯灭。\n", encoding="utf-8")
    assert sorted(r["how"] for r in L.import_books(s, str(tmp_path / "in")).collect()) == ["added", "kept", "kept"]
    after = {k: [r["chapter_id"] for r in L.chapter_list(s, own, e).collect()] for k, e in editions.items()}
    assert after["断桥记（无名）[精校].txt"] == before["断桥记（无名）[精校].txt"] and len(after["断桥记(无名).txt"]) == 3
    assert L.chapters_by_state(s, own, "unparsed").count() == 5 and L.chapters_by_state(s, own, "parsed").count() == 0
    L.import_books(s, str(tmp_path / "in"), label="another")
    assert L.list_editions(s, own).count() == 3
    gone = L.delete(s, own)
    assert gone["editions"] == 3 and gone["chapters"] == 8 and L.list_books(s).count() == 0


def test_two_books_at_once_lose_nothing(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/db")
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"书{k}(无名).txt").write_text(STORY, encoding="utf-8")
    L.import_books(s, str(tmp_path / "in"))
    books = [r["book_id"] for r in L.list_books(s).collect()]
    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(lambda b: L.parse_book(s, b, P.attributor("heuristic"), at_once=1), books)) == [{"succeeded": 2}] * 3
    runs = s.read("runs").collect()
    assert len(runs) == 6 and {r["book_id"] for r in runs} == set(books)
    assert s.read("segments").select("chapter_id").distinct().count() == 6


def test_a_lost_lease_stops_before_the_next_wave(store):
    if not store.exists("books"):
        L.import_books(store, str(store.folder))
    own = L.list_books(store).first()["book_id"]
    waves = []

    def told(index):
        waves.append(index)
        lease = Lease(store, own, "thief", stale_s=-1.0)  # for whom every heartbeat is old
        assert lease.acquire()

    with pytest.raises(Conflict):
        L.parse_book(store, own, P.attributor("heuristic"), force=True, at_once=1, told=told)
    assert len(waves) == 1 and Lease(store, own, "thief").release()


def test_of_many_takers_one_gets_a_stale_lease(store):
    now = [0.0]
    Lease(store, "stale", "old", clock=lambda: now[0]).acquire()
    now[0] = 100.0
    with ThreadPoolExecutor(8) as pool:
        for _ in range(3):
            got = list(pool.map(lambda k: Lease(store, "stale", f"w{now[0]}-{k}", clock=lambda: now[0]).acquire(), range(8)))
            assert got.count(True) == 1
            now[0] += 100
    held = Held(Lease(store, "beats", "me"), "beats", beat_s=0.05)
    with held:
        first = held.lease.holder()["heartbeat"]
        time.sleep(0.5)
        assert held.lease.holder()["heartbeat"] > first
        held.check()
    assert held.lease.holder() is None


def test_appends_add_folders_and_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_PARTS", 3)
    s = TableStore(spark, f"file://{tmp_path}/db")
    rows = lambda n: spark.createDataFrame([(n,)], "n int")
    folders = []
    for n in range(7):
        s.append("log", rows(n))
        folders.append(len(json.loads(s._notes("log").latest()[1])["parts"]))
    assert folders == [1, 2, 3, 1, 2, 3, 1] and sorted(r["n"] for r in s.read("log").collect()) == list(range(7))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: s.append("log", rows(n)), range(10, 18)))
    assert s.read("log").count() == 15
    assert s.tidy("log") == 0 and s.tidy("log", older_s=0) > 0 and s.read("log").count() == 15


def test_parts_hide_earlier_rows(spark, tmp_path, monkeypatch):
    """Changes by different keys, in any order and however often the parts become one, against a plain list."""
    rng = random.Random(5)
    kind = "book string, n int, v int"
    for most in (2, 100):
        monkeypatch.setattr(store_module, "MOST_HIDING", most)
        s, want = TableStore(spark, f"file://{tmp_path}/db{most}"), []
        for step in range(14):
            rows = [(rng.choice("abc"), n, step) for n in rng.sample(range(6), 3)]
            df, what = spark.createDataFrame(rows, kind), rng.randrange(4) if step else 0
            if what == 0:
                s.append("t", df)
                want += rows
            elif what == 1:
                s.upsert("t", df, ["book", "n"])
                want = [w for w in want if w[:2] not in {r[:2] for r in rows}] + rows
            elif what == 2:
                s.replace_scope("t", df, ["book"])
                want = [w for w in want if w[0] not in {r[0] for r in rows}] + rows
            else:
                n = s.delete("t", df, ["n"])
                kept = [w for w in want if w[1] not in {r[1] for r in rows}]
                assert n == len(want) - len(kept)
                want = kept
            assert sorted(map(tuple, s.read("t").collect())) == sorted(want), (step, what)
        assert s.read("t").columns == ["book", "n", "v"]
        with pytest.raises(ValueError):
            s.append("t", spark.createDataFrame([(1,)], "other int"))


def test_jobs(store):
    q = JobQueue(store, "test")
    a, b, c = (q.enqueue(x) for x in ("one", "two", "three"))
    assert [(r["job"], r["place"]) for r in q.states().collect()] == [(c, 3), (b, 2), (a, 1)] and q.is_busy()
    assert q.cancel(b) and not q.cancel(b) and not q.cancel("none")
    done = []

    def work(book, start, told):
        done.append((book, start))
        told(start + 4)

    assert q.run_next(work) == "succeeded" and done == [("one", 0)] and q.get(a)["progress"] == 1
    taken = q.take()
    assert taken["job"] == c and q.take() is None and q.get(c)["status"] == "running"
    q._put(c, "progress", chapter=7)
    assert q.sweep(0) == 1 and q.get(c)["status"] == "waiting"

    def held(book, start, told):
        raise Conflict(book)

    assert q.run_next(held) == "waiting"
    assert q.run_next(work) == "succeeded" and done[-1] == ("three", 8)
    d = q.enqueue("four")

    def cancelled(book, start, told):
        assert q.cancel(d)
        told(1)

    assert q.run_next(cancelled) == "cancelled" and q.get(d)["status"] == "cancelled"
    e = q.enqueue("five")
    assert q.run_next(lambda *_: 1 / 0) == "failed" and "zero" in q.get(e)["note"] and q.run_next(work) is None
    assert q.prune(2) == 3 and q.states().count() == 2 and not q.is_busy()


def test_evaluation_of_a_book(spark, store):
    if not store.exists("books"):
        L.import_books(store, str(store.folder))
    own = L.list_books(store).first()["book_id"]
    L.parse_book(store, own, P.attributor("heuristic"), force=True)
    rows = [(1, "船呢", "沈舟", [], None), (1, "没有", "x", [], None), (2, "走。", "顾", ["顾远"], None), (9, "x", "y", [], None)]
    got = {r["chapter"]: r.asDict() for r in L.evaluate(store, own, spark.createDataFrame(rows, "chapter int, quote string, speaker string, aliases array<string>, occurrence int")).collect()}
    assert (got[1]["correct"], got[1]["not_placed"], got[2]["correct"], got[9]["not_parsed"]) == (1, 1, 1, 1)
    assert L.gold_draft(store, own).count() == 2 and [r[0] for r in L.unsearchable(store, adapters.HashEmbedder(), ["none"]).collect()] == ["none"]


class Teller:
    """A model that answers by what the chapter says."""

    model = "teller"

    def complete(self, system, user):
        asked = json.loads(user.split("\n\nThe last")[0])
        if "灯灭" in asked["chapter"]:
            raise RuntimeError("no answer")
        known = [f["value"] for f in asked["known"]]
        quote = "沈舟推开门" if "推开门" in asked["chapter"] else "沈舟没有动" if "没有动" in asked["chapter"] else "沈舟没有走"
        return json.dumps({"states": [{"subject": "沈舟", "field": "place", "value": f"after {known}", "quote": quote, "confidence": 0.9}, {"subject": "沈舟", "field": "mood", "value": "x", "quote": "nowhere", "confidence": 0.9}]}, ensure_ascii=False)


def test_consistency_pass_memory_and_sync(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/db")
    (tmp_path / "in").mkdir()
    at = tmp_path / "in" / "断桥记(无名).txt"
    at.write_text(STORY + "第三章 远灯\n　　灯灭。\n第四章 天明\n　　沈舟推开门。\n", encoding="utf-8")
    L.import_books(s, str(tmp_path / "in"))
    own = L.list_books(s).first()["book_id"]
    L.parse_book(s, own, P.attributor("heuristic"))
    assert L.check_consistency(s, own, Teller()) == {"succeeded": 2, "failed": 1}
    states = s.read("states").orderBy("chapter").collect()
    assert [(r["chapter"], r["value"], r["valid_to"], r["quote"]) for r in states] == [(0, "after []", 1, "沈舟推开门"), (1, "after ['after []']", None, "沈舟没有动")]
    items = {tuple(r) for r in s.read("memory").collect()}
    assert len(items) == 2 and L.rebuild_memory(s, own) == 2 and {tuple(r) for r in s.read("memory").collect()} == items
    assert L.check_consistency(s, own, Teller()) == {"succeeded": 2, "failed": 1} and s.read("states").count() == 2

    base, calls = adapters.MemoryKnowledgeBase(), iter([False, False, True])
    assert L.sync_knowledge(s, own, base, lambda: next(calls)) == 2 and len(base.rows) == 2
    assert [r["needs_sync"] for r in L.knowledge_status(s, own).collect()] == [False, False, True, True]
    assert L.sync_knowledge(s, own, base) == 2 and L.sync_knowledge(s, own, base) == 0 and len(base.rows) == 4
    at.write_text(STORY.replace("没有动", "没有走"), encoding="utf-8")
    L.import_books(s, str(tmp_path / "in"))
    assert L.sync_knowledge(s, own, base) == 3 and len(base.rows) == 2 and any("没有走" in r["content"] for r in base.rows.values())


def test_charts():
    assert charts.ticks(0) == [0.0] and charts.ticks(9) == [0, 2, 4, 6, 8, 10] and charts.ticks(1.0)[-1] == 1.0
    for theme in charts.THEMES:
        svg = ElementTree.fromstring(charts.stacked_bars(["a", "<b>"], {"x": [1, 0], "y": [3, 0]}, share=True, theme=theme))
        bars = [float(r.get("height")) for r in svg.iter("{http://www.w3.org/2000/svg}rect")][:4]
        assert bars[1] == pytest.approx(3 * bars[0], abs=0.2) and bars[2:] == [0, 0]
        heat = ElementTree.fromstring(charts.heat_matrix(["r"], ["c", "d"], [[0, 7]], theme=theme))
        assert [r.get("fill-opacity") for r in heat.iter("{http://www.w3.org/2000/svg}rect")] == ["0.04", "1.00"]
    ElementTree.fromstring(charts.stacked_bars([], {}))


def test_commands(spark, store, tmp_path, capsys):
    from storyloom import __main__ as shell

    if not store.exists("books"):
        L.import_books(store, str(store.folder))
    own = shell.run(spark, store, "books", []).first()["book_id"]
    assert shell.run(spark, store, "chapters", [own]).count() >= 2 and shell.run(spark, store, "parse", [own]).get("failed") is None
    (tmp_path / "gold.jsonl").write_text('{"chapter": 1, "quote": "船呢", "speaker": "沈舟"}\n', encoding="utf-8")
    assert shell.run(spark, store, "eval", [own, f"file://{tmp_path}/gold.jsonl"]).first()["correct"] == 1
    shell.main(["--store", store.root, "editions", own])
    assert "断桥记" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        shell.main(["--store", store.root, "nothing"])


def test_a_pool_works_a_queue_off(store):
    q = JobQueue(store, "pool")
    jobs = [q.enqueue(f"book{k}") for k in range(5)]
    done = []

    def work(book, start, told):
        if book == "book3":
            raise ValueError("no")
        if book == "book1" and done.count(book) == 0:
            done.append(book)
            raise Conflict(book)
        done.append(book)

    assert work_off(store, work, "pool", parallel=2, busy_s=0.01) == {"succeeded": 4, "failed": 1}
    assert sorted(done) == ["book0", "book1", "book1", "book2", "book4"] and q.get(jobs[3])["status"] == "failed" and not q.is_busy()


def chapters_text(order, edited=()):
    return "".join(f"第{n}章 题{c}\n　　这是{c}的正文{'，改过' if c in edited else ''}。\n" for n, c in zip("一二三四五六七八九", order, strict=False))


def test_an_import_writes_what_changed_and_names_what_moved(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/db")
    (tmp_path / "in").mkdir()
    at = tmp_path / "in" / "集(某).txt"
    parts = lambda name: sum(n.startswith("part-") for n in s.files.names(f"{s.root}/{name}"))
    told = lambda: sorted((r["how"], r["moved"]) for r in L.import_books(s, str(tmp_path / "in")).collect())

    at.write_text(chapters_text("ABCDEF"), encoding="utf-8")
    assert told() == [("added", False)] * 6
    before = {n: parts(n) for n in ("chapters", "books", "editions", "imports")}
    ids = {r["title"]: r["chapter_id"] for r in L.chapter_list(s, L.list_books(s).first()["book_id"]).collect()}
    assert told() == [("kept", False)] * 6
    assert {n: parts(n) for n in before} == before  # nothing is written

    at.write_text(chapters_text("ABFCDE"), encoding="utf-8")  # one chapter moves, three shift
    assert told() == [("kept", False)] * 5 + [("kept", True)]
    now = {r["title"]: (r["chapter_id"], r["index"]) for r in L.chapter_list(s, L.list_books(s).first()["book_id"]).collect()}
    assert {k: v[0] for k, v in now.items()} == ids and sorted(v[1] for v in now.values()) == list(range(6))
    log = s.read("imports").collect()
    assert len(log) == 7 and [r["moved"] for r in log if r["how"] == "kept"] == [True]

    at.write_text(chapters_text("ABFCE", edited="B"), encoding="utf-8")
    assert told() == [("edited", False)] + [("kept", False)] * 4 + [("removed", False)]
    texts = {r["title"]: r["text"] for r in s.read("chapters").collect()}
    assert sorted(texts) == [f"题{c}" for c in "ABCEF"] and "改过" in texts["题B"]


def test_a_parse_keeps_entities_mentions_and_scenes(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/db")
    (tmp_path / "in").mkdir()
    text = "第一章 一\n　　“船呢？”沈舟问。顾远看着沈舟。\n第二章 二\n　　“走。”顾远说。顾远看着沈舟。沈舟没有动。\n第三章 三\n　　风停了。\n"
    (tmp_path / "in" / "渡(某).txt").write_text(text, encoding="utf-8")
    L.import_books(s, str(tmp_path / "in"))
    own = L.list_books(s).first()["book_id"]
    assert L.parse_book(s, own, P.attributor("heuristic"), at_once=2) == {"succeeded": 3}
    cast = {r["canonical_name"]: r for r in L.entities(s, own).collect()}
    assert {n: (r["dialogues"], r["mentions"]) for n, r in cast.items()} == {"沈舟": (1, 4), "顾远": (1, 3)}
    assert [r["canonical_name"] for r in L.entities(s, own, "character", "顾").collect()] == ["顾远"] and L.entities(s, own, "place").count() == 0
    texts = {r["chapter_id"]: (r["index"], r["text"]) for r in s.read("chapters").collect()}
    for r in s.read("mentions").collect():
        assert texts[r["chapter_id"]][1][r["char_start"] : r["char_end"]] == r["surface"]
    ids = {r["entity_id"]: n for n, r in cast.items()}
    scenes = {texts[r["chapter_id"]][0]: (r["char_end"], [ids[x] for x in r["character_ids"]]) for r in s.read("scenes").collect()}
    assert scenes == {i: (len(t), c) for (i, t), c in zip(sorted(texts.values()), [["沈舟", "顾远"], ["顾远", "沈舟"], []], strict=True)}
    newest = L.mentions_of(s, cast["沈舟"]["entity_id"]).collect()
    assert [r["chapter"] for r in newest] == [1, 1, 0, 0] and "没有动" in newest[0]["excerpt"]

    before = {n: s.read(n).count() for n in ("entities", "mentions", "scenes", "segments")}
    assert L.parse_book(s, own, P.attributor("heuristic"), force=True) == {"succeeded": 3}
    assert {n: s.read(n).count() for n in before} == before  # a second parse replaces
    gone = L.delete(s, own)
    assert (gone["entities"], gone["mentions"], gone["scenes"]) == (2, 7, 3) and s.read("entities").count() == 0
