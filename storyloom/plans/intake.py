"""Files, books, gold labels and models over the driver's tables: the inputs are made of their rows, and so is the SQL."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from storyloom.operators import consistency, passes
from storyloom.operators import facts as K
from storyloom.operators import history as H
from storyloom.operators import maintenance as M
from storyloom.plans.domain import _numeral
from storyloom.plans.registry import query
from storyloom.sources import adapters, chapters, epub, gold, lines, synthetic
from storyloom.streaming import runs as R

CODED = "case doc_id % 4 when 0 then 'utf-8' when 1 then 'utf-8' when 2 then 'utf-16le' else 'utf-16be' end"


@query(f"select doc_id::varchar as path, {CODED} as encoding, md5(text) as h from documents where text is not null")
def charset_decode(t):
    """Bytes to text: byte-order marks win, else UTF-8 (S-03)."""
    mark = lambda hexed, name: F.concat(F.unhex(F.lit(hexed)), F.encode("text", name))
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, mark("EFBBBF", "UTF-8")).when(k == 2, mark("FFFE", "UTF-16LE")).otherwise(mark("FEFF", "UTF-16BE"))
    files = t("documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), F.lit(False).alias("is_zip"))
    return lines.decoded(files).select("path", "encoding", F.md5("text").alias("h"))


@query("select doc_id, doc_id % 3 = 0 as is_zip from documents")
def container_sniff(t):
    """Containers by their first bytes, whatever they are called (S-02)."""
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("504B0304")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).otherwise(F.encode(F.concat(F.lit("PK "), F.coalesce("text", F.lit(""))), "UTF-8"))
    return t("documents").select("doc_id", lines.is_zip(content).alias("is_zip"))


PARTS = ["序言", "渡口", "夜行"]


def _epub(key: int, name: str, region: str) -> bytes:
    """An e-book of three pages: with a navigation document, with the older map, or with headings alone."""
    page = lambda body: f"<html><head><title>x</title></head><body>{body}</body></html>"
    pages = {f"text/p{i}.xhtml": page(f"<h{2 if i else 1} id='a{i}'>{x}</h{2 if i else 1}><p>{name} 一<br/>{region}</p>") for i, x in enumerate(PARTS)}
    items = "".join(f"<item id='p{i}' href='text/P{i}.xhtml' media-type='application/xhtml+xml'/>" for i in range(3))
    refs = "".join(f"<itemref idref='p{i}'/>" for i in range(3))
    more, toc = "", ""
    if key % 3 == 0:
        links = "".join(f"<li><a href='text/P{i}.xhtml#a{i}'>{x}</a></li>" for i, x in enumerate(PARTS))
        pages["nav.xhtml"] = page(f"<nav xmlns:epub='http://www.idpf.org/2007/ops' epub:type='toc'><ol>{links}</ol></nav>")
        more = "<item id='n' href='nav.xhtml' media-type='application/xhtml+xml' properties='nav'/>"
    elif key % 3 == 1:
        points = "".join(f"<navPoint><navLabel><text>{x}</text></navLabel><content src='text/P{i}.xhtml%23a{i}'/></navPoint>".replace("%23", "#") for i, x in enumerate(PARTS))
        pages["toc.ncx"] = f"<ncx><navMap>{points}</navMap></ncx>"
        more, toc = "<item id='t' href='toc.ncx' media-type='application/x-dtbncx+xml'/>", " toc='t'"
    opf = f"<package><metadata xmlns:dc='http://purl.org/dc/elements/1.1/'><dc:title>{name}</dc:title><dc:creator> {region} </dc:creator></metadata><manifest>{items}{more}</manifest><spine{toc}>{refs}</spine></package>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='OEBPS/content.opf'/></rootfiles></container>")
        z.writestr("OEBPS/content.opf", opf)
        for at, text in pages.items():
            z.writestr(f"OEBPS/{at}", text)
    return out.getvalue()


@query("""
with n as (select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey), p as (select unnest(range(3)) as page, unnest(['序言', '渡口', '夜行']) as heading),
     l as (select n_nationkey::varchar as path, n_name, r_name, page * 3 + line as line_no, case line when 0 then heading when 1 then n_name || ' 一' else r_name end as text, case when line = 0 then heading end as opens
           from n, p, (select unnest(range(3)) as line))
select path, line_no::int as line_no, text, opens, n_name as book_title, r_name as author from l
""")
def epub_books(t):
    """E-books to lines with the boundaries of their contents, by navigation document, older map or headings; titles and
    authors from the package (S-05, S-06, S-07, S-10, S-11)."""
    books = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")

    def write(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["n_nationkey"].astype(str), "content": [_epub(int(k), n, r) for k, n, r in b.itertuples(index=False)], "is_zip": True})

    files = books.mapInPandas(write, "path string, content binary, is_zip boolean")
    return epub.lines(files).select("path", "line_no", "text", F.try_element_at("boundaries", F.lit(1))["label"].alias("opens"), "book_title", "author")


@query("""
select s_suppkey::varchar as path, index::int as index, case index when 0 then 'front_matter' when 1 then 'prologue' else 'chapter' end as kind, case when index >= 2 then case when index = 3 then 4 else 1 end end::int as number,
       case index when 0 then '前言' when 2 then s_name when 3 then '远灯' end as title, case when index >= 2 then '第一卷 北境' end as volume_title
from supplier, (select unnest(range(4)) as index) where index <> 1 or s_suppkey % 2 = 0
""".replace("index::int as index", "(index - case when s_suppkey % 2 = 1 and index > 1 then 1 else 0 end)::int as index"))
def chapter_split(t):
    """Plain texts to chapters: front matter, volumes, a heading that repeats, an empty chapter that is dropped (T-07, S-26)."""
    body = F.concat(
        F.lit("断桥记\n　　一段开场白。\n"),
        F.when(F.col("s_suppkey") % 2 == 0, "楔子\n　　雪要停了。\n").otherwise(""),
        F.lit("第一卷 北境\n第一章 "),
        F.col("s_name"),
        F.lit("\n　　推开门。\n　　第一章 "),
        F.col("s_name"),
        F.lit("\n　　没有船。\n第三章 空章\n第四章　远灯\n　　灯灭了。\n"),
    )
    found = chapters.of_texts(t("supplier").select(F.col("s_suppkey").cast("string").alias("path"), body.alias("text")))
    return found.select("path", "index", "kind", "number", "title", "volume_title")


@query(f"select printf('novel%05d', b) as book, chapter::int as chapter, '第' || {_numeral('chapter')} || '章 第' || chapter || '夜' as heading from (select unnest(range(50)) as b), (select unnest(range(1, 41)) as chapter)")
def synthetic_novels(t):
    """Generated novels (S-14)."""
    return synthetic.novels(t("region").sparkSession, 50, 40).select("book", "chapter", "heading")


@query("select doc_id::int as chapter, substr(text, 1, 12) as quote, source as speaker, case when doc_id % 4 = 0 then 2 end::int as occurrence, len(case when doc_id % 2 = 0 then ['x'] else [] end)::int as aliases from documents where doc_id > 0 and length(trim(substr(text, 1, 12))) > 0 and source is not null")
def gold_labels(t):
    """Speaker labels from JSON lines, comments and blank lines left out (S-12)."""
    rows = t("documents").where("doc_id > 0 and length(trim(substring(text, 1, 12))) > 0 and source is not null")
    told = F.struct(F.col("doc_id").alias("chapter"), F.substring("text", 1, 12).alias("quote"), F.col("source").alias("speaker"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"))).alias("aliases"), F.when(F.col("doc_id") % 4 == 0, 2).alias("occurrence"))
    noise = t("region").select(F.when(F.col("r_regionkey") % 2 == 0, "# note").otherwise("  ").alias("value"))
    found = gold.attribution_labels(rows.select(F.to_json(told).alias("value")).unionByName(noise))
    return found.select("chapter", "quote", "speaker", "occurrence", F.size("aliases").alias("aliases"))


@query("select (doc_id + 1)::int as chapter, case when quality = 1 then 'evidence' else 'quote' end as kind, case when toxic = 1 then 'contradicts' else 'supports' end as expected from labels")
def shadow_labels(t):
    """Labels of two kinds for a second judge (S-13)."""
    kind = F.when(F.col("quality") == 1, "evidence").otherwise("quote")
    expected = F.when(F.col("toxic") == 1, "contradicts").otherwise("supports")
    told = F.struct(kind.alias("kind"), (F.col("doc_id") + 1).alias("chapter"), F.lit("q").alias("quote"), F.when(F.col("quality") == 1, "c").alias("claim"), expected.alias("expected"))
    return gold.shadow_labels(t("labels").select(F.to_json(told).alias("value"))).select("chapter", "kind", "expected")


@query("select c_mktsegment as title, min(c_custkey) as id from customer where c_nationkey < 5 group by 1 union all select 'default', 0 where 'default' not in (select c_mktsegment from customer)")
def get_or_create(t):
    """What is asked for and not there yet is made, once (S-25)."""
    there = t("customer").where("c_nationkey < 5").groupBy(F.col("c_mktsegment").alias("title")).agg(F.min("c_custkey").alias("id"))
    asked = t("region").limit(1).select(F.lit("default").alias("title"), F.lit(0).cast("long").alias("id"))
    return M.inserted_if_new(M.inserted_if_new(there, asked, ["title"]), asked, ["title"])


@query("""
with c as (select doc_id, doc_id % 5 <> 0 as fine from documents where length(text) >= 60),
     f as (select doc_id::varchar || ':' || k as fact_id, 'p' || doc_id % 20 as subject, doc_id::int as chapter, k, (doc_id * 7 + k) % 3 as value, doc_id % 4 = 1 as low from c, (select unnest(range(2)) as k) where fine),
     h as (select *, lag(value) over w as old_value, row_number() over w as nth from f window w as (partition by subject, k order by chapter)),
     s as (select * from h where nth = 1 or old_value <> value)
select fact_id, lead(chapter) over (partition by subject, k order by chapter) as valid_to, low as review from s
""")
def fact_commit(t):
    """Batches of facts, whole or not at all, as histories, with those of low confidence for review (D-16)."""
    docs = t("documents").where("length(text) >= 60")
    fact = lambda k: F.struct(
        F.concat_ws(":", "doc_id", F.lit(k)).alias("fact_id"),
        F.lit("state").alias("kind"),
        F.lit("b").alias("book"),
        F.col("doc_id").cast("string").alias("chapter_id"),
        F.col("doc_id").cast("int").alias("chapter"),
        F.concat(F.lit("p"), (F.col("doc_id") % 20).cast("string")).alias("subject"),
        F.lit(f"field{k}").alias("field"),
        F.lit(None).cast("string").alias("object"),
        ((F.col("doc_id") * 7 + k) % 3).cast("string").alias("value"),
        F.when(F.col("doc_id") % 4 == 1, 0.5).otherwise(0.9).alias("confidence"),
        F.lit(20 * k).alias("char_start"),
        F.lit(20 * k + 20).alias("char_end"),
        F.when((F.col("doc_id") % 5 == 0) & F.lit(k == 1), "not there").otherwise(F.substring("text", 20 * k + 1, 20)).alias("quote"),
        F.lit(None).cast("string").alias("story_time"),
    )
    parts, _ = K.commit(docs.select(F.inline(F.array(fact(0), fact(1)))), docs.select(F.col("doc_id").cast("string").alias("chapter_id"), "text"))
    review = parts["review"].select("fact_id", F.lit(True).alias("review"))
    return parts["states"].select("fact_id", "valid_to").join(review, "fact_id", "left").fillna(False, ["review"])


@query("""
with s as (select doc_id, case when quality = 1 then md5(text) else 'old' end as stored from labels join documents using (doc_id) where toxic = 0)
select d.doc_id as scene_id from documents d left join s using (doc_id) where stored is distinct from md5(text)
""")
def incremental_index(t):
    """Scenes to embed: new to the model, or changed (R-09); vectors of other models do not count."""
    scenes = t("documents").select(F.col("doc_id").alias("scene_id"), F.md5("text").alias("content_hash"))
    old = t("labels").join(scenes, F.col("doc_id") == F.col("scene_id")).select("scene_id", F.when(F.col("toxic") == 0, "m1").otherwise("m2").alias("model"), F.when(F.col("quality") == 1, F.col("content_hash")).otherwise("old").alias("content_hash"))
    return R.to_index(scenes, old, "m1").select("scene_id")


@query("""
with c as (select user_id, event_id, event_type = 'error' as failed, min(case when event_type = 'error' then event_id end) over (partition by user_id) as first from events)
select user_id, count(*) as structure, count(*) filter (first is null or event_id <= first) as consistency from c group by user_id
""")
def edition_drivers(t):
    """How far two kinds of runs get: one goes on after failures, one stops at the first (R-14)."""
    rows = t("events").select("user_id", "event_id", "event_type")
    stopped = H.until_failure(rows, ["user_id"], "event_id", F.col("event_type") == "error").groupBy("user_id").agg(F.count("*").alias("consistency"))
    return rows.groupBy("user_id").agg(F.count("*").alias("structure")).join(stopped, "user_id")


def _answer(system: str, user: str) -> str:
    """A model for the queries below: it answers by what it is asked, first with something that is no JSON."""
    if "The last answer was no JSON" not in user:
        return "let me see"
    asked = json.loads(user.split("\n\nThe last answer")[0])
    if "quotes" in asked:
        return json.dumps({"attributions": [{"id": q["id"], "kind": "thought" if "心" in q["before"] else "dialogue", "speaker": asked["known"][0] if "问" in q["after"] else None, "confidence": 3} for q in asked["quotes"][:2]] + [{"id": "q77"}]})
    text = asked["chapter"]
    if "no answer" in text:
        raise RuntimeError("down")
    return json.dumps({"states": [{"subject": "p", "field": "f", "value": str(len(asked["known"])), "quote": text[:6]}, {"subject": "p", "field": "g", "value": "x", "quote": "nowhere"}]})


MADE_OF = "select c_custkey, case c_custkey % 4 when 0 then '“走。”她问。' when 1 then '心想：“走。”' when 2 then '“走。”“等等。”她问。“好。”' else '没有人。' end as text from customer"


SAYS = "case c_custkey % 4 when 0 then ['dialogue|沈舟|1.0'] when 1 then ['thought|[unknown]|0.0'] when 2 then ['dialogue|沈舟|1.0', 'dialogue|沈舟|1.0', 'dialogue|[unknown]|0.0'] else [] end"


@query(f"""
with s as (select c_custkey, unnest({SAYS}) as said, generate_subscripts({SAYS}, 1) - 1 as quote from customer)
select c_custkey, quote::int as quote, split_part(said, '|', 1) as kind, split_part(said, '|', 2) as speaker, split_part(said, '|', 3)::double as confidence from s
""")
def chat_attribution(t):
    """Speakers by a chat model: answers that are no JSON are asked for again, quotes it leaves out or invents, and sure
    numbers out of range, are put right (X-07)."""
    texts = t("customer").select(F.col("c_custkey").cast("string").alias("chapter_id"), F.expr(MADE_OF.split("select c_custkey, ")[1].split(" as text")[0]).alias("text"))
    told = passes.attributed(texts, passes.ChatAttributor(adapters.ScriptedModel(_answer)), ["沈舟"]).where("error is null")
    return told.select(F.col("chapter_id").cast("long").alias("c_custkey"), "quote", "kind", "speaker", "confidence")


@query("""
with d as (select doc_id, 'b' || doc_id % 50 as book, substr(text, 1, 6) as head, text, row_number() over (partition by doc_id % 50 order by doc_id) as nth, doc_id % 97 = 13 as down from documents where text <> ''),
     s as (select *, min(case when down then nth end) over (partition by book) as stops from d)
select doc_id, case when down then 'failed' when instr(substr(text, 2), head) = 0 then 'located' else 'refused' end as outcome, case when not down and instr(substr(text, 2), head) = 0 then 0 end::int as char_start
from s where stops is null or nth <= stops
""")
def consistency_pass(t):
    """Facts by a model, chapter by chapter: kept where the text says them exactly once, and none after a chapter that
    failed (X-09)."""
    text = F.when(F.col("doc_id") % 97 == 13, F.concat(F.lit("no answer "), "text")).otherwise(F.col("text"))
    asked = t("documents").where("text <> ''").select(F.concat(F.lit("b"), (F.col("doc_id") % 50).cast("string")).alias("book"), F.col("doc_id").cast("string").alias("chapter_id"), F.col("doc_id").cast("int").alias("chapter"), text.alias("text"))
    found = consistency.proposed(asked, adapters.ScriptedModel(_answer))
    outcome = F.when(F.max(F.col("error").startswith("failed")), "failed").when(F.count("quote") > 0, "located").otherwise("refused")
    return found.groupBy("chapter_id").agg(outcome.alias("outcome"), F.min("char_start").alias("char_start")).select(F.col("chapter_id").cast("long").alias("doc_id"), "outcome", "char_start")


class _Judge:
    """Supports what is said in an even number of characters, breaks on one word, and is sometimes beside the point."""

    model = "judge/1"

    def choose(self, question: str, choices: list[str]) -> str:
        if "xbreakx" in question:
            raise RuntimeError("down")
        return choices[0] if len(question.split("\n")[1]) % 2 == 0 else "perhaps"


@query("""
with c as (select conv_id, turn, length(role) as n, conv_id % 17 = 3 and turn = 1 as breaks from conversations), b as (select *, (row_number() over (partition by conv_id order by turn) - 1) // 8 as batch from c),
     e as (select *, bool_or(breaks) over (partition by conv_id, batch) as down from b)
select conv_id, turn, case when down then null when n % 2 = 0 then 'supports' else 'uncertain' end as choice, down as failed from e
""")
def shadow_judging(t):
    """A second judge over claims, eight at a time; a batch whose call fails is marked, answers beside the choices are
    uncertain, and no fact is touched (X-10, X-11)."""
    broken = (F.col("conv_id") % 17 == 3) & (F.col("turn") == 1)
    claims = t("conversations").select(F.col("conv_id").alias("chapter_id"), F.col("turn").alias("seq"), F.col("role").alias("claim"), F.when(broken, "xbreakx").otherwise("context").alias("context"))
    found = passes.judged(claims, _Judge(), "does it?", ["supports", "insufficient"])
    return found.select(F.col("chapter_id").alias("conv_id"), F.col("seq").alias("turn"), "choice", F.col("error").isNotNull().alias("failed"))
