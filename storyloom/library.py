"""The engine's functions for a user: import, parse, list, search, report, export. Tables live in a TableStore.

Everything returns DataFrames or plain values; there is no server.
"""

from __future__ import annotations

import html
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import charts
from storyloom.functions import text as X
from storyloom.operators import attribution as A
from storyloom.operators import consistency, facts
from storyloom.operators import history as H
from storyloom.operators import maintenance as M
from storyloom.operators import reorder as O
from storyloom.operators import report as P
from storyloom.operators import retrieval as R
from storyloom.operators import spans as S
from storyloom.operators import views as V
from storyloom.operators.passes import attributed
from storyloom.sources import adapters, chapters, epub, lines
from storyloom.sources.gold import located
from storyloom.sources.store import Held, Lease, TableStore, delete_book

STORY_KINDS = ("chapter", "prologue", "extra")
BOOKS = "book_id string, title string, author string"
EDITIONS = "edition_id string, book_id string, label string, path string"
CHAPTERS = "book_id string, edition_id string, chapter_id string, index int, kind string, number int, title string, volume_title string, text string, content_hash string"
RUNS = "chapter_id string, book_id string, pass string, attributor string, attempt int, status string, error string, at timestamp"
ENTITIES = "book_id string, entity_id string, type string, canonical_name string"
MENTIONS = "book_id string, chapter_id string, entity_id string, surface string, char_start int, char_end int"
SCENES = "book_id string, chapter_id string, index int, char_start int, char_end int, character_ids array<string>"
SEGMENTS = "book_id string, chapter_id string, index int, kind string, char_start int, char_end int, speaker string, confidence double"
#: Chapters that are parsed and written at once, under a lease that is looked at before each such wave.
AT_ONCE = 1000
#: Bars of a report's charts.
GROUPS = 30


def _ident(prefix: str, *parts: Column | str) -> Column:
    """An id that is a hash of what identifies a thing, so a second import gives the same one."""
    told = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *told), 256), 1, 24))


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("author", T.StringType())]))
def _named(paths: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lines.title_and_author(p) for p in paths], columns=["title", "author"])


def import_books(store: TableStore, folder: str, label: str | None = None) -> DataFrame:
    """Novel files of a folder into books, editions and chapters.

    A book is a title with an author, told by the e-book itself or by the file's name. An edition of it is a label, the
    file's name if none is given; two files of one book are two editions, and their chapters do not mix. An edition that
    is there already is reconciled by content: its chapters keep their ids, and only chapters that are new, or whose text,
    heading, volume or place is another, are written; of a file that did not change nothing is. Returns one row per
    chapter: chapter_id, how (kept, edited, added, removed) and moved, whether it changed its place among those that
    stay.
    """
    files = lines.read_files(store.spark, folder)
    none = F.lit(None).cast("string")
    plain = chapters.of_texts(lines.decoded(files)).withColumns({"book_title": none, "author": none})
    told = epub.lines(files)
    own = told.groupBy("path").agg(F.max("book_title").alias("book_title"), F.max("author").alias("author"))
    split = plain.unionByName(chapters.chapters(told.drop("book_title", "author"), lines.layouts(told)).join(own, "path"))
    named = split.withColumn("name", _named("path")).withColumns({"own_title": F.coalesce("book_title", "name.title"), "own_author": F.coalesce("author", "name.author")})
    new = named.withColumn("book_id", _ident("book_", "own_title", "own_author")).withColumn("label", F.lit(label) if label else F.element_at(F.split("path", "/"), -1))
    new = new.withColumn("edition_id", _ident("ed_", "book_id", "label")).withColumn("chapter_id", _ident("ch_", "edition_id", "index", "content_hash"))
    rows = new.drop("name", "book_title", "author", "warnings")
    again = not files.select("path").join(store.read("editions", EDITIONS).select("path"), "path", "left_semi").isEmpty()
    # Texts are set aside when the files are likely to be new; else those of changed chapters are split once more.
    staged, path = store.staged(rows.drop("text") if again else rows)
    touched = staged.select("edition_id").distinct()
    old = store.read("chapters", CHAPTERS).drop("text").join(touched, "edition_id", "left_semi")
    listed = lambda df: df.select("chapter_id", "edition_id", "content_hash", *PLACED)
    both = listed(old).withColumn("side", F.lit(-1)).unionByName(listed(staged).withColumn("side", F.lit(1)))
    differs = both.groupBy("chapter_id", "edition_id", "content_hash", *PLACED).agg(F.sum("side").alias("side")).where("side <> 0") if again else None
    if again and differs.isEmpty():  # the usual case: nothing is another, so nothing is matched or written
        return store.read("chapters", CHAPTERS).select("chapter_id", "edition_id").join(touched, "edition_id", "left_semi").select("chapter_id", F.lit("kept").alias("how"), F.lit(False).alias("moved"))
    if not again and old.isEmpty():
        told = staged.select("chapter_id", F.col("chapter_id").alias("made_id"), F.lit("added").alias("how"), F.lit(False).alias("moved"), F.lit(True).alias("changed"))
    else:
        told, _ = store.staged(_reconciled(old, staged.drop("text")))
    found = {(r["how"], r["changed"]): r["count"] for r in told.groupBy("how", "changed").count().collect()}
    books = staged.select("book_id", F.col("own_title").alias("title"), F.col("own_author").alias("author")).dropDuplicates(["book_id"])
    editions = staged.select("edition_id", "book_id", "label", "path").dropDuplicates(["edition_id"])
    done = f"import_{uuid.uuid4().hex}"
    log = told.where("how <> 'kept' or moved").select(F.lit(done).alias("import_id"), "chapter_id", "how", "moved")

    def put(name: str, kind: str, made: DataFrame, key: str) -> None:
        """Those that are not there as they are."""
        there = store.read(name, kind).select([F.col(c).alias(f"_{c}") for c in made.columns])
        other = made.join(there, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in made.columns], "left_anti")
        if not other.isEmpty():
            store.upsert(name, other, [key])

    with ThreadPoolExecutor(3) as pool:  # three tables that do not depend on one another; chapters follow, so none is without its edition
        jobs = [pool.submit(put, "books", BOOKS, books, "book_id"), pool.submit(put, "editions", EDITIONS, editions, "edition_id")]
        if any(how != "kept" or changed for how, changed in found):
            jobs.append(pool.submit(store.append, "imports", log))
        for f in jobs:
            f.result()
    if any(changed for _, changed in found):
        own = told.where("changed").select(F.col("made_id").alias("chapter_id"), F.col("chapter_id").alias("own_id"))
        made = (rows if again else staged).join(own, "chapter_id").withColumn("chapter_id", F.col("own_id")).select([c.split()[0] for c in CHAPTERS.split(", ")])
        if all(how == "added" for how, changed in found if changed):
            store.append("chapters", made)
        else:
            store.upsert("chapters", made, ["chapter_id"])
    if any(how == "removed" for how, _ in found):
        store.delete("chapters", told.where("how = 'removed'").select("chapter_id"), ["chapter_id"])
    if not again and set(found) == {("added", True)}:
        told = store.read("imports").where(F.col("import_id") == done)
    store.files.remove(path)
    return told.select("chapter_id", "how", "moved")


#: What a chapter's row says of it, besides its text.
PLACED = ["index", "kind", "number", "title", "volume_title"]


def _reconciled(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chapters that are there against those of a file: chapter_id (the one that stays), made_id (the file's), how,
    moved, and changed: whether its row must be written."""
    key = F.concat_ws("#", "edition_id", "kind", F.coalesce(F.col("number").cast("string"), F.concat(F.lit("@"), F.coalesce("title", F.lit("")))))
    same = F.concat_ws("#", "edition_id", "content_hash")
    told = lambda rows: rows.select(F.col("chapter_id").alias("id"), key.alias("k"), same.alias("h"))
    match = M.matched(told(old), told(new), "id", "k", "h")
    row = lambda rows, side: rows.select(F.col("chapter_id").alias(f"{side}_id"), F.col("edition_id").alias(f"{side}_edition"), F.struct(*PLACED).alias(side))
    both = match.join(row(old, "old"), "old_id", "left").join(row(new, "new"), "new_id", "left")
    pairs = both.select(F.coalesce("new_edition", "old_edition").alias("edition_id"), "old_id", "new_id", "how", "old", "new", F.col("old.index").alias("old_at"), F.col("new.index").alias("new_at"))
    stays = F.col("old_at").isNotNull() & F.col("new_at").isNotNull()
    placed = pairs.where(stays).select("edition_id", F.col("new_id").alias("made_id"), "old_at", "new_at")
    moved = O.moves(placed, ["edition_id"], "old_at", "new_at").select(F.col("made_id").alias("new_id"), "moved")
    changed = (F.col("how") != "removed") & ((F.col("how") != "kept") | ~F.col("old").eqNullSafe(F.col("new")))
    joined = pairs.join(moved, "new_id", "left").fillna(False, ["moved"])
    return joined.select(F.coalesce("old_id", "new_id").alias("chapter_id"), F.col("new_id").alias("made_id"), "how", "moved", changed.alias("changed"))


def list_books(store: TableStore) -> DataFrame:
    """Books with the number of their editions and chapters; books without any have 0."""
    editions = store.read("editions", EDITIONS).groupBy("book_id").agg(F.count("*").alias("editions"))
    counts = store.read("chapters", CHAPTERS).groupBy("book_id").agg(F.count("*").alias("chapters"))
    return store.read("books", BOOKS).join(editions, "book_id", "left").join(counts, "book_id", "left").fillna(0, ["editions", "chapters"])


def list_editions(store: TableStore, book_id: str) -> DataFrame:
    """A book's editions with the number of their chapters."""
    counts = store.read("chapters", CHAPTERS).groupBy("edition_id").agg(F.count("*").alias("chapters"))
    return store.read("editions", EDITIONS).where(F.col("book_id") == book_id).join(counts, "edition_id", "left").fillna(0, ["chapters"])


def chapter_list(store: TableStore, book_id: str, edition_id: str | None = None) -> DataFrame:
    """Chapters of a book, or of one edition, without their texts, with segments and the newest run."""
    own = store.read("chapters", CHAPTERS).where(F.col("book_id") == book_id).where(F.col("edition_id") == edition_id if edition_id else F.lit(True))
    own = own.select("edition_id", "chapter_id", "index", "kind", "number", "title", "volume_title")
    counts = store.read("segments", SEGMENTS).where(F.col("book_id") == book_id).groupBy("chapter_id").agg(F.count("*").alias("segments"))
    runs = H.latest(store.read("runs", RUNS).where(F.col("book_id") == book_id), ["chapter_id"], "at", "attempt").select("chapter_id", "status")
    named = F.coalesce("title", F.when(F.col("number").isNotNull(), F.format_string("第%d章", "number")).otherwise(F.col("kind")))
    return own.join(counts, "chapter_id", "left").join(runs, "chapter_id", "left").fillna(0, ["segments"]).withColumn("title", named).orderBy("edition_id", "index")


def _plan(store: TableStore, book_id: str, attributor: str, force: bool, most_failed: int) -> DataFrame:
    """The chapters of a book that are to be parsed, with the number of this attempt."""
    story = store.read("chapters", CHAPTERS).where((F.col("book_id") == book_id) & F.col("kind").isin(*STORY_KINDS))
    runs = store.read("runs", RUNS).where((F.col("pass") == "structure") & (F.col("attributor") == attributor))
    per = runs.groupBy("chapter_id").agg(F.bool_or(F.col("status") == "succeeded").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("runs"))
    joined = story.join(per, "chapter_id", "left").fillna(0, ["failed", "runs"]).fillna(False, ["done"])
    wanted = joined if force else joined.where(H.run_decision(F.col("done"), F.col("failed"), F.lit(False), F.lit(False), most_failed) == "run")
    return wanted.withColumn("attempt", (F.col("runs") + 1).cast("int"))


def parse_book(store: TableStore, book_id: str, by, known: list[str] | None = None, owner: str | None = None, force: bool = False, stop_at_failure: bool = False, most_failed: int = 3, at_once: int = AT_ONCE, told: Callable[[int], None] | None = None, start: int = 0) -> dict[str, int]:
    """Structure of the chapters that still need it, under the book's lease; a failed chapter is recorded.

    Chapters are parsed in waves of at_once, in order; each wave is written before the next begins, and before each the
    lease, which is renewed all the time, is looked at: if it is lost, nothing more is written. With stop_at_failure the
    chapters after the first failed one are left for the next time. told gets the last index of each wave, start is the
    index to go on from. Returns counts by status.
    """
    counts: dict[str, int] = {}
    with Held(Lease(store, book_id, owner or f"parser-{uuid.uuid4().hex}"), book_id) as held:
        plan = _plan(store, book_id, by.name, force, most_failed).where(F.col("index") >= start).select("chapter_id", "edition_id", "index", "text", "attempt")
        place = F.row_number().over(Window.partitionBy(F.lit(book_id)).orderBy("edition_id", "index"))  # the chapters of one book
        waves = plan.select("chapter_id", "index", F.floor((place - 1) / at_once).cast("int").alias("wave")).cache()
        for r in waves.groupBy("wave").agg(F.max("index").alias("last")).orderBy("wave").collect():
            held.check()
            mine = plan.join(waves.where(F.col("wave") == r["wave"]).select("chapter_id"), "chapter_id", "left_semi")
            done = _parse_wave(store, book_id, mine, by, known or [], stop_at_failure, held)
            counts = {k: counts.get(k, 0) + done.get(k, 0) for k in counts | done}
            if told:
                told(r["last"])
            if stop_at_failure and done.get("failed"):
                break
        waves.unpersist()
    return counts


def _with_earlier_names(plan: DataFrame, by, known: list[str]) -> DataFrame:
    """The chapters of a wave with the names that those before them in it tell: rules are applied once to find the names,
    and then again with them."""
    names = attributed(plan, by, known).where((F.col("speaker") != A.UNKNOWN) & F.col("error").isNull()).select("chapter_id", F.col("speaker").alias("name")).distinct()
    first = names.join(plan.select("chapter_id", "edition_id", "index"), "chapter_id").groupBy("edition_id", "name").agg(F.min("index").alias("index"))
    told = first.groupBy("edition_id").agg(F.collect_list(F.struct("index", "name")).alias("told"))  # the speakers of a book
    earlier = F.transform(F.filter("told", lambda x: x["index"] < F.col("index")), lambda x: x["name"])
    return plan.join(told, "edition_id", "left").withColumn("earlier", F.array_sort(F.coalesce(earlier, F.array().cast("array<string>")))).drop("told")


def _parse_wave(store: TableStore, book_id: str, plan: DataFrame, by, known: list[str], stop_at_failure: bool, held: Held) -> dict[str, int]:
    met = [r["canonical_name"] for r in store.read("entities", ENTITIES).where(F.col("book_id") == book_id).select("canonical_name").collect()]  # a book's cast
    known = list(dict.fromkeys([*known, *sorted(met)]))
    chapters_now = _with_earlier_names(plan, by, known) if getattr(by, "repeatable", False) else plan
    told, told_path = store.staged(attributed(chapters_now, by, known))  # a model is asked once, whatever is lost later
    failed = told.where("error is not null").select("chapter_id", "error")
    state = plan.join(failed, "chapter_id", "left")
    if stop_at_failure:
        first = F.min(F.when(F.col("error").isNotNull(), F.struct("edition_id", "index"))).over(Window.partitionBy())
        state = state.withColumn("first", first).where(F.col("first").isNull() | (F.struct("edition_id", "index") <= F.col("first")))
    done = state.select("chapter_id", F.lit(book_id).alias("book_id"), F.lit("structure").alias("pass"), F.lit(by.name).alias("attributor"), "attempt", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "error", F.current_timestamp().alias("at"))
    done, done_path = store.staged(done)
    counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
    fine = done.where("status = 'succeeded'").select("chapter_id")
    spoken = told.where("error is null").join(fine, "chapter_id", "left_semi")
    lengths = plan.join(fine, "chapter_id", "left_semi").select("chapter_id", F.length("text").alias("length"))
    scenes = lengths.select("chapter_id", F.lit(0).alias("scene"), F.lit(0).alias("s_start"), F.col("length").alias("s_end"))
    cover = S.segments(spoken.select("chapter_id", "char_start", "char_end"), scenes, lengths, ["chapter_id"])
    named = cover.join(spoken.select("chapter_id", "char_start", F.col("kind").alias("told"), "speaker", "confidence"), ["chapter_id", "char_start"], "left")
    rows = named.select(F.lit(book_id).alias("book_id"), "chapter_id", "index", F.coalesce("told", "kind").alias("kind"), "char_start", "char_end", "speaker", "confidence")
    held.check()
    if counts.get("succeeded"):
        _put_cast(store, book_id, plan.join(fine, "chapter_id", "left_semi"), spoken, [n for n in known if n not in met])
        store.replace_scope("segments", rows, ["chapter_id"])
    if counts:
        store.append("runs", done)
    for path in (told_path, done_path):
        store.files.remove(path)
    return counts


def _put_cast(store: TableStore, book_id: str, texts: DataFrame, spoken: DataFrame, given: list[str]) -> None:
    """Entities of a book that are new, and of these chapters the mentions of all of them and the scenes with their casts.
    Written before the segments and the runs, by chapter, so a parse that is cut off is made good by the next one."""
    names = spoken.where((F.col("speaker") != A.UNKNOWN) & (F.col("kind") != "narration")).select(F.col("speaker").alias("canonical_name")).distinct()
    names = names.unionByName(store.spark.createDataFrame([(n,) for n in given], "canonical_name string")).distinct()
    ident = _ident("ent_", F.lit(book_id), F.lit("character"), "canonical_name")
    made = names.select(F.lit(book_id).alias("book_id"), ident.alias("entity_id"), F.lit("character").alias("type"), "canonical_name")
    new = made.join(store.read("entities", ENTITIES).select("entity_id"), "entity_id", "left_anti").select(made.columns)
    if not new.isEmpty():
        store.append("entities", new)
    cast = store.read("entities", ENTITIES).where(F.col("book_id") == book_id).select("entity_id", "canonical_name")
    lexicon = [(r["entity_id"], r["canonical_name"]) for r in cast.collect()]  # a book's cast
    found = S.mentions(texts.select("chapter_id", "text"), lexicon, ["chapter_id"])
    mentions, path = store.staged(found.select(F.lit(book_id).alias("book_id"), "chapter_id", F.col("entity").alias("entity_id"), "surface", "char_start", "char_end"))
    speakers = spoken.join(cast.withColumnRenamed("canonical_name", "speaker"), "speaker").select("chapter_id", "char_start", "entity_id")
    seen = mentions.select("chapter_id", "char_start", "entity_id").unionByName(speakers)
    casts = V.first_appearances(seen, ["chapter_id"], "char_start", "entity_id").withColumnRenamed("cast", "character_ids")
    whole = texts.select(F.lit(book_id).alias("book_id"), "chapter_id", F.lit(0).alias("index"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))
    scenes = whole.join(casts, "chapter_id", "left").withColumn("character_ids", F.coalesce("character_ids", F.array().cast("array<string>"))).select([c.split()[0] for c in SCENES.split(", ")])
    if store.exists("mentions"):
        store.delete("mentions", texts.select("chapter_id"), ["chapter_id"])
    store.append("mentions", mentions)
    store.replace_scope("scenes", scenes, ["chapter_id"])
    store.files.remove(path)


def entities(store: TableStore, book_id: str, kind: str | None = None, word: str | None = None) -> DataFrame:
    """A book's entities, of a type and with a word in their name if these are asked for, with how often they speak and
    are mentioned, 0 kept."""
    own = store.read("entities", ENTITIES).where(F.col("book_id") == book_id)
    own = own.where(F.col("type") == kind) if kind else own
    own = own.where(V.named(["canonical_name"], word)) if word else own
    said = store.read("segments", SEGMENTS).where((F.col("book_id") == book_id) & (F.col("kind") != "narration"))
    said = said.join(own.select("entity_id", F.col("canonical_name").alias("speaker")), "speaker").select("entity_id")
    mentions = store.read("mentions", MENTIONS).where(F.col("book_id") == book_id).select("entity_id")
    return V.counted(own, {"dialogues": (said, "entity_id"), "mentions": (mentions, "entity_id")}, "entity_id")


def mentions_of(store: TableStore, entity_id: str, limit: int = 20) -> DataFrame:
    """The newest mentions of an entity with their chapter and what stands around them."""
    own = store.read("mentions", MENTIONS).where(F.col("entity_id") == entity_id)
    placed = own.join(store.read("chapters", CHAPTERS).select("chapter_id", F.col("index").alias("chapter"), "title", "text"), "chapter_id")
    told = X.excerpt(F.col("text"), F.col("char_start"), F.col("char_end"), 100)
    return placed.orderBy(F.desc("chapter"), F.desc("char_start")).limit(limit).select("chapter", "title", "surface", "char_start", "char_end", told.alias("excerpt"))


#: Tables that hang on a book: name, its key to the level above, the table above, that table's key.
CHAIN = [("editions", "book_id", "books", "book_id"), ("chapters", "edition_id", "editions", "edition_id"), ("segments", "chapter_id", "chapters", "chapter_id"), ("mentions", "chapter_id", "chapters", "chapter_id"), ("scenes", "chapter_id", "chapters", "chapter_id"), ("entities", "book_id", "books", "book_id"), ("runs", "chapter_id", "chapters", "chapter_id")]


def delete(store: TableStore, book_id: str) -> dict[str, int]:
    """A book with all that hangs on it, unless somebody is working on it; how many rows of each table went."""
    return delete_book(store, book_id, [c for c in CHAIN if store.exists(c[0])])


def chapters_by_state(store: TableStore, book_id: str, state: str) -> DataFrame:
    """Chapters that are parsed, unparsed or unfinished (failed or interrupted)."""
    listed = chapter_list(store, book_id)
    status = F.coalesce("status", F.lit("unparsed"))
    wanted = {"parsed": status == "succeeded", "unparsed": status == "unparsed", "unfinished": status.isin("failed", "interrupted")}
    return listed.where(wanted[state])


def evaluate(store: TableStore, book_id: str, gold: DataFrame) -> DataFrame:
    """Gold labels (chapter, quote, speaker, aliases, occurrence) against the stored speakers, chapter by chapter.

    chapter is the chapter's number; labels that cannot be placed, and chapters without a parse, are told apart from wrong ones.
    """
    own = chapter_list(store, book_id).where("kind = 'chapter'").select("chapter_id", F.col("number").alias("chapter"), "status")
    texts = store.read("chapters", CHAPTERS).select("chapter_id", "text")
    spoken = store.read("segments", SEGMENTS).where((F.col("book_id") == book_id) & (F.col("kind") != "narration")).join(texts, "chapter_id").join(own.select("chapter_id", "chapter"), "chapter_id")
    said = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    candidates = spoken.select("chapter", "index", said.alias("inner"), "char_start", "char_end")
    placed = located(gold, candidates).withColumnRenamed("index", "segment")
    guess = spoken.select("chapter", "char_start", F.col("speaker").alias("guess"))
    scored = placed.join(guess, ["chapter", "char_start"], "left").join(own.groupBy("chapter").agg(F.max("status").alias("run")), "chapter", "left")
    right = (F.col("guess") == F.col("speaker")) | F.array_contains("aliases", F.col("guess"))
    fine = F.col("status") == "found"
    return scored.groupBy("chapter").agg(
        F.count("*").alias("labels"),
        F.count_if(F.coalesce(F.col("run"), F.lit("")) != "succeeded").alias("not_parsed"),
        F.count_if(~fine).alias("not_placed"),
        F.count_if(fine & right).alias("correct"),
        F.count_if(fine & ~right & (F.col("guess") != A.UNKNOWN)).alias("wrong"),
        F.count_if(fine & (F.col("guess") == A.UNKNOWN)).alias("unattributed"),
    )


def gold_draft(store: TableStore, book_id: str, per_chapter: int = 5) -> DataFrame:
    """Spoken segments to label by hand, evenly spread over each chapter."""
    own = store.read("segments", SEGMENTS).where((F.col("book_id") == book_id) & (F.col("kind") != "narration"))
    line = Window.partitionBy("chapter_id")
    placed = own.withColumns({"rn": F.row_number().over(line.orderBy("index")) - 1, "n": F.count("*").over(line)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(per_chapter - 1)), lambda i: F.floor((i + 0.5) * F.col("n") / per_chapter).cast("int"))
    texts = store.read("chapters", CHAPTERS).select("chapter_id", "text")
    chosen = placed.where(F.array_contains(picks, F.col("rn"))).join(texts, "chapter_id")
    return chosen.select("chapter_id", "index", F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("quote"), "speaker")


def check_consistency(store: TableStore, book_id: str, model: adapters.ChatModel, budget: int = 3000, owner: str | None = None) -> dict[str, int]:
    """Facts of a book's parsed chapters, in order, by a chat model: proposed, held against the text, committed together
    with the memory they make and the runs that made them. Chapters after the first failed one are left for the next
    time; a chapter that breaks a rule gives no facts. Returns counts of runs by status.

    The facts of the whole book are made anew from what the pass accepts, so running it again changes nothing.
    """
    with Held(Lease(store, book_id, owner or f"facts-{uuid.uuid4().hex}"), book_id) as held:
        parsed = store.read("runs", RUNS).where((F.col("book_id") == book_id) & (F.col("pass") == "structure") & (F.col("status") == "succeeded")).select("chapter_id").distinct()
        texts = store.read("chapters", CHAPTERS).where(F.col("book_id") == book_id).join(parsed, "chapter_id", "left_semi")
        asked = texts.select(F.col("edition_id").alias("book"), "chapter_id", F.col("index").alias("chapter"), "text")
        found, found_path = store.staged(consistency.proposed(asked, model, budget))  # a model is asked once
        parts, _, runs = consistency.settled(found, texts.select("chapter_id", "text"))
        done = runs.select("chapter_id", F.lit(book_id).alias("book_id"), F.lit("consistency").alias("pass"), F.lit(model.model).alias("attributor"), F.lit(1).alias("attempt"), "status", "error", F.current_timestamp().alias("at"))
        done, done_path = store.staged(done)
        counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
        held.check()
        for name in ("states", "relations", "story_events", "threads", "review", "memory"):
            rows = parts[name].withColumn("book_id", F.lit(book_id))
            store.replace_scope(name, rows, ["book_id"])
        if counts:
            store.append("runs", done)
        for path in (found_path, done_path):
            store.files.remove(path)
    return counts


def rebuild_memory(store: TableStore, book_id: str) -> int:
    """Memory made anew from the stored facts; how many items there are."""
    held = {n: store.read(n).where(F.col("book_id") == book_id).drop("book_id") for n in ("states", "relations", "story_events", "threads")}
    items = facts.memory(held).withColumn("book_id", F.lit(book_id))
    store.replace_scope("memory", items, ["book_id"])
    return store.read("memory").where(F.col("book_id") == book_id).count()


def sync_knowledge(store: TableStore, book_id: str, base: adapters.KnowledgeBase, stop: Callable[[], bool] = lambda: False) -> int:
    """Chapters to a knowledge base: new ones made, changed ones written anew, those that are gone deleted; how many calls.

    Each call is recorded before the next is made, so a sync that is stopped goes on where it was.
    """
    kind = "book_id string, chapter_id string, document_id string, content_hash string"
    now = store.read("chapters", CHAPTERS).where(F.col("book_id") == book_id)
    sent = store.read("documents", kind).where(F.col("book_id") == book_id)
    both = now.select("chapter_id", "index", "title", "text", "content_hash").join(sent.select("chapter_id", "document_id", F.col("content_hash").alias("sent")), "chapter_id", "full")
    calls = 0
    for r in both.where("not content_hash <=> sent").orderBy(F.col("index").asc_nulls_last()).toLocalIterator():
        if stop():
            break
        if r["content_hash"] is None:
            base.delete(r["document_id"])
            store.delete("documents", store.spark.createDataFrame([(r["chapter_id"],)], "chapter_id string"), ["chapter_id"])
        else:
            title = r["title"] or str(r["index"])
            ident = r["document_id"]
            if ident is None:
                ident = base.create(title, r["text"])
            else:
                base.update(ident, title, r["text"])
            store.upsert("documents", store.spark.createDataFrame([(book_id, r["chapter_id"], ident, r["content_hash"])], kind), ["chapter_id"])
        calls += 1
    return calls


def knowledge_status(store: TableStore, book_id: str) -> DataFrame:
    """Each chapter's document, and whether it must be sent."""
    sent = store.read("documents", "book_id string, chapter_id string, document_id string, content_hash string").select("chapter_id", "document_id", F.col("content_hash").alias("sent"))
    own = store.read("chapters", CHAPTERS).where(F.col("book_id") == book_id).select("chapter_id", "index", "content_hash")
    return own.join(sent, "chapter_id", "left").select("chapter_id", "index", "document_id", V.needs_sync(F.col("content_hash"), F.col("sent")).alias("needs_sync")).orderBy("index")


def reader(store: TableStore, chapter_id: str) -> DataFrame:
    """A chapter's segments with their texts, in order."""
    text = store.read("chapters", CHAPTERS).where(F.col("chapter_id") == chapter_id).select("chapter_id", "text")
    said = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return store.read("segments", SEGMENTS).join(text, "chapter_id").select("index", "kind", "speaker", "confidence", said.alias("text")).orderBy("index")


def voice_tasks(store: TableStore, chapter_id: str, voices: dict[str, str], narrator: str | None = None, unknown: str | None = None) -> DataFrame:
    """One task per segment: narration by the narrator, speech by its speaker's voice or the one for unknown speakers."""
    pairs = [F.lit(x) for p in voices.items() for x in p]
    own = F.try_element_at(F.create_map(*pairs), F.col("speaker")) if pairs else F.lit(None).cast("string")
    voice = F.when(F.col("kind") == "narration", F.lit(narrator)).otherwise(F.coalesce(own, F.lit(unknown)))
    return reader(store, chapter_id).select(F.concat(F.lit(f"{chapter_id}:"), F.col("index").cast("string")).alias("task_id"), "index", "kind", "text", "speaker", voice.alias("voice"))


def index_chapters(store: TableStore, embedder: adapters.Embedder) -> int:
    """Embeds the chapters whose text is new to this model; how many."""
    from storyloom.streaming.runs import to_index

    scenes = store.read("chapters", CHAPTERS).select(F.col("chapter_id").alias("scene_id"), "content_hash", "text")
    stored = store.read("embeddings", "scene_id string, model string, content_hash string, embedding array<float>")
    wanted = to_index(scenes, stored, embedder.model).select("scene_id", "text")
    n = wanted.count()
    if n:
        store.upsert("embeddings", adapters.embedded(wanted, "scene_id", "text", embedder), ["scene_id", "model"])
    return n


def search(store: TableStore, query: str, embedder: adapters.Embedder, book_ids: list[str], limit: int = 10) -> DataFrame:
    """The chapters of some books closest to a query; without books there is nothing to search."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    of_books = store.read("chapters", CHAPTERS).where(F.col("book_id").isin(*book_ids) if book_ids else F.lit(False))
    held = store.read("embeddings").where(F.col("model") == embedder.model).join(of_books.select(F.col("chapter_id").alias("scene_id"), "book_id", "index", "text"), "scene_id")
    best = R.vector_top_k(held, embedder.embed([query])[0], limit, ["index", "scene_id"])
    return best.select("scene_id", "book_id", "index", "similarity", F.substring("text", 1, 240).alias("excerpt"))


def unsearchable(store: TableStore, embedder: adapters.Embedder, book_ids: list[str]) -> DataFrame:
    """Of the asked books those that hold nothing this model could search."""
    held = store.read("embeddings", "scene_id string, model string, content_hash string, embedding array<float>").where(F.col("model") == embedder.model)
    there = store.read("chapters", CHAPTERS).join(held.select(F.col("scene_id").alias("chapter_id")), "chapter_id", "left_semi").select("book_id").distinct()
    asked = store.spark.createDataFrame([(b,) for b in book_ids], "book_id string")
    return asked.join(there, "book_id", "left_anti")


def report_rows(store: TableStore, book_id: str) -> tuple[DataFrame, DataFrame]:
    """(chapters, speakers) of a book's report."""
    own = store.read("segments", SEGMENTS).where(F.col("book_id") == book_id)
    spoken, size = F.col("kind") != "narration", F.col("char_end") - F.col("char_start")
    per = own.groupBy("chapter_id").agg(
        F.count_if(spoken & (F.col("speaker") != A.UNKNOWN)).alias("attributed"),
        F.count_if(spoken & (F.col("speaker") == A.UNKNOWN)).alias("unknown"),
        F.sum(F.when(spoken, size).otherwise(0)).alias("spoken_chars"),
        F.sum(F.when(spoken, 0).otherwise(size)).alias("narration_chars"),
    )
    listed = chapter_list(store, book_id).join(per, "chapter_id", "left").fillna(0).orderBy("index")
    speakers = own.where(spoken & (F.col("speaker") != A.UNKNOWN)).groupBy("speaker").agg(F.count("*").alias("n"))
    return listed, P.top_and_other(speakers, "speaker", "n", ["n"], 10)


def report_html(store: TableStore, book_id: str, most: int = 10_000, theme: str = "light") -> str:
    """A self-contained page of the report: totals, charts over up to GROUPS runs of chapters, the largest speakers, and the chapters; of a book with more than
    most chapters the first ones, and a line that says how many more there are and what they add up to."""
    listed, speakers = report_rows(store, book_id)
    numbers = ["attributed", "unknown", "spoken_chars", "narration_chars"]
    cell = lambda x: f"<td>{html.escape('' if x is None else str(x))}</td>"
    table = lambda names, rows: "<table><tr>" + "".join(f"<th>{html.escape(n)}</th>" for n in names) + "</tr>" + "".join("<tr>" + "".join(cell(r[n]) for n in names) + "</tr>" for r in rows) + "</table>"
    title = store.read("books", BOOKS).where(F.col("book_id") == book_id).first()
    name = html.escape(title["title"]) if title else ""
    total = listed.agg(F.count("*").alias("chapters"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers]).first()
    shown = listed.limit(most).collect()
    body = table(["chapters", *numbers], [total]) + table(["index", "title", *numbers], shown)
    if total["chapters"] > len(shown):
        rest = {c: total[c] - sum(r[c] for r in shown) for c in numbers}
        body += f"<p>{total['chapters'] - len(shown)} more chapters: " + ", ".join(f"{c} {n}" for c, n in rest.items()) + "</p>"
    groups = P.bucketed(P.numbered(listed, "index"), GROUPS).groupBy("bucket").agg(F.min("index").alias("first"), *[F.sum(c).alias(c) for c in numbers]).orderBy("bucket").collect()
    of = lambda *names: {n: [float(g[n]) for g in groups] for n in names}
    labels = [str(g["first"]) for g in groups]
    body += charts.stacked_bars(labels, of("attributed", "unknown"), theme=theme) + charts.stacked_bars(labels, of("narration_chars", "spoken_chars"), share=True, theme=theme)
    body += table(["speaker", "n"], speakers.collect())
    return f"<!doctype html><meta charset=utf-8><title>{name}</title><h1>{name}</h1>{body}"


def usage(store: TableStore) -> DataFrame:
    """Runs by pass, attributor and status."""
    return store.read("runs", RUNS).groupBy("pass", "attributor", "status").agg(F.count("*").alias("runs"), F.countDistinct("chapter_id").alias("chapters"), F.max("at").alias("last"))


COMMANDS: dict[str, Callable] = {
    "import": import_books,
    "books": list_books,
    "editions": list_editions,
    "chapters": chapter_list,
    "parse": parse_book,
    "show": reader,
    "entities": entities,
    "mentions": mentions_of,
    "delete": delete,
    "tts": voice_tasks,
    "index": index_chapters,
    "search": search,
    "report": report_html,
    "usage": usage,
    "eval": evaluate,
    "eval-sample": gold_draft,
    "consistency": check_consistency,
    "memory-rebuild": rebuild_memory,
    "sync": sync_knowledge,
    "sync-status": knowledge_status,
}
