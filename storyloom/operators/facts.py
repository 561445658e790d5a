"""From proposals to facts to memory: locate evidence, validate, supersede, queue for review, project, recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import history as H
from storyloom.operators import validate as V

PROPOSALS = (
    "fact_id string, kind string, book string, chapter_id string, chapter int, subject string, field string, object string, value string, "
    "confidence double, char_start int, char_end int, quote string, story_time string"
)


def located(proposals: DataFrame, texts: DataFrame) -> DataFrame:
    """Proposals with the span of their quote, where the chapter says it exactly once; others have status not_unique or missing."""
    joined = proposals.join(texts.select("chapter_id", "text"), "chapter_id", "left")
    at = X.unique_at(F.col("text"), F.col("quote"))
    status = F.when(at.isNotNull(), "located").when(F.instr("text", F.col("quote")) > 0, "not_unique").otherwise("missing")
    return joined.withColumns({"char_start": at, "char_end": at + F.length("quote"), "status": status}).drop("text")


def timed(evidence: tuple[Column, Column], anchor: tuple[Column, Column], text: Column) -> tuple[Column, Column, Column]:
    """The hull of an evidence span and its time anchor, and what the text says there."""
    start, end = F.least(evidence[0], anchor[0]), F.greatest(evidence[1], anchor[1])
    return start, end, X.sliced(text, start, end)


def committed(accepted: DataFrame) -> dict[str, DataFrame]:
    """Accepted proposals of whole books as histories.

    states and relations: one open row a key at a time; equal values in a row are dropped for states only.
    changes: from and to of every state that closed another. review: facts of low confidence.
    """
    states = H.superseded(accepted.where("kind = 'state'"), ["book", "subject", "field"], ["chapter", "char_start", "fact_id"], "value", "fact_id", "chapter")
    line = Window.partitionBy("book", "subject", "field").orderBy("chapter", "char_start", "fact_id")
    relations = accepted.where("kind = 'relation'").withColumns({"valid_to": F.lead("chapter").over(line), "superseded_by": F.lead("fact_id").over(line)})
    changes = states.where("old_value is not null").select("book", "chapter", "subject", "field", F.col("old_value").alias("from_value"), F.col("value").alias("to_value"), "fact_id")
    return {
        "states": states.drop("old_value"),
        "relations": relations,
        "changes": changes,
        "story_events": accepted.where("kind = 'event'"),
        "threads": accepted.where("kind = 'thread'"),
        "review": V.for_review(accepted).select("fact_id", "book", "kind", "confidence", F.lit("pending").alias("status")),
    }


def commit(proposals: DataFrame, texts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All or nothing for a chapter: if one of its facts breaks a rule, none of the chapter's is taken."""
    errors = V.fact_errors(proposals, texts)
    fine = proposals.join(errors.select("chapter_id").distinct(), "chapter_id", "left_anti").select(proposals.columns)
    return committed(fine), errors


def resolved_threads(threads: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Threads (fact_id, chapter, ...) with the chapter that resolves them (fact_id, resolved_at), first one wins."""
    first = resolutions.groupBy("fact_id").agg(F.min("resolved_at").alias("resolved_at"))
    return threads.join(first, "fact_id", "left")


def memory(parts: dict[str, DataFrame]) -> DataFrame:
    """Memory items from facts: a pure function of them, so it can be rebuilt at any time."""
    item = lambda df, room, content, end: df.select(
        F.concat(F.lit("mem_"), F.sha2(F.concat_ws("|", F.lit(room), "fact_id"), 256)).alias("item_id"),
        "book",
        F.lit(room).alias("room"),
        F.col("subject").alias("entity_id"),
        content.alias("content"),
        F.col("chapter").alias("valid_from"),
        end.cast("int").alias("valid_to"),
        "fact_id",
    )
    open_end = F.lit(None)
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            item(parts["states"], "state", F.concat_ws(": ", "field", "value"), F.col("valid_to")),
            item(parts["relations"], "relation", F.concat_ws(" ", "field", "object"), F.col("valid_to")),
            item(parts["story_events"], "event", F.col("value"), open_end),
            item(parts["threads"], "thread", F.col("value"), F.col("resolved_at") if "resolved_at" in parts["threads"].columns else open_end),
        ],
    )


def recalled(items: DataFrame, asked: list[str], book: str, at: int) -> DataFrame:
    """What held for the asked entities at a chapter, in the order asked, entities asked twice given twice."""
    spark = items.sparkSession
    order = spark.createDataFrame([(i, e) for i, e in enumerate(asked)], "pos int, entity_id string")
    held = items.where((F.col("book") == book) & (F.col("room") == "state") & H.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(at)))
    return order.join(held, "entity_id").orderBy("pos", "valid_from", "item_id")


def similar(items: DataFrame, terms: list[str], book: str, at: int, limit: int) -> DataFrame:
    """Items that hold at a chapter, by how many of the terms they contain."""
    low = F.lower("content")
    score = sum((F.when(low.contains(t.lower()), 1).otherwise(0) for t in dict.fromkeys(terms)), F.lit(0))
    held = items.where((F.col("book") == book) & H.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(at)))
    return held.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "item_id").limit(limit)


def words_of_query(query: str, lexicon: list[str]) -> list[str]:
    """Terms of a query: names of the lexicon by longest match, Latin words, and pairs of what remains. An approximation
    of a word segmentation, which needs a dictionary."""
    names, out, rest, at = sorted(lexicon, key=len, reverse=True), [], "", 0
    low = query.lower().strip()

    def flush(run: str) -> None:
        for word in "".join(c if c.isalnum() else " " for c in run).split():
            if word.isascii():
                out.append(word)
            else:
                out.extend([word[i : i + 2] for i in range(len(word) - 1)] or [word])

    while at < len(low):
        name = next((n for n in names if n and low.startswith(n.lower(), at)), None)
        if name is None:
            rest += low[at]
            at += 1
            continue
        flush(rest)
        rest = ""
        out.append(name.lower())
        at += len(name)
    flush(rest)
    return list(dict.fromkeys(out))


def aliases_at(entities: DataFrame, aliases: DataFrame, at: int) -> DataFrame:
    """name -> entity_id at a chapter: canonical names and aliases valid then; names of several entities give null."""
    valid = aliases.where(H.valid_at(F.coalesce("valid_from", F.lit(0)), F.col("valid_to"), F.lit(at)))
    names = entities.select(F.col("canonical_name").alias("name"), "entity_id").unionByName(valid.select(F.col("alias").alias("name"), "entity_id"))
    return H.unique_names(names, "name", "entity_id")


def merged_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities with the status that merges (source_id, target_id, undone) leave them in."""
    active = merges.where(~F.col("undone")).select(F.col("source_id").alias("entity_id"), "target_id")
    return entities.join(active, "entity_id", "left").withColumn("status", F.when(F.col("target_id").isNotNull(), "merged").otherwise("active"))


def reviewed(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue after decisions (fact_id, status): a pending item is decided once, by the first decision in order."""
    first = decisions.groupBy("fact_id").agg(F.min_by("status", "seq").alias("decision"))
    return queue.join(first, "fact_id", "left").withColumn("status", F.when(F.col("status") == "pending", F.coalesce("decision", "status")).otherwise(F.col("status"))).drop("decision")


def evidence(hits: DataFrame, sources: DataFrame, chapters: DataFrame, before: int, limit: int = 10) -> DataFrame:
    """Hits of a knowledge base that our own text confirms: known source, current hash, an earlier chapter, said once."""
    joined = hits.join(sources, "knowledge_id").join(chapters.select("chapter_id", "chapter", "text", "content_hash"), ["chapter_id", "content_hash"])
    at = X.unique_at(F.col("text"), F.col("content"))
    placed = joined.where(F.col("chapter") < before).withColumns({"char_start": at, "char_end": at + F.length("content")}).where("char_start is not null")
    best = Window.partitionBy("chapter_id", "char_start", "char_end").orderBy(F.desc("score"), "hit_id")
    kept = placed.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "text")
    return kept.orderBy(F.desc("score"), "hit_id").limit(limit)


def linked_chunks(chunks: DataFrame, refs: DataFrame, texts: DataFrame) -> DataFrame:
    """ref_id -> chunk_id where exactly one chunk that stands in the chapter once holds the reference."""
    at = X.unique_at(F.col("text"), F.col("content"))
    placed = chunks.join(texts.select("chapter_id", "text"), "chapter_id").withColumn("a", at).where("a is not null").select("chapter_id", "chunk_id", "a", (F.col("a") + F.length("content")).alias("b"))
    inside = refs.join(placed, "chapter_id").where("a <= char_start and char_end <= b")
    return inside.groupBy("ref_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).where("n = 1").drop("n")


def broken_chain(entries: DataFrame) -> DataFrame:
    """Audit entries (chain, seq, hash, parent) whose parent is not the hash before them."""
    before = F.lag("hash").over(Window.partitionBy("chain").orderBy("seq"))
    return entries.withColumn("expected", before).where(~F.col("parent").eqNullSafe(F.col("expected")))


def context(candidates: list[DataFrame], budget: int, overhead: int = 16) -> DataFrame:
    """Sections (kind, reference, content) of several kinds, in their order, as many as fit the token budget."""
    from storyloom.operators.spans import fitted

    if budget <= 0:
        raise ValueError("the budget must be positive")
    numbered = [c.select(F.lit(i).alias("ord"), "kind", "reference", "content") for i, c in enumerate(candidates)]
    every = reduce(lambda a, b: a.unionByName(b), numbered)
    firsts = every.groupBy("reference").agg(F.min("ord").alias("ord"))
    costed = every.join(firsts, ["reference", "ord"], "left_semi").withColumn("tokens", X.token_estimate(F.to_json(F.struct("kind", "reference", "content"))) + overhead)
    return fitted(costed.withColumn("_one", F.lit(0)), ["_one"], ["ord", "reference"], "tokens", budget).drop("_one")
