"""Checks of a chapter's parse and of batches of facts. Each gives rows (keys, code, path, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import sliced
from storyloom.operators.spans import partition_errors

CODES = ("IR-LENGTH", "IR-SCENE-PARTITION", "IR-SEG-COVER", "IR-UNIQUE", "IR-REF", "IR-SEG-SCENE", "IR-DIALOGUE-SPEAKER", "IR-MENTION-EVIDENCE", "IR-RANGE")


def _rows(found: DataFrame, code: str, path: Column, message: str) -> DataFrame:
    return found.select("chapter_id", F.lit(code).alias("code"), path.cast("string").alias("path"), F.lit(message).alias("message"))


def _at(kind: str, index: str = "index") -> Column:
    return F.concat(F.lit(f"{kind}["), F.col(index).cast("string"), F.lit("]"))


def chapter_errors(chapters: DataFrame, scenes: DataFrame, segments: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """All rules over many chapters at once.

    chapters: chapter_id, char_count, text. scenes: chapter_id, id, index, char_start, char_end, character_ids.
    segments: chapter_id, id, scene_id, index, kind, char_start, char_end, entity_id, surface, confidence.
    entities: chapter_id, id, confidence. mentions: chapter_id, index, entity_id, surface, char_start, char_end.
    """
    sizes = chapters.select("chapter_id", "char_count")
    out = [_rows(chapters.where(F.length("text") != F.col("char_count")), "IR-LENGTH", F.lit("char_count"), "differs from the text's length")]
    for kind, code, items in (("scenes", "IR-SCENE-PARTITION", scenes), ("segments", "IR-SEG-COVER", segments)):
        broken = partition_errors(items.join(sizes, "chapter_id"), ["chapter_id"], F.col("char_count"), code)
        out.append(broken.select("chapter_id", "code", _at(kind).alias("path"), "message"))
        missing = sizes.where("char_count > 0").join(items.select("chapter_id").distinct(), "chapter_id", "left_anti")
        out.append(_rows(missing, code, F.lit(kind), "covers nothing"))
        twice = items.withColumn("n", F.count("*").over(Window.partitionBy("chapter_id", "id"))).where("n > 1")
        out.append(_rows(twice, "IR-UNIQUE", _at(kind), "id occurs more than once"))
    doubled = entities.groupBy("chapter_id", "id").count().where("count > 1")
    out.append(_rows(doubled, "IR-UNIQUE", F.concat(F.lit("entities."), F.col("id")), "id occurs more than once"))

    of_entity = entities.select("chapter_id", F.col("id").alias("entity_id")).distinct()
    out.append(_rows(segments.where("entity_id is not null").join(of_entity, ["chapter_id", "entity_id"], "left_anti"), "IR-REF", _at("segments"), "no such entity"))
    out.append(_rows(mentions.join(of_entity, ["chapter_id", "entity_id"], "left_anti"), "IR-REF", _at("mentions"), "no such entity"))
    cast = scenes.select("chapter_id", "index", F.explode("character_ids").alias("entity_id"))
    out.append(_rows(cast.join(of_entity, ["chapter_id", "entity_id"], "left_anti"), "IR-REF", _at("scenes"), "no such entity"))
    spans = scenes.select("chapter_id", F.col("id").alias("scene_id"), F.col("char_start").alias("s_start"), F.col("char_end").alias("s_end"))
    placed = segments.join(spans, ["chapter_id", "scene_id"], "left")
    out.append(_rows(placed.where("s_start is null"), "IR-REF", _at("segments"), "no such scene"))
    out.append(_rows(placed.where("char_start < s_start or char_end > s_end"), "IR-SEG-SCENE", _at("segments"), "reaches beyond its scene"))

    nobody = "kind <> 'narration' and entity_id is null and surface is null"
    out.append(_rows(segments.where(nobody), "IR-DIALOGUE-SPEAKER", _at("segments"), "speech without a speaker"))
    texts = mentions.join(chapters.select("chapter_id", "text"), "chapter_id")
    bounds = (F.col("char_start") < 0) | (F.col("char_end") > F.length("text")) | (F.col("char_start") >= F.col("char_end"))
    wrong = bounds | (sliced(F.col("text"), F.col("char_start"), F.col("char_end")) != F.col("surface"))
    out.append(_rows(texts.where(wrong), "IR-MENTION-EVIDENCE", _at("mentions"), "the text does not say so"))
    outside = "confidence is not null and (isnan(confidence) or confidence < 0 or confidence > 1)"
    out.append(_rows(segments.where(outside), "IR-RANGE", _at("segments"), "confidence outside 0 to 1"))
    out.append(_rows(entities.where(outside), "IR-RANGE", F.concat(F.lit("entities."), F.col("id")), "confidence outside 0 to 1"))
    return reduce(lambda a, b: a.unionByName(b), out)


def fact_errors(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Proposed facts (fact_id, kind, chapter_id, subject, field, object, value, confidence, char_start, char_end, quote)
    that break a rule: empty fields, confidence, duplicates within a batch, evidence that the text does not show."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    key = F.when(F.col("kind") == "state", F.struct("kind", "subject", "field")).otherwise(F.struct("kind", "subject", F.col("object").alias("field")))
    same = F.count("*").over(Window.partitionBy("chapter_id", key))
    joined = facts.join(texts.select("chapter_id", "text"), "chapter_id", "left").withColumn("same", same)
    shown = sliced(F.col("text"), F.col("char_start"), F.col("char_end")) == F.col("quote")
    bad = F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1)
    found = F.array(
        F.when(blank("subject") | (blank("field") & blank("object")), F.lit("FACT-EMPTY")),
        F.when(bad, F.lit("FACT-CONFIDENCE")),
        F.when(F.col("same") > 1, F.lit("FACT-DUPLICATE")),
        F.when(F.col("text").isNull(), F.lit("FACT-SCOPE")),
        F.when(F.col("text").isNotNull() & ~F.coalesce(shown, F.lit(False)), F.lit("FACT-EVIDENCE")),
    )
    return joined.select("fact_id", "chapter_id", F.explode(F.array_compact(found)).alias("code"))


LOW_CONFIDENCE = 0.6


def for_review(facts: DataFrame) -> DataFrame:
    """States and relations below the threshold, by the double they came with."""
    return facts.where(F.col("kind").isin("state", "relation") & (F.col("confidence") < LOW_CONFIDENCE))


def whole(value: Column, low: int, high: int) -> Column:
    """A whole number between two bounds; null is none."""
    number = value.cast("double")
    return F.coalesce((number == F.floor(number)) & number.between(low, high), F.lit(False))


def finite(value: Column) -> Column:
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def finding(error: Column, confidence: Column, verdict: Column) -> Column:
    """Whether a second judge's answer is worth a look: it failed, was unsure, or does not support the first."""
    return F.coalesce(error, F.lit(False)) | F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False)) | F.coalesce(verdict.isin("uncertain", "contradicts", "insufficient"), F.lit(False))


def interval_errors(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Alias intervals that cannot be: no start, or an end that is not after it."""
    code = F.when(F.col(start).isNull(), "no start").when(F.col(end) <= F.col(start), "ends before it starts")
    return rows.withColumn("code", code).where("code is not null")
