"""Passes that ask a model: structure with a chat model, consistency with evidence, judging in shadow, revisions.

Models are interfaces (storyloom.sources.adapters); what they answer is checked here and never trusted.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.attribution import UNKNOWN, Attributor
from storyloom.operators.quotes import paragraph_spans, quotes_of
from storyloom.shared import pieces, shuffle_width
from storyloom.sources.adapters import ChatModel, Judge, ask_json

# Fixed values.
ENTITY_TYPES = "character location organization item skill realm species concept event".split()
SYNONYMS = {
    "人物": "character", "角色": "character", "人": "character", "person": "character", "people": "character", "char": "character",
    "地点": "location", "地名": "location", "场所": "location", "地方": "location", "place": "location",
    "组织": "organization", "势力": "organization", "宗门": "organization", "门派": "organization", "org": "organization",
    "物品": "item", "道具": "item", "武器": "item", "object": "item",
    "技能": "skill", "功法": "skill", "招式": "skill", "ability": "skill",
    "境界": "realm", "等级": "realm", "level": "realm",
    "种族": "species", "race": "species",
    "概念": "concept", "术语": "concept",
    "事件": "event",
}
EMOTIONS = "calm happy angry sad fear surprise teasing contempt anxious tender cold excited".split()
KINDS = ("dialogue", "thought", "narration")
JUDGED_AT_ONCE = 8
EXCERPT = 180


def entity_type(raw: str | None) -> str | None:
    """The closed vocabulary's word for what a model said, or None."""
    word = (raw or "").strip().lower()
    return word if word in ENTITY_TYPES else SYNONYMS.get(word)


class ChatAttributor:
    """Speakers by a chat model; quotes it leaves out or invents become warnings, and rules fill nothing in."""

    version = "chat/1"
    SYSTEM = "You attribute quoted speech in a novel to its speakers. Answer with one JSON object."

    def __init__(self, model: ChatModel):
        self.model, self.name = model, model.model

    def prompt(self, text: str, quotes: list, known: list[str]) -> str:
        asked = [{"id": f"q{i}", "quote": q.inner, "before": text[max(0, q.start - EXCERPT) : q.start], "after": text[q.end : q.end + EXCERPT]} for i, q in enumerate(quotes)]
        return json.dumps({"known": known, "quotes": asked, "answer": {"attributions": [{"id": "q0", "kind": "|".join(KINDS), "speaker": "name or null", "confidence": "0 to 1"}]}}, ensure_ascii=False)

    def attribute(self, text: str, known: list[str]) -> tuple[list[dict], list[str]]:
        """One row per quote: quote, kind, speaker, confidence, emotion; and warnings."""
        quotes = quotes_of(text, paragraph_spans(text))
        if not quotes:
            return [], []

        def wrong(x) -> str | None:
            if not isinstance(x, dict) or not isinstance(x.get("attributions"), list):
                return "attributions must be a list"
            return None if all(isinstance(a, dict) and isinstance(a.get("id"), str) for a in x["attributions"]) else "every attribution needs an id"

        told = {a["id"]: a for a in ask_json(self.model, self.SYSTEM, self.prompt(text, quotes, known), wrong)["attributions"]}
        ids = {f"q{i}" for i in range(len(quotes))}
        warnings = [f"unknown quote {i}" for i in sorted(told.keys() - ids)] + [f"no answer for {i}" for i in sorted(ids - told.keys())]
        out = []
        for i, q in enumerate(quotes):
            a = told.get(f"q{i}", {})
            sure = a.get("confidence")
            sure = min(1.0, max(0.0, float(sure))) if isinstance(sure, (int, float)) and sure == sure else 0.0
            speaker = a.get("speaker") if isinstance(a.get("speaker"), str) and a["speaker"].strip() else None
            emotion = a.get("emotion") if a.get("emotion") in EMOTIONS else None
            out.append({"quote": i, "char_start": q.start, "char_end": q.end, "kind": a.get("kind") if a.get("kind") in KINDS else "dialogue", "speaker": speaker or UNKNOWN, "confidence": sure if speaker else 0.0, "emotion": emotion})
        return out, warnings


class RuleAttributor:
    """The rules behind the same interface."""

    name, version = Attributor.name, Attributor.version
    #: Whether it costs nothing to ask twice.
    repeatable = True

    def attribute(self, text: str, known: list[str]) -> tuple[list[dict], list[str]]:
        paragraphs = paragraph_spans(text)
        quotes = quotes_of(text, paragraphs)
        said = Attributor(text, paragraphs, quotes, {n: n for n in known}).speakers()
        return [{"quote": i, "char_start": q.start, "char_end": q.end, "kind": "dialogue", "speaker": s.surface or UNKNOWN, "confidence": s.confidence, "emotion": None} for i, (q, s) in enumerate(zip(quotes, said, strict=True))], []


ATTRIBUTORS = {"heuristic": lambda model: RuleAttributor(), "chat": ChatAttributor}


def attributor(name: str, model: ChatModel | None = None):
    if name not in ATTRIBUTORS or (name == "chat" and model is None):
        raise ValueError(f"no attributor {name!r}" if name not in ATTRIBUTORS else "a chat attributor needs a model")
    return ATTRIBUTORS[name](model)


ATTRIBUTED = "chapter_id string, quote int, char_start int, char_end int, kind string, speaker string, confidence double, emotion string, error string"
ATTRIBUTED_KINDS = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in ATTRIBUTED.split(", ")])


def attributed(chapters: DataFrame, by, known: list[str]) -> DataFrame:
    """(chapter_id, text) -> its attributions; a chapter that fails is a row with its error, and no others stop. A column
    ``earlier`` has further names that are known in the chapter. Chapters are dealt out, since a model's calls take long
    and many chapters may lie in one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for told in b.to_pylist():
                try:
                    every = list(dict.fromkeys([*known, *(told.get("earlier") or ())]))
                    rows += [{"chapter_id": told["chapter_id"], **r, "error": None} for r in by.attribute(told["text"] or "", every)[0]]
                except Exception as e:
                    rows.append({"chapter_id": told["chapter_id"], "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=ATTRIBUTED_KINDS)

    dealt = chapters.repartition(shuffle_width(chapters.sparkSession), "chapter_id")
    return dealt.select(F.col("chapter_id").cast("string").alias("chapter_id"), F.col("text").cast("string").alias("text"), *[c for c in chapters.columns if c == "earlier"]).mapInArrow(run, ATTRIBUTED)


FACT_KINDS = ("state", "relation", "event", "thread")


def proposals(answer: object) -> list[dict]:
    """Facts out of a model's answer: lists by kind, each entry with its evidence; anything malformed is refused."""
    if not isinstance(answer, dict) or set(answer) - {f"{k}s" for k in FACT_KINDS} - {"resolved"}:
        raise ValueError("expected an object of states, relations, events, threads, resolved")
    out = []
    for kind in FACT_KINDS:
        for i, x in enumerate(answer.get(f"{kind}s", [])):
            if not isinstance(x, dict) or not isinstance(x.get("quote"), str) or not x["quote"]:
                raise ValueError(f"{kind} {i} has no quote")
            out.append({"kind": kind, **{k: x.get(k) for k in ("subject", "field", "object", "value", "quote", "story_time")}, "confidence": float(x.get("confidence", 1.0))})
    return out


def judged(candidates: DataFrame, judge: Judge, question: str, choices: list[str]) -> DataFrame:
    """candidates (chapter_id, seq, claim, context) with the judge's choice, JUDGED_AT_ONCE at a time; facts are not
    touched. A batch whose call fails is marked with its error. claim_hash binds a choice to what was judged."""
    group = F.floor((F.row_number().over(Window.partitionBy("chapter_id").orderBy("seq")) - 1) / JUDGED_AT_ONCE)

    def asked(claims: list[dict]) -> list[tuple[str | None, str | None]]:
        """(choice, error) of each claim of a batch."""
        try:
            told = [judge.choose(f"{question}\n{c['claim']}\n{c['context']}", choices) for c in claims]
            return [(x if x in choices else "uncertain", None) for x in told]
        except Exception as e:
            return [(None, str(e))] * len(claims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            claims = b.column(1).to_pylist()
            at = [i for i, x in enumerate(claims) for _ in x]
            every = [c for x in claims for c in x]
            told = [t for x in claims for t in asked(x)]
            columns = [pa.array([c["seq"] for c in every], pa.int64()), *[pa.array(x, pa.string()) for x in ([c["claim_hash"] for c in every], [t[0] for t in told], [t[1] for t in told])]]
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *columns], names=["chapter_id", "seq", "claim_hash", "choice", "error"])

    kind = candidates.schema["chapter_id"].dataType.simpleString()
    bound = candidates.withColumn("claim_hash", claim_hash(F.col("claim"), F.col("context"))).withColumn("batch", group)
    one = F.struct(F.col("seq").cast("long").alias("seq"), "claim", "context", "claim_hash")
    together = bound.groupBy("chapter_id", "batch").agg(F.sort_array(F.collect_list(one)).alias("claims"))  # JUDGED_AT_ONCE at most
    return together.select("chapter_id", "claims").mapInArrow(run, f"chapter_id {kind}, seq long, claim_hash string, choice string, error string")


def claim_hash(claim: Column, context: Column) -> Column:
    return F.sha2(F.to_json(F.struct(claim.alias("claim"), context.alias("context"))), 256)


def still_judged(reviews: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reviews of claims that are still what was judged; those of changed or withdrawn ones count no more."""
    now = candidates.select("chapter_id", "seq", claim_hash(F.col("claim"), F.col("context")).alias("claim_hash"))
    return reviews.join(now, ["chapter_id", "seq", "claim_hash"], "left_semi")


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


@dataclass
class Revision:
    """One step of a preview's audit chain: what it was, what was done to it, what it became."""

    parent: str
    hash: str
    changes: list[dict]


class Stale(ValueError):
    """The preview is not the one that was meant."""


def revise(preview: dict, based_on: str, changes: list[dict]) -> tuple[dict, Revision]:
    """The preview with facts replaced or removed: changes are {index, fact} or {index, fact: None}, and hold what was
    there, so that they can be undone."""
    if digest(preview) != based_on:
        raise Stale(based_on)
    facts, done = list(preview["facts"]), []
    if len({c["index"] for c in changes}) != len(changes) or any(not 0 <= c["index"] < len(facts) for c in changes):
        raise ValueError("a change names no fact, or one twice")
    for c in sorted(changes, key=lambda c: -c["index"]):
        at = c["index"]
        done.append({"index": at, "before": facts[at], "after": c["fact"]})
        if c["fact"] is None:
            del facts[at]
        else:
            facts[at] = c["fact"]
    made = preview | {"facts": facts}
    return made, Revision(based_on, digest(made), done)


def reversed_revision(preview: dict, revision: Revision) -> dict:
    """What the preview was before the revision."""
    if digest(preview) != revision.hash:
        raise Stale(revision.hash)
    facts = list(preview["facts"])
    for c in reversed(revision.changes):
        if c["after"] is None:
            facts.insert(c["index"], c["before"])
        else:
            facts[c["index"]] = c["before"]
    back = preview | {"facts": facts}
    if digest(back) != revision.parent:
        raise Stale(revision.parent)
    return back


def chain_holds(preview: dict, revisions: list[Revision]) -> bool:
    """Whether the revisions lead to the preview, each from the one before."""
    hashes = [r.hash for r in revisions]
    return not revisions or (hashes[-1] == digest(preview) and all(b.parent == a for a, b in zip(hashes, revisions[1:], strict=False)))
