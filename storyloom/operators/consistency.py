"""The consistency pass: chapter by chapter, what is known so far goes to a model, and what it proposes is kept only
where the text says it.

A book's chapters depend on one another, so a book is one ordered group and books run in parallel. For each chapter the
context holds the states that hold then, of entities that the chapter names first, and the threads that are open, as
many as a token budget takes. Every proposal needs a quote that stands in the chapter exactly once. The first chapter
that fails ends its book's pass; what came before it counts.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.facts import PROPOSALS, commit, memory
from storyloom.operators.passes import proposals
from storyloom.sources.adapters import ChatModel, ask_json

SYSTEM = "You keep the facts of a novel. Answer with one JSON object of states, relations, events and threads, each with a literal quote."
FOUND = f"{PROPOSALS}, error string"
#: Entities and open threads that a context holds at most, and tokens that a section costs beside its text.
MOST_ENTITIES, MOST_THREADS, OVERHEAD = 30, 20, 16


def _tokens(text: str) -> int:
    return sum(1 if c.isascii() else 2 for c in text) + OVERHEAD


def context_of(text: str, known: list[dict], budget: int) -> list[dict]:
    """What of the known facts goes along with a chapter: current states of entities it names, then open threads, newest first."""
    states = {(f["subject"], f["field"]): f for f in known if f["kind"] == "state"}
    named = list(dict.fromkeys(s for s, _ in states if s and s in text))[:MOST_ENTITIES]
    chosen = [f for (s, _), f in states.items() if s in named]
    chosen += [f for f in reversed(known) if f["kind"] == "thread"][:MOST_THREADS]
    out, used = [], 0
    for f in chosen:
        section = {k: f[k] for k in ("kind", "subject", "field", "value") if f.get(k) is not None}
        cost = _tokens(json.dumps(section, ensure_ascii=False))
        if used + cost <= budget:
            out.append(section)
            used += cost
    return out


def located(found: list[dict], text: str) -> tuple[list[dict], list[str]]:
    """Proposals with the place of their quotes, and why others have none."""
    fine, refused = [], []
    for f in found:
        at = text.find(f["quote"])
        if at < 0 or text.find(f["quote"], at + 1) >= 0:
            refused.append(f"{'not in the text' if at < 0 else 'not unique'}: {f['quote']}")
        else:
            fine.append(f | {"char_start": at, "char_end": at + len(f["quote"])})
    return fine, refused


def proposed(chapters: DataFrame, model: ChatModel, budget: int = 3000) -> DataFrame:
    """(book, chapter_id, chapter, text) -> located proposals, and a row with an error for each quote that was refused or
    chapter that failed."""
    names = [c.split()[0] for c in FOUND.split(", ")]

    def wrong(answer: object) -> str | None:
        try:
            proposals(answer)
        except ValueError as e:
            return str(e)
        return None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known: list[dict] = []
        out: list[dict] = []
        for book, ident, chapter, text in rows.sort_values("chapter")[["book", "chapter_id", "chapter", "text"]].itertuples(index=False):
            own = {"book": book, "chapter_id": ident, "chapter": int(chapter)}
            try:
                user = json.dumps({"known": context_of(text, known, budget), "chapter": text}, ensure_ascii=False)
                fine, refused = located(proposals(ask_json(model, SYSTEM, user, wrong)), text)
            except Exception as e:
                out.append(own | {"error": f"failed: {e}"})
                break
            fine = [own | f | {"fact_id": f"{ident}:{i}"} for i, f in enumerate(fine)]
            known += fine
            out += fine + [own | {"error": r} for r in refused] or [own | {"error": "nothing proposed"}]
        table = pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names, dtype=object)
        return table.astype({"chapter": "Int32", "char_start": "Int32", "char_end": "Int32", "confidence": "float64"})

    kind = ", ".join(f"{c.split()[0]} {c.split()[1]}" for c in FOUND.split(", "))
    return chapters.select("book", "chapter_id", "chapter", "text").groupBy("book").applyInPandas(run, kind)


def settled(found: DataFrame, texts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Proposals -> histories with memory, rule errors of proposals, and one row per chapter with its run's status."""
    fine = found.where("error is null").drop("error")
    parts, errors = commit(fine, texts)
    failed = F.max(F.col("error").startswith("failed: "))
    asked = found.groupBy("book", "chapter_id", "chapter").agg(F.coalesce(failed, F.lit(False)).alias("failed"), F.max(F.when(F.col("error").startswith("failed: "), F.col("error"))).alias("error"))
    broken = errors.groupBy("chapter_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    runs = asked.join(broken, "chapter_id", "left").select(
        "book",
        "chapter_id",
        "chapter",
        F.when(F.col("failed") | F.col("codes").isNotNull(), "failed").otherwise("succeeded").alias("status"),
        F.coalesce("error", F.array_join("codes", ",")).alias("error"),
    )
    return parts | {"memory": memory(parts)}, errors, runs

