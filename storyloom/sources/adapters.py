"""Interfaces to services outside, each with an offline stand-in. Batches go in and come out as DataFrames or lists."""

from __future__ import annotations

import hashlib
import json
import math
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    model: str

    def complete(self, system: str, user: str) -> str: ...


class Judge(Protocol):
    model: str

    def choose(self, question: str, choices: list[str]) -> str: ...


class KnowledgeBase(Protocol):
    def create(self, title: str, content: str) -> str: ...
    def update(self, ident: str, title: str, content: str) -> None: ...
    def delete(self, ident: str) -> None: ...
    def list(self, page: int, size: int) -> list[dict]: ...
    def search(self, text: str, limit: int) -> list[dict]: ...


@dataclass
class HashEmbedder:
    """Signed character-pair hashes, scaled to length 1; the same text always gives the same vector."""

    dimension: int = 64
    model: str = "hash/1"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for a, b in zip(t, t[1:] + " ", strict=False):
                h = int.from_bytes(hashlib.blake2b((a + b).encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1 if h >> 63 else -1
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


@dataclass
class ScriptedModel:
    """Answers from a list or a function; for tests and offline runs."""

    answers: list[str] | Callable[[str, str], str]
    model: str = "scripted"

    def complete(self, system: str, user: str) -> str:
        return self.answers(system, user) if callable(self.answers) else self.answers.pop(0)


@dataclass
class FirstChoice:
    model: str = "first"

    def choose(self, question: str, choices: list[str]) -> str:
        return choices[0]


@dataclass
class MemoryKnowledgeBase:
    """A knowledge base in memory, listed by pages."""

    rows: dict[str, dict] = field(default_factory=dict)

    def create(self, title: str, content: str) -> str:
        ident = f"kb_{hashlib.sha256(f'{title}|{content}|{len(self.rows)}'.encode()).hexdigest()[:16]}"
        self.rows[ident] = {"id": ident, "title": title, "content": content}
        return ident

    def update(self, ident: str, title: str, content: str) -> None:
        self.rows[ident] |= {"title": title, "content": content}

    def delete(self, ident: str) -> None:
        self.rows.pop(ident, None)

    def list(self, page: int, size: int = 100) -> list[dict]:
        return sorted(self.rows.values(), key=lambda r: r["id"])[(page - 1) * size : page * size]

    def search(self, text: str, limit: int) -> list[dict]:
        terms = set(text.lower().split())
        hits = [r | {"score": float(sum(t in r["content"].lower() for t in terms))} for r in self.rows.values()]
        return sorted((h for h in hits if h["score"]), key=lambda h: (-h["score"], h["id"]))[:limit]


class Rejected(RuntimeError):
    """A call that may succeed when made again."""

    def __init__(self, status: int, retry_after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


RETRIED = {408, 429, 500, 502, 503, 504, 529}


def with_retries(call: Callable[[], str], retries: int = 2, base_s: float = 1.0, most_s: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Again after 408, 429 and server errors, at growing distances or when the service asks to."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Rejected as e:
            if e.status not in RETRIED or attempt == retries:
                raise
            sleep(min(most_s, e.retry_after if e.retry_after is not None else base_s * 2**attempt * (1 + random.random() / 10)))
    raise AssertionError


def streamed_text(events: Iterator[str]) -> str:
    """The text of a completion that came as server-sent events."""
    out = []
    for line in events:
        if line.startswith("data:") and (told := line[5:].strip()) and told != "[DONE]":
            out += [c["delta"].get("content") or "" for c in json.loads(told).get("choices", []) if "delta" in c]
    return "".join(out)


def bare_json(answer: str):
    """The JSON in an answer, with or without a code fence around it."""
    body = answer.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[1].rsplit("```", 1)[0]
    return json.loads(body)


def ask_json(model: ChatModel, system: str, user: str, check: Callable[[object], str | None]) -> object:
    """A JSON answer that passes check (which says what is wrong); one more try for bad JSON and one for a bad answer."""
    prompt, tries = user, {"json": 1, "check": 1}
    while True:
        answer = model.complete(system, prompt)
        try:
            found = bare_json(answer)
        except ValueError as e:
            if not tries["json"]:
                raise
            tries["json"] -= 1
            prompt = f"{user}\n\nThe last answer was no JSON ({e}). Answer with JSON only."
            continue
        wrong = check(found)
        if wrong is None:
            return found
        if not tries["check"]:
            raise ValueError(wrong)
        tries["check"] -= 1
        prompt = f"{user}\n\nThe last answer was refused: {wrong}."


def embedded(rows: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """key, model, content_hash, embedding; batches are sent by the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                yield pd.DataFrame({"key": part["key"], "content_hash": part["content_hash"], "embedding": embedder.embed(part["text"].tolist())})

    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(F.col(key).alias("key"), F.sha2(text, 256).alias("content_hash"), F.col(text).alias("text"))
    made = asked.mapInPandas(run, f"key {kind}, content_hash string, embedding array<float>")
    return made.select(F.col("key").alias(key), F.lit(embedder.model).alias("model"), "content_hash", "embedding")
