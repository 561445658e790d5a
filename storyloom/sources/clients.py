"""The services behind the interfaces of ``adapters``, over HTTP with the standard library alone.

Chat and embeddings speak the widespread JSON interface of chat completions and embeddings; the judge asks a chat model
to pick one of some choices; the knowledge base is a plain collection of documents, listed by pages. Every call has a
deadline and is made again after refusals that may pass (adapters.with_retries).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from storyloom.sources.adapters import Rejected, streamed_text, with_retries
from storyloom.sources.config import Config, Service

PAGE = 100


class TooSlow(TimeoutError):
    """The service was silent too long, or did not end in time."""


@dataclass
class Caller:
    """JSON over HTTP to one service. idle_s bounds the silence between two pieces of an answer, total_s all of it."""

    service: Service
    idle_s: float = 60.0
    total_s: float = 600.0
    retries: int = 2
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def _lines(self, method: str, path: str, body: object | None) -> Iterator[str]:
        ends = time.monotonic() + self.total_s
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.service.url.rstrip("/") + path, data, {"Authorization": f"Bearer {self.service.key}", "Content-Type": "application/json"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=min(self.idle_s, self.total_s)) as answer:
                for line in answer:
                    if time.monotonic() > ends:
                        raise TooSlow(path)
                    yield line.decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After") if e.headers else None
            raise Rejected(e.code, float(after) if after and after.replace(".", "", 1).isdigit() else None) from e
        except TimeoutError as e:
            raise TooSlow(path) from e

    def text(self, method: str, path: str, body: object | None = None, streamed: bool = False) -> str:
        join = streamed_text if streamed else "".join
        return with_retries(lambda: join(self._lines(method, path, body)), self.retries, sleep=self.sleep)

    def json(self, method: str, path: str, body: object | None = None):
        told = self.text(method, path, body)
        return json.loads(told) if told.strip() else None


class ChatClient:
    """A chat model; the answer is streamed, so that a silent service is noticed."""

    def __init__(self, service: Service, **how):
        self.model, self.caller = service.model, Caller(service, **how)

    def complete(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return self.caller.text("POST", "/chat/completions", {"model": self.model, "stream": True, "messages": messages}, streamed=True)


class EmbeddingClient:
    """Vectors of texts, in the order of the texts; their number and length are checked."""

    def __init__(self, service: Service, dimension: int, **how):
        self.model, self.dimension, self.caller = service.model, dimension, Caller(service, **how)

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        found = sorted(self.caller.json("POST", "/embeddings", {"model": self.model, "input": texts})["data"], key=lambda x: x["index"])
        vectors = [x["embedding"] for x in found]
        if len(vectors) != len(texts) or any(len(v) != self.dimension for v in vectors):
            raise ValueError("the service gave other vectors than asked for")
        return vectors


class JudgeClient:
    """One of some choices by a chat model; an answer that is none of them counts as it is, for the caller to refuse."""

    def __init__(self, service: Service, **how):
        self.model, self.chat = service.model, ChatClient(service, **how)

    def choose(self, question: str, choices: list[str]) -> str:
        return self.chat.complete(f"Answer with one of: {', '.join(choices)}. Nothing else.", question).strip().strip(".").lower()


class KnowledgeClient:
    """Documents of a knowledge base: made, changed, deleted, listed by pages, searched."""

    def __init__(self, service: Service, **how):
        self.caller = Caller(service, **how)

    def create(self, title: str, content: str) -> str:
        return self.caller.json("POST", "/documents", {"title": title, "content": content})["id"]

    def update(self, ident: str, title: str, content: str) -> None:
        self.caller.json("PUT", f"/documents/{urllib.parse.quote(ident)}", {"title": title, "content": content})

    def delete(self, ident: str) -> None:
        try:
            self.caller.json("DELETE", f"/documents/{urllib.parse.quote(ident)}")
        except Rejected as e:
            if e.status != 404:  # what is gone already is gone
                raise

    def list(self, page: int, size: int = PAGE) -> list[dict]:
        return self.caller.json("GET", f"/documents?page={page}&size={size}")["documents"]

    def all(self) -> Iterator[dict]:
        page = 1
        while rows := self.list(page):
            yield from rows
            page += 1

    def search(self, text: str, limit: int) -> list[dict]:
        return self.caller.json("POST", "/search", {"query": text, "limit": limit})["documents"]


def clients(config: Config, dimension: int = 1024) -> dict[str, object]:
    """A client for every service that is configured."""
    makers = {"chat": ChatClient, "judge": JudgeClient, "embedding": lambda s: EmbeddingClient(s, dimension), "knowledge": KnowledgeClient}
    return {name: make(getattr(config, name)) for name, make in makers.items() if getattr(config, name)}
