"""The HTTP clients against a server in this process."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from storyloom.sources import clients as C
from storyloom.sources.adapters import Rejected
from storyloom.sources.config import Service, load


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.0"
    documents: dict = {}
    refuse: list = []
    seen: list = []

    def log_message(self, *_):
        pass

    def answer(self, body, status=200, headers=()):
        self.send_response(status)
        for k, v in headers:
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

    def body(self):
        return json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")

    def any(self):
        asked = self.body()
        self.seen.append((self.command, self.path, asked, self.headers["Authorization"]))
        if self.refuse:
            status, after = self.refuse.pop(0)
            return self.answer({}, status, [("Retry-After", str(after))] if after is not None else [])
        if self.path == "/chat/completions":
            user = asked["messages"][1]["content"]
            if user == "slow":
                self.send_response(200)
                self.end_headers()
                self.wfile.write(b": wait\n")
                self.wfile.flush()
                time.sleep(2)
                return None
            said = "Yes." if "Answer with one of" in asked["messages"][0]["content"] else f"héllo {user}"
            lines = [f"data: {json.dumps({'choices': [{'delta': {'content': c}}]}, ensure_ascii=False)}\n\n" for c in said]
            return self.answer("".join([*lines, "data: [DONE]\n\n"]).encode())
        if self.path == "/embeddings":
            return self.answer({"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(asked["input"])))]})
        if self.path.startswith("/documents?"):
            page, size = (int(x.split("=")[1]) for x in self.path.split("?")[1].split("&"))
            return self.answer({"documents": sorted(self.documents.values(), key=lambda d: d["id"])[(page - 1) * size : page * size]})
        if self.path == "/documents":
            ident = f"d{len(self.documents):04d}"
            self.documents[ident] = {"id": ident, **asked}
            return self.answer({"id": ident})
        if self.path == "/search":
            return self.answer({"documents": [d for d in self.documents.values() if asked["query"] in d["content"]][: asked["limit"]]})
        ident = self.path.rsplit("/", 1)[1]
        if ident not in self.documents:
            return self.answer({}, 404)
        if self.command == "DELETE":
            del self.documents[ident]
            return self.answer(b"")
        self.documents[ident] |= asked
        return self.answer({})

    do_GET = do_POST = do_PUT = do_DELETE = any


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Service(f"http://127.0.0.1:{server.server_address[1]}/", "key", "model-1")
    server.shutdown()


def test_chat_is_streamed_and_tried_again(service):
    waits = []
    chat = C.ChatClient(service, sleep=waits.append)
    Handler.refuse[:] = [(429, 3), (503, None)]
    assert chat.complete("system", "there") == "héllo there" and waits[0] == 3 and len(waits) == 2
    _, _, asked, key = Handler.seen[-1]
    assert (asked["model"], asked["stream"], key) == ("model-1", True, "Bearer key")
    Handler.refuse[:] = [(400, None)]
    with pytest.raises(Rejected):
        chat.complete("system", "there")
    Handler.refuse[:] = [(500, None)] * 3
    with pytest.raises(Rejected):
        chat.complete("system", "there")
    with pytest.raises(C.TooSlow):
        C.ChatClient(service, idle_s=0.3).complete("system", "slow")


def test_embeddings_and_judge(service):
    assert C.EmbeddingClient(service, 2).embed(["a", "abc"]) == [[1.0, 0.0], [3.0, 0.0]]
    assert C.EmbeddingClient(service, 2).embed([]) == []
    with pytest.raises(ValueError):
        C.EmbeddingClient(service, 3).embed(["a"])
    assert C.JudgeClient(service).choose("is it so?", ["yes", "no"]) == "yes"


def test_knowledge_base_by_pages(service):
    base = C.KnowledgeClient(service)
    ids = [base.create(f"t{i}", f"text {i}") for i in range(205)]
    assert len(base.list(3)) == 5 and len(list(base.all())) == 205
    base.update(ids[0], "t", "changed")
    assert base.search("changed", 5)[0]["id"] == ids[0]
    base.delete(ids[0])
    base.delete(ids[0])
    assert len(list(base.all())) == 204


def test_clients_of_a_configuration():
    assert C.clients(load({})) == {}
    made = C.clients(load({"CHAT_URL": "http://x", "CHAT_KEY": "k", "CHAT_MODEL": "m", "KNOWLEDGE_URL": "http://y", "KNOWLEDGE_KEY": "k"}))
    assert made.keys() == {"chat", "knowledge"} and made["chat"].model == "m"
