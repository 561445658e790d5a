"""Tokenising and packing documents into fixed windows by the online sum-of-squares rule.

A task reads its documents as a stream. A document's token ids, ended by one id, fill whole windows first; what is
left over is placed at once, online: of all fill levels at which an open window can take the piece (level 0 is a
new window) it goes to the one that makes the sum over levels of the squared number of partially filled windows
smallest. A level array holds those counts, so a placement costs one vectorised pass over at most ``capacity``
levels, whatever the number of windows; the fullest of equally good levels is taken. Full windows are given out at
once. While open windows hold OPEN_BYTES of ids none is added: a piece that fits into none of them whole is cut at the
window of the level that holds most of them, which it fills, and what is left of it is placed by the rule again. So
the bound is one of memory (some thousands of windows, far more than a task's documents usually need), and the counts
that the rule squares are those of all that is open. When a task
ends, the pieces of its emptiest windows are placed into the others in the same way until one is left, so at most
one window a task stays partial. Documents are never shuffled.

Ids are those that the ``tokenizers`` library gives for the file, with its defaults and no special tokens added (so
the string of an added token in a text is that token). They are made by ``tiktoken`` from the same file's
vocabulary (a byte-level vocabulary's ids are its merge ranks), which is several times faster on prose whose words
seldom repeat; tests hold both libraries' ids against each other. A very long text is tokenised in parts, cut
before a single space between other characters, where no token reaches across.

Defined results: null text counts as empty, and an empty document is the end id alone; null ids stay null; repeated
rows are packed each; an empty table gives an empty result; columns other than the id and the text play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import prepare, raw, rows_of

CAPACITY = 2048
END_ID = 1
#: Bytes of ids that a task's open windows hold before it cuts pieces.
OPEN_BYTES = 16 << 20
#: Characters tokenised at once.
CHARS = 1 << 20
#: Unicode's White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places before which a text can be cut without changing its tokens.
CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, object] = {}


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """text -> ids, by the vocabulary of a tokenizers file."""
    if path not in _encoders:
        import tiktoken

        told = json.loads(Path(path).read_text(encoding="utf-8"))
        kind = (told["model"]["type"], (told.get("pre_tokenizer") or {}).get("type"), told.get("normalizer"))
        if kind != ("BPE", "ByteLevel", None) or told["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        added = {x["content"]: x["id"] for x in told["added_tokens"]}
        if any(x[flag] for x in told["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")) or any(c.isspace() for x in added for c in x):
            raise ValueError(f"{path} has added tokens that are no plain strings")
        of = byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
        made = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        _encoders[path] = partial(made.encode, allowed_special=set(added)) if added else made.encode_ordinary
    return _encoders[path]


def split_text(text: str) -> Iterator[str]:
    """Parts of about CHARS characters whose units are those of the whole."""
    at = 0
    while len(text) - at > CHARS and (m := CUT.search(text, at + CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_bytes(text: str, path: str) -> bytes:
    """The text's ids as little-endian unsigned 32-bit numbers."""
    encode = encoder(path)
    return b"".join(np.array(encode(part), "<u4").tobytes() for part in split_text(text))


def ids_of(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[tuple, bytes]]:
    """((id, carried columns), ids with the end) of each (text, id, carried columns)."""
    end = np.array([end_id], "<u4").tobytes()
    for b in rows_of(batches):
        for text, *own in zip(raw(b.column(0)), *(c.to_pylist() for c in b.columns[1:]), strict=True):
            yield tuple(own), token_bytes(text.decode("utf-8", "replace"), path) + end


class Levels:
    """Open windows by fill level, and the sum-of-squares rule over their counts."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # partial windows at each level; 0 and capacity stay 0
        self.windows: list[list[list]] = [[] for _ in range(capacity)]
        self.open = self.ids = 0  # windows that are open, and the ids in them

    def best(self, size: int, new: bool = True) -> int | None:
        """The level whose choice makes the sum of squared counts smallest, the fullest of equals; 0 is a new window,
        None if no window can take the size and none may be added."""
        n, top, never = self.count, self.capacity - size, np.iinfo(np.int64).max
        # (n[h] - 1)^2 - n[h]^2 + (n[h + size] + 1)^2 - n[h + size]^2, without the end terms' missing parts
        cost = 2 * (n[size:] - n[: top + 1]) + 2
        cost[0] -= 1  # no window leaves level 0
        cost[top] -= 1  # a full window is not partial
        cost[1:][n[1 : top + 1] == 0] = never
        if not new:
            cost[0] = never
        found = top - int(np.argmin(cost[::-1]))
        return None if cost[found] == never else found

    def take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        self.ids -= level
        return self.windows[level].pop()

    def place(self, piece: tuple, new: bool = True) -> Iterator[list]:
        """Put a piece (doc, start, ids, doc_tokens) smaller than a window where the rule says, cut if no window may
        be added and none takes it whole; the windows that this fills."""
        doc, start, ids, total = piece
        new, size = new or not self.open, len(ids) // 4
        while (level := self.best(size, new)) is None:
            # Of the windows that are too full, one of the commonest level (the fullest of equals) is filled up.
            few = self.capacity - size + 1
            level = self.capacity - 1 - int(np.argmax(self.count[few : self.capacity][::-1]))
            room = self.capacity - level
            yield [*self.take(level), (doc, start, ids[: 4 * room], total)]
            start, ids, size, new = start + room, ids[4 * room :], size - room, new or not self.open
        window = [*(self.take(level) if level else []), (doc, start, ids, total)]
        if level + size == self.capacity:
            yield window
            return
        self.windows[level + size].append(window)
        self.count[level + size] += 1
        self.open += 1
        self.ids += level + size

    def finish(self) -> Iterator[list]:
        """Place the pieces of the emptiest windows into the others until one is left."""
        while self.open > 1:
            for piece in self.take(int(np.flatnonzero(self.count)[0])):
                yield from self.place(piece, new=False)
        if self.open:
            yield self.take(int(np.flatnonzero(self.count)[0]))


def pack_stream(docs: Iterator[tuple[object, bytes]], capacity: int, open_bytes: int | None = None) -> Iterator[list[tuple]]:
    """Windows of pieces (doc, start, ids, doc_tokens), each given out when it can take no more."""
    levels, step, most = Levels(capacity), 4 * capacity, OPEN_BYTES if open_bytes is None else open_bytes
    for doc, ids in docs:
        total = len(ids) // 4
        whole = total // capacity * step
        for at in range(0, whole, step):
            yield [(doc, at // 4, ids[at : at + step], total)]
        if whole < len(ids):
            yield from levels.place((doc, whole // 4, ids[whole:], total), new=4 * levels.ids < most)
    yield from levels.finish()


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, carried: list[str]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        names = ("doc_id", *carried, "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        kinds = [pa.binary() if n == "ids" else pa.string() if n in carried else pa.int64() for n in names]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for window in pack_stream(ids_of(batches, path, end_id), capacity):
        offset = 0
        for doc, start, ids, total in window:
            rows.append((*doc, start, len(ids) // 4, ids, total, number, offset))
            offset += len(ids) // 4
        number += 1
        if len(rows) >= 1000:
            yield batch()
            rows = []
    if rows:
        yield batch()


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, the carried columns of its document as text, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. Carried columns have names that no other column has."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(carry)])
    first, rest = PIECES.split(", ", 1)
    schema = ", ".join([first, *[f"`{c}` string" for c in carry], rest])
    return plain.mapInArrow(partial(_pack, path=tokenizer_path, capacity=capacity, end_id=end_id, carried=list(carry)), schema)
