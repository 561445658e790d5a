"""Dialogue candidates in paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.shared import pieces

# Fixed values.
PAIRS = {"“": "”", "「": "」", "『": "』", '"': '"'}
TERM_LENGTH = 16
SENTENCE_MARKS = "。！？!?；;，,：:"
TERM_BEFORE = "所谓 称作 叫做 名为 被称为 称为 作为 以 属于 类似于 理解成 统称为 提到了 标签 身份 术语 称呼 像极了 确实有 是一种 是一个".split()
TERM_AFTER = (
    "的身份 的意思 的概念 的说法 的名称 的定义 的区别 的原因 的地方 的问题 的称呼 的标志 的 里的 里 中的 中 上的 上 下的 下 内的 内 外的 外 之一 那种 这种 一样 而言 而不是"
).split()
SPEECH_AFTER = "说 道 问 答 喊 叫 骂 笑 想 嘀咕".split()


@dataclass(frozen=True)
class Quote:
    """A quoted utterance; the span includes the marks."""

    paragraph: int
    start: int
    end: int
    inner: str


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    if not text:
        return spans
    for line in text.split("\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    return spans


def is_term(text: str, paragraph: tuple[int, int], start: int, end: int, inner: str) -> bool:
    """A short quoted word inside narration, which stays narration."""
    if sum(1 + (c > "￿") for c in inner) > TERM_LENGTH or any(c in SENTENCE_MARKS for c in inner):
        return False
    before, after = text[paragraph[0] : start].rstrip(), text[end : paragraph[1]].lstrip()
    if not before or not after or before[-1] in "：:" or after.startswith(tuple(SPEECH_AFTER)):
        return False
    return before.endswith(tuple(TERM_BEFORE)) or after.startswith(tuple(TERM_AFTER))


def quotes_of(text: str, paragraphs: list[tuple[int, int]], terms: bool = False) -> list[Quote]:
    """Quotes in order. None crosses a paragraph; one that is not closed in its paragraph reaches its end."""
    opener = re.compile("[" + re.escape("".join(PAIRS)) + "]")
    found = []
    for i, (a, b) in enumerate(paragraphs):
        at = a
        while (m := opener.search(text, at, b)) is not None:
            close = text.find(PAIRS[m[0]], m.end(), b)
            end = b if close < 0 else close + 1
            inner = text[m.end() : b if close < 0 else close]
            if inner.strip() and (terms or close < 0 or not is_term(text, (a, b), m.start(), end, inner)):
                found.append(Quote(i, m.start(), end, inner))
            at = end
    return found


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("index", pa.int32()), ("paragraph", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("quote", pa.string()), ("inner", pa.string())]
    for b in pieces(batches):
        at, rows = [], []
        for k, text in enumerate(b.column(1).to_pylist()):
            text = text or ""
            found = [(i, q.paragraph, q.start, q.end, text[q.start : q.end], q.inner) for i, q in enumerate(quotes_of(text, paragraph_spans(text)))]
            at += [k] * len(found)
            rows += found
        columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
        yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), *columns], names=["key", *[n for n, _ in kinds]])


def quotes(chapters: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, index, paragraph, char_start, char_end, quote, inner; row by row, no shuffle."""
    kind = chapters.schema[key].dataType.simpleString()
    found = chapters.select(F.col(key).alias("key"), text).mapInArrow(_quotes, f"key {kind}, index int, paragraph int, char_start int, char_end int, quote string, inner string")
    return found.withColumnRenamed("key", key)
