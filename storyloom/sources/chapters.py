"""Lines of a book to volumes and chapters."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.headings import Heading, completed, heading_of_label, parse_heading, same_heading
from storyloom.shared import pieces
from storyloom.sources.lines import LAYOUT_LINES, LAYOUT_SHARE, plain_lines

# Fixed values.
BOOK_FRONT, VOLUME_FRONT = "前言", "卷首语"
STRAY_LINES = 2


@dataclass
class Open:
    """The chapter that lines are being added to."""

    kind: str = "front_matter"
    heading: Heading | None = None
    volume: int | None = None
    waits: bool = False
    lines: list[str] = field(default_factory=list)


class Splitter:
    """Walks a book's lines. Boundaries of a table of contents open parts before their line is placed."""

    def __init__(self, stand_out: bool):
        self.stand_out = stand_out
        self.volumes: list[Heading] = []
        self.chapters: list[dict] = []
        self.repeated: Counter[str] = Counter()
        self.empty: list[str] = []
        self.open = Open()

    def close(self) -> None:
        now = self.open
        if not now.lines:
            if now.heading is not None and now.kind != "front_matter":
                self.empty.append(now.heading.raw)
            return
        text = "\n".join(now.lines)
        title = now.heading.title if now.heading else None
        if title is None and now.kind == "front_matter":
            title = BOOK_FRONT if now.volume is None else VOLUME_FRONT
        self.chapters.append(
            {
                "index": len(self.chapters),
                "kind": now.kind,
                "number": now.heading.number if now.heading else None,
                "title": title,
                "heading_raw": now.heading.raw if now.heading else None,
                "volume_index": now.volume,
                "text": text,
                "content_hash": hashlib.sha256(text.encode()).hexdigest(),
            }
        )

    def begin(self, heading: Heading, waits: bool = False) -> None:
        self.close()
        if heading.kind == "volume":
            self.volumes.append(heading)
            self.open = Open(volume=len(self.volumes) - 1)
        else:
            self.open = Open(heading.kind, heading, len(self.volumes) - 1 if self.volumes else None, waits)

    def add(self, text: str, indented: bool, boundaries: list[tuple[str, bool]]) -> None:
        now = self.open
        if boundaries:
            for label, has_children in boundaries:
                heading = heading_of_label(label, has_children)
                self.begin(heading, True)
            if not same_heading(text, heading):
                self.open.lines.append(text)
            elif heading.kind != "volume":
                self.open.heading, self.open.waits = completed(heading, text), False
            return
        if now.waits and len(now.lines) <= STRAY_LINES and same_heading(text, now.heading):
            now.heading, now.waits = completed(now.heading, text), False
            return
        heading = parse_heading(text, self.stand_out and not indented)
        if heading is None:
            now.lines.append(text)
        elif heading.kind == "chapter" and now.heading and now.heading.kind == "chapter" and heading.number == now.heading.number and heading.number is not None:
            self.repeated[heading.raw] += 1  # a page break's repetition of the open chapter's heading
            now.lines.append(text)
        else:
            self.begin(heading)


def split_chapters(lines: list[tuple[str, bool, list[tuple[str, bool]]]], indented_body: bool) -> Splitter:
    """(text, indented, boundaries) in order -> volumes, chapters, repeated and empty headings."""
    walk = Splitter(indented_body)
    for line in lines:
        walk.add(*line)
    walk.close()
    return walk


CHAPTERS = "path string, index int, kind string, number int, title string, heading_raw string, volume_index int, volume_title string, text string, content_hash string, warnings string"


NAMES = [c.split()[0] for c in CHAPTERS.split(", ")]


def _rows(path: str, found: Splitter) -> list[dict]:
    """A book's chapters as rows."""
    notes = [f"repeated:{k}:{n}" for k, n in found.repeated.items()] + [f"empty:{k}" for k in found.empty]
    warnings = json.dumps(notes, ensure_ascii=False)
    volume = lambda c: None if c["volume_index"] is None else found.volumes[c["volume_index"]].raw
    return [{"path": path, **c, "volume_title": volume(c), "warnings": warnings} for c in found.chapters]


def _split(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("line_no")
    told = [[(b["label"], bool(b["has_children"])) for b in x] if x is not None and len(x) else [] for x in rows["boundaries"]]
    found = split_chapters(list(zip(rows["text"], rows["indented"], told, strict=True)), bool(rows["indented_body"].iloc[0]))
    return pd.DataFrame(_rows(rows["path"].iloc[0], found), columns=NAMES).astype({"number": "Int32", "volume_index": "Int32"})


def chapters(numbered: DataFrame, layout: DataFrame) -> DataFrame:
    """Lines (path, line_no, text, indented[, boundaries]) -> chapters. A book's lines are walked in order by one task."""
    if "boundaries" not in numbered.columns:
        numbered = numbered.withColumn("boundaries", F.array().cast("array<struct<label:string,has_children:boolean>>"))
    return numbered.join(layout, "path").groupBy("path").applyInPandas(_split, CHAPTERS)


def _split_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in CHAPTERS.split(", ")]
    for b in pieces(batches):
        out = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = plain_lines(text or "")
            if found:
                body = len(found) >= LAYOUT_LINES and sum(i for _, i in found) / len(found) >= LAYOUT_SHARE
                out += _rows(path, split_chapters([(t, i, []) for t, i in found], body))
        yield pa.record_batch([pa.array([r[n] for r in out], kind) for n, kind in zip(NAMES, kinds, strict=True)], names=NAMES)


def of_texts(texts: DataFrame) -> DataFrame:
    """(path, text) -> chapters. A plain-text book is one row already, so its lines, its layout and its chapters are
    worked out where it lies, without a shuffle."""
    return texts.select("path", "text").mapInArrow(_split_texts, CHAPTERS)
