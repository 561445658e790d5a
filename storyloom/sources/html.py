"""XHTML and HTML to blocks of visible text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
BLOCKS = set(
    "address article aside blockquote body center dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre "
    "section table td th tr ul".split()
)
SKIPPED = set("head math rp rt script style svg template title".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())


def collapse(text: str) -> str:
    """White space to one space; a run with a line break vanishes unless it parts two Latin letters or digits."""

    def one(m: re.Match) -> str:
        if "\n" not in m[0] and "\r" not in m[0]:
            return " "
        sides = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
        return " " if len(sides) == 2 and sides.isascii() and sides.isalnum() else ""

    return re.sub(r"\s+", one, text).strip()


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str], int | None]] = []
        self.text: list[str] = []
        self.ids: list[str] = []
        self.hidden = 0

    def flush(self, level: int | None = None) -> None:
        text = collapse("".join(self.text))
        self.text = []
        if text:
            self.found.append((text, self.ids, level))
            self.ids = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden += 1
        elif not self.hidden:
            told = dict(attrs)
            if own := told.get("id") or (told.get("name") if tag == "a" else None):
                self.ids.append(own)
            if tag == "br" or tag in BLOCKS:
                self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag in SKIPPED:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden and tag in BLOCKS:
            self.flush(int(tag[1]) if re.fullmatch("h[1-6]", tag) else None)

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([0-9a-zA-Z]+;))?")


def ended(html: str) -> str:
    """The page with every & that begins no reference with its semicolon, as XML asks for, as a reference to itself."""
    return REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else f"&amp;{m[0][1:]}", html)


def text_blocks(html: str, strict: bool = False) -> list[tuple[str, list[str], int | None]]:
    """(text, ids seen since the block before, heading level) of every block. Browsers take some references without
    their semicolons; strict takes none."""
    walk = _Blocks()
    walk.feed(ended(html or "") if strict else html or "")
    walk.close()
    walk.flush()
    return walk.found


def _blocks(batches: Iterator[pd.DataFrame], strict: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, i, *x) for k, html in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) for i, x in enumerate(text_blocks(html, strict))]
        yield pd.DataFrame(rows, columns=["key", "index", "text", "ids", "heading_level"]).astype({"heading_level": "Int32"})


def blocks(pages: DataFrame, key: str, html: str, strict: bool = False) -> DataFrame:
    """key, index, text, ids, heading_level; row by row, no shuffle."""
    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("key"), html).mapInPandas(partial(_blocks, strict=strict), f"key {kind}, index int, text string, ids array<string>, heading_level int")
    return found.withColumnRenamed("key", key)
