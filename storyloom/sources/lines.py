"""Bytes to text to lines: charsets, line ends, layout, file names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions.text import trimmed
from storyloom.shared import pieces

# Fixed values.
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")]
STRAY_SHARE = 0.002
LAYOUT_LINES, LAYOUT_SHARE = 50, 0.8
NOT_AN_AUTHOR = "完结 全本 精校 校对 未删节 txt epub 无弹窗 最新".split()
BRACKETS = ["()", "（）", "[]", "【】"]
ZIP_MAGIC = b"PK\x03\x04"


def decode_novel(content: bytes) -> tuple[str, str, int]:
    """(text, encoding, sequences replaced): byte-order marks win, then UTF-8 with few strays, then GB18030."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), name, 0
    text = content.decode("utf-8", "replace")
    replaced = text.count("�")
    units = len(text) + sum(c > "￿" for c in text) if replaced else 1
    if replaced <= STRAY_SHARE * max(units, 1):
        return text, "utf-8", replaced
    return content.decode("gb18030", "replace"), "gb18030", 0


def is_zip(content: Column) -> Column:
    """Whether a binary column holds a ZIP container, by its first bytes."""
    return F.substring(content, 1, 4) == F.lit(ZIP_MAGIC)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Novel files of a folder: path, content, is_zip. Contents are read by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,epub,TXT,EPUB}").option("recursiveFileLookup", "false").load(path)
    return files.select("path", "content", is_zip(F.col("content")).alias("is_zip"))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        found = [decode_novel(c) for c in b.column(1).to_pylist()]
        columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
        yield pa.record_batch([b.column(0), *columns], names=["path", "text", "encoding", "replaced"])


def decoded(files: DataFrame) -> DataFrame:
    """path, text, encoding, replaced of plain-text files. The JVM does not offer GB18030, so Python decodes."""
    return files.where(~F.col("is_zip")).select("path", "content").mapInArrow(_decoded, "path string, text string, encoding string, replaced int")


def lines(texts: DataFrame, key: str = "path") -> DataFrame:
    """key, line_no, text, indented: trimmed non-empty lines with a dense number."""
    unified = F.regexp_replace("text", "\r\n?", "\n")
    raw = texts.select(key, F.posexplode(F.split(unified, "\n", -1)).alias("pos", "raw"))
    kept = raw.select(key, "pos", trimmed(F.col("raw")).alias("text"), F.col("raw").rlike("^(?:[　\t]|\\s{2,})").alias("indented")).where("text <> ''")
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return kept.select(key, number.alias("line_no"), "text", "indented")


#: White space at a line's ends, as for columns (functions.text.SPACE).
ENDS = re.compile(r"^[\s\ufeff]+|[\s\ufeff]+$")
INDENT = re.compile(r"(?:[\u3000\t]|\s{2,})")


def plain_lines(text: str) -> list[tuple[str, bool]]:
    """(line, indented) of one text: the same lines as lines() gives for a table of them."""
    raw = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return [(t, bool(INDENT.match(r))) for r in raw if (t := ENDS.sub("", r))]


def layouts(numbered: DataFrame, key: str = "path") -> DataFrame:
    """key, indented_body: whether unindented lines may be headings."""
    share = F.avg(F.col("indented").cast("int"))
    return numbered.groupBy(key).agg(((F.count("*") >= LAYOUT_LINES) & (share >= LAYOUT_SHARE)).alias("indented_body"))


#: The label of an author, and what parts words in a file's name.
AUTHOR_LABEL = re.compile(r"(.*?)[\s_-]*作者[:：]\s*(.+)")
BETWEEN = " \t_-"


def _peeled(stem: str) -> Iterator[tuple[str, str | None]]:
    """The name whole, then without its last bracket group, and so on: (what is left, what the group held)."""
    inner = None
    while True:
        yield stem, inner
        opened = [stem.rfind(a) for a, b in BRACKETS if stem.endswith(b)]
        if not opened or opened[0] <= 0:
            return
        stem, inner = stem[: opened[0]].strip(), stem[opened[0] + 1 : -1].strip()


def title_and_author(filename: str) -> tuple[str, str | None]:
    """From a file's name: the first, from its end, of an author's label and a bracket group that does not describe the file."""
    name = re.split(r"[\\/]", filename)[-1]
    left = ""
    for left, inner in _peeled(re.sub(r"\.[^.]+$", "", name).strip()):
        if inner is not None and not any(w in inner.lower() for w in NOT_AN_AUTHOR):
            return left.rstrip(BETWEEN), inner or None
        if m := AUTHOR_LABEL.fullmatch(left):
            return m[1].strip().rstrip(BETWEEN), m[2].strip() or None
    return left.rstrip(BETWEEN), None
