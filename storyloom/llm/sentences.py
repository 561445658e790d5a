"""Substring deduplication by sliding runs of sentences.

From every sentence on, the run of the next sentences is hashed: at least ``SPAN`` of them, and as many as make
``MIN_WORDS`` words; a single sentence of ``LONG`` words is a run as well. So what is covered of a passage of over 50
words are its whole sentences, if they have ``MIN_WORDS`` words, and lines that stand in many texts alone are left.
Runs are joined globally by their hash (96 bits). Of equal runs the first one, by document id and place, stays; every
sentence covered by any other is removed, so a passage shared by many documents stays in one of them, whatever
surrounds it.

A sentence ends after . ! or ? (or their wide forms) or at a line's end, and one of more than ``CLAUSES`` words counts
as the clauses that its commas, semicolons and colons part, so of a passage that begins or ends inside a long sentence
only a clause is lost; sentences are equal if their words, split at white space and lower-cased, are; two characters of a script without spaces count as a word. Only hashes and offsets
are shuffled, once to find each repeated hash and its first place (with partial aggregation, so a run that occurs
everywhere is one row a task) and once to join them with the runs. The repeated hashes are a table of their own, so
that Spark can split the partition of a very common one in that join.

Defined results: null text counts as empty; null ids come after all others; repeated rows are documents of their
own, so all but one of them lose their repeated runs; a text too short for one run keeps everything; an empty table
gives an empty result; other columns are kept by ``deduplicated`` whatever their names. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import prepare, raw, rows_of, settle

SPAN = 2
MIN_WORDS = 24
LONG = 40
SENTENCE = re.compile("[^.!?。！？\n]*[.!?。！？]+|[^.!?。！？\n]+")
#: Words beyond which a sentence is taken clause by clause: two texts that share a part of one agree in whole clauses.
CLAUSES = 20
CLAUSE = re.compile("[^,;:，；：]*[,;:，；：]+|[^,;:，；：]+")
#: Characters of scripts that put no space between words.
UNSPACED = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
RUNS = "h long, check int, row long, id long, start int, end int"


def words_in(own: str) -> tuple[list[str], int]:
    """The words of a piece of text, and how many they count as."""
    words = own.split()
    return words, len(words) if own.isascii() else max(len(words), len(UNSPACED.findall(own)) // 2)


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, normalised text, words) of every sentence that has a word; of long ones, of every clause."""
    found = []
    for m in SENTENCE.finditer(text):
        own, at = m.group(), m.start()
        words, n = words_in(own)
        parts = [(own, words, n, at)]
        if n > CLAUSES:
            parts = [(c.group(), *words_in(c.group()), at + c.start()) for c in CLAUSE.finditer(own)]
        for part, words, n, start in parts:
            if words:
                a = start + len(part) - len(part.lstrip())
                found.append((a, start + len(part.rstrip()), " ".join(words).lower(), n))
    return found


def runs(text: str, span: int, min_words: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, key) of the run from each sentence on that is long enough."""
    found = sentences(text)
    last, words = 0, 0  # the run from i on ends before last
    short = lambda i: words < min_words or last - i < span and words < LONG
    for i, (start, *_) in enumerate(found):
        while last < len(found) and short(i):
            words += found[last][3]
            last += 1
        if short(i):
            return
        yield start, found[last - 1][1], "\n".join(found[k][2] for k in range(i, last))
        words -= found[i][3]


def _runs(batches: Iterator[pa.RecordBatch], span: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """(id, text[, row]) -> runs; without row, rows are numbered by partition and place."""
    number = TaskContext.get().partitionId() << 33
    for b in rows_of(batches):
        ids = b.column(0).to_pylist()
        own = b.column(2).to_pylist() if b.num_columns > 2 else range(number, number + b.num_rows)
        number += b.num_rows
        row, of, start, end, digest = [], [], [], [], []
        for i, t in enumerate(raw(b.column(1))):
            n = len(row)
            for a, e, key in runs(t.decode("utf-8", "replace"), span, min_words):
                start.append(a)
                end.append(e)
                digest.append(xxhash.xxh3_128_digest(key.encode()))
                row.append(own[i])
            of += [ids[i]] * (len(row) - n)
        if row:
            marks = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            check = marks[:, 1].astype(np.int32)
            yield pa.record_batch(
                {
                    "h": np.ascontiguousarray(marks[:, 0]),
                    "check": check,
                    "row": pa.array(row, pa.int64()),
                    "id": pa.array(of, pa.int64()),
                    "start": pa.array(start, pa.int32()),
                    "end": pa.array(end, pa.int32()),
                }
            )


def repeated_runs(found: DataFrame) -> DataFrame:
    """Settled runs -> those that are not the first of their kind: row, id, start, end, first_id, first_start."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start")
    kinds = found.groupBy("h", "check").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    joined = found.join(settle(kinds, "repeated"), ["h", "check"])
    later = joined.where((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
    return later.select("row", "id", "start", "end", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))


def merged(later: DataFrame) -> DataFrame:
    """Overlapping runs of a row made one: row, id, start, end, first_id and first_start of its first run, n_runs."""
    line = Window.partitionBy("row").orderBy("start")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    numbered = opened.withColumn("k", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("start", "first_id", "first_start"))
    whole = numbered.groupBy("row", "k").agg(F.max("id").alias("id"), F.max("end").alias("end"), first.alias("first"), F.count("*").alias("n_runs"))
    return whole.select("row", "id", F.col("first.start").alias("start"), "end", "first.first_id", "first.first_start", "n_runs")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS, row_col: str | None = None) -> DataFrame:
    """The spans to remove: row, id, start, end, first_id, first_start, n_runs; documents that repeat nothing have none."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col)] if row_col else []))
    found = settle(plain.mapInArrow(partial(_runs, span=span, min_words=min_words), RUNS), "runs")
    return merged(repeated_runs(found))


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a list of (start, end) -> the rows without it, their text without those parts."""
    for b in rows_of(batches):
        texts = []
        for t, spans in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            if spans:
                parts, last = [], 0
                for s in sorted(spans, key=lambda s: s["start"]):
                    parts.append(t[last : s["start"]].rstrip(" \t"))
                    last = s["end"]
                t = "".join([*parts, t[last:]])
            texts.append(t)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
        yield pa.record_batch(columns, names=b.schema.names[:-1])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all columns, with the repeated spans taken out of their texts."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = settle(named, "documents")  # row numbers must be the same in both uses
    at = docs.columns.index(text_col)
    spans = repeated_spans(kept, f"c{docs.columns.index(id_col)}", f"c{at}", span, min_words, "row")
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType() if i == at else f.dataType) for i, f in enumerate(docs.schema.fields)])
    cut = kept.join(lists, "row", "left").drop("row").mapInArrow(partial(_cut, at=at), schema)
    return cut.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
