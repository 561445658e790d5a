"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1, drawn from its code point; white space and all other
characters share one that marks word ends. A letter 3-gram is bound by multiplying the vector of its first letter
permuted twice, of its second permuted once (rotations), and of its third. A text is the bundle (sum) of its
3-grams, a language the bundle of its documents, each scaled to one length; a text gets the language whose
prototype has the largest cosine with it.

Prototypes are sums of whole numbers, so they do not depend on the order of the rows. A task reports one partial
sum a language, partial sums are added in FANOUT groups and then in one, and the driver gets one vector a language.

Defined results: text that is null or has no letter is ``und`` with score 0, as is every text if nothing was
learned; rows whose label or id is null teach nothing; a row with a null id counts as held out; equal cosines go
to the smaller language name; a score is the cosine, at least 0; repeated rows count each; other columns are
carried by ``identified`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import prepare, raw, rows_of

DIMENSIONS = 1024
SEED = 7041
#: Vectors of 3-grams that a worker keeps and adds up at once, characters looked at at once, groups that partial sums are added in.
GRAMS = 1 << 16
TOGETHER = 1 << 12
CHARS = 1 << 20
FANOUT = 64
#: Length to which a document's vector is scaled before it is rounded and added to its language.
UNIT = 1 << 20
GAP = 0x20

_letters: dict[int, np.ndarray] = {}
_lower = np.full(0x110000, -1, np.int64)


def letter_vector(code: int) -> np.ndarray:
    if code not in _letters:
        _letters[code] = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return _letters[code]


def letters(text: str) -> np.ndarray:
    """The text's letters in lower case, GAP for every other character."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = _lower[codes]
    if (low < 0).any():
        for c in np.unique(codes[low < 0]):
            own = chr(c).lower()
            _lower[c] = (ord(own) if len(own) == 1 else c) if chr(c).isalpha() else GAP
        low = _lower[codes]
    return low


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 3-grams of a text, as numbers, and how often each occurs; none if it has no letter. There is one
    GAP between words and at both ends; a part of a long text goes on from the last two places of the one before."""
    found, tail = [], np.array([GAP], np.int64)
    for at in range(0, max(1, len(text)), CHARS):
        line = np.concatenate([tail, letters(text[at : at + CHARS]), [GAP] if at + CHARS >= len(text) else []]).astype(np.int64)
        line = line[np.r_[True, (line[1:] != GAP) | (line[:-1] != GAP)]]
        if len(line) >= 3:
            found.append(np.unique(line[:-2] << 42 | line[1:-1] << 21 | line[2:], return_counts=True))
        tail = line[-2:]
    if len(found) < 2:
        return found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    ids, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return ids, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)


class Bundler:
    """Text vectors, with the vectors of the 3-grams met so far kept in one table."""

    def __init__(self):
        self.ids = np.empty(0, np.int64)  # sorted
        self.rows = np.empty(0, np.int64)
        self.table = np.empty((GRAMS, DIMENSIONS), np.int8)

    def where(self, ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ids, ids)
        known = np.zeros(len(ids), bool)
        inside = at < len(self.ids)
        known[inside] = self.ids[at[inside]] == ids[inside]
        new = ids[~known]
        if len(new):
            if len(self.ids) + len(new) > GRAMS:
                self.ids, self.rows = self.ids[:0], self.rows[:0]
                new = ids
            first = len(self.ids)
            parts = [np.stack([letter_vector(int(c)) for c in codes]) for codes, _ in (np.unique(new >> s & 0x1FFFFF, return_inverse=True) for s in (42, 21, 0))]
            which = [np.unique(new >> s & 0x1FFFFF, return_inverse=True)[1] for s in (42, 21, 0)]
            bound = np.roll(parts[0], 2, axis=1)[which[0]] * np.roll(parts[1], 1, axis=1)[which[1]] * parts[2][which[2]]
            self.table[first : first + len(new)] = bound
            both, rows = np.concatenate([self.ids, new]), np.concatenate([self.rows, np.arange(first, first + len(new))])
            order = np.argsort(both)
            self.ids, self.rows = both[order], rows[order]
            at = np.searchsorted(self.ids, ids)
        return self.rows[at]

    def vector(self, text: str) -> np.ndarray | None:
        ids, counts = grams(text)
        if not len(ids):
            return None
        total = np.zeros(DIMENSIONS, np.float64)
        for a in range(0, len(ids), TOGETHER):
            rows = self.where(ids[a : a + TOGETHER])
            total += counts[a : a + TOGETHER].astype(np.float32) @ self.table[rows].astype(np.float32)
        return total


_bundler: list[Bundler] = []


def bundler() -> Bundler:
    if not _bundler:
        _bundler.append(Bundler())
    return _bundler[0]


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, part, sum): one row a language and task."""
    sums: dict[str, np.ndarray] = {}
    for b in rows_of(batches):
        for lang, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
            if (v := bundler().vector(t.decode("utf-8", "replace"))) is not None and (size := np.sqrt(v @ v)):
                sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                sums[lang] += np.rint(v * (UNIT / size)).astype(np.int64)
    if sums:
        part = TaskContext.get().partitionId() % FANOUT
        yield pa.record_batch({"lang": pa.array(sums, pa.string()), "part": pa.array([part] * len(sums), pa.int32()), "sum": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(DIMENSIONS, np.int64)
    for x in rows["sum"]:
        total += np.frombuffer(x, np.int64)
    return rows.head(1).assign(sum=total.tobytes())


def learn(labelled: DataFrame) -> dict[str, np.ndarray]:
    """(lang, text) -> each language's prototype, of length 1."""
    prepare(labelled.sparkSession)
    plain = labelled.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    kind = "lang string, part int, sum binary"
    summed = plain.mapInArrow(_partial_sums, kind).groupBy("lang", "part").applyInPandas(_add_up, kind).groupBy("lang").applyInPandas(_add_up, kind)
    sums = {r["lang"]: np.frombuffer(r["sum"], np.int64) for r in summed.collect()}  # one row a language
    return {k: v / np.sqrt(v.astype(np.float64) @ v) for k, v in sorted(sums.items()) if v.any()}


def predict(text: str, names: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    v = bundler().vector(text) if names else None
    if v is None or not (size := np.sqrt(v @ v)):
        return "und", 0.0
    cosines = prototypes @ v / size
    best = int(np.argmax(cosines))
    return names[best], float(min(1.0, max(0.0, cosines[best])))


def _identify(batches: Iterator[pa.RecordBatch], at: int, names: list[str], prototypes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        found = [predict(t.decode("utf-8", "replace"), names, prototypes) for t in raw(b.column(at))]
        more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
        yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, "lang_pred", "score"])


def identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with columns renamed c0, c1, ... and lang_pred and score added; and the old names in that order."""
    prepare(docs.sparkSession)
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.empty((0, DIMENSIONS))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index(text_col)
    return plain.mapInArrow(partial(_identify, at=at, names=names, prototypes=matrix), schema), docs.columns


def held_out(id_col: str, folds: int, fold: int):
    """Whether the CRC-32 of the id's text falls into the fold; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def learn_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, fold: int = 0) -> dict[str, np.ndarray]:
    """Prototypes from the labelled rows of docs that are not held out."""
    return learn(docs.where(~held_out(id_col, folds, fold)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
