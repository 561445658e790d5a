"""Span algebra: paragraphs, gaps, containment, overlap, partition checks, greedy choices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions import text as X
from storyloom.functions.arrays import running
from storyloom.operators.intervals import sweep


def paragraphs(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per line of the text: keys, index, char_start, char_end, paragraph.

    Offsets are running sums of the lines' lengths inside the row, so no shuffle is needed.
    """
    lines = F.split(F.col(text_col), "\n", -1)
    starts = running(F.transform(lines, lambda p: F.length(p) + 1))
    rows = docs.where(F.col(text_col).isNotNull()).select(*keys, F.posexplode(F.arrays_zip(lines.alias("p"), starts.alias("s"))).alias("index", "x"))
    return rows.select(*keys, "index", F.col("x.s").alias("char_start"), (F.col("x.s") + F.length("x.p")).alias("char_end"), F.col("x.p").alias("paragraph"))


def well_formed(start: Column, end: Column) -> Column:
    return (start >= 0) & (end > start)


def contains(outer: tuple[Column, Column], inner: tuple[Column, Column]) -> Column:
    return (outer[0] <= inner[0]) & (inner[1] <= outer[1])


def at_offset(spans: DataFrame, points: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Each point with the span of the same keys that holds it."""
    point = (F.col(offset), F.col(offset) + 1)
    return sweep(points, spans, keys, point, (F.col("char_start"), F.col("char_end")))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Intersections of spans (char_start, char_end) of left with spans (s_start, s_end) of right, of equal keys."""
    met = sweep(left, right, keys, (F.col("char_start"), F.col("char_end")), (F.col("s_start"), F.col("s_end")))
    start, end = F.greatest("char_start", "s_start"), F.least("char_end", "s_end")
    return met.withColumns({"char_start": start, "char_end": end}).drop("s_start", "s_end")


def gaps(spans: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """What the spans leave of [0, length): keys, char_start, char_end. spans may overlap; lengths: keys, length."""
    ends = lengths.select(*keys, F.col("length").alias("char_start"), F.col("length").alias("char_end"))
    line = Window.partitionBy(*keys).orderBy("char_start", "char_end").rowsBetween(Window.unboundedPreceding, -1)
    held = spans.select(*keys, "char_start", "char_end").unionByName(ends)
    reach = held.withColumn("reach", F.coalesce(F.max("char_end").over(line), F.lit(0)))
    return reach.where("reach < char_start").select(*keys, F.col("reach").alias("char_start"), F.col("char_start").alias("char_end"))


def segments(spoken: DataFrame, scenes: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Spoken spans and the narration between them, cut at scene bounds: a dense index over a gap-free cover.

    scenes: keys, scene, s_start, s_end.
    """
    narration = overlaps(gaps(spoken, lengths, keys), scenes, keys).select(*keys, "char_start", "char_end", "scene", F.lit("narration").alias("kind"))
    begins = (F.col("char_start"), F.col("char_start") + 1)
    said = sweep(spoken, scenes, keys, begins, (F.col("s_start"), F.col("s_end"))).select(*keys, "char_start", "char_end", "scene", F.lit("dialogue").alias("kind"))
    order = Window.partitionBy(*keys).orderBy("char_start")
    return said.unionByName(narration).withColumn("index", F.row_number().over(order) - 1)


def partition_errors(items: DataFrame, keys: list[str], total: Column, code: str) -> DataFrame:
    """Where items (index, char_start, char_end) fail to tile [0, total): keys, code, index, message."""
    order = Window.partitionBy(*keys).orderBy("index")
    every = Window.partitionBy(*keys)
    held = items.withColumns(
        {
            "place": F.row_number().over(order) - 1,
            "expected": F.lag("char_end", 1, 0).over(order),
            "last": F.max("index").over(every) == F.col("index"),
            "total": total,
        }
    )
    message = (
        F.when(F.col("index") != F.col("place"), F.lit("index gap"))
        .when(~well_formed(F.col("char_start"), F.col("char_end")), F.lit("empty or reversed span"))
        .when(F.col("char_start") != F.col("expected"), F.lit("gap or overlap"))
        .when(F.col("last") & (F.col("char_end") != F.col("total")), F.lit("does not reach the end"))
    )
    return held.select(*keys, F.lit(code).alias("code"), "index", message.alias("message")).where("message is not null")


def greedy_longest(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of overlapping candidates (char_start, char_end, ...) the leftmost, then longest, kept from the left.

    Whether one is kept depends on the one kept before it, so a key's candidates are one ordered stream; a task holds a
    batch of them at a time.
    """
    rest = [c for c in candidates.columns if c not in (*keys, "char_start", "char_end")]
    ordered = candidates.select(*keys, "char_start", "char_end", *rest)
    n = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, until = None, 0
        for b in batches:
            take = []
            for row in b.iloc[:, : n + 2].itertuples(index=False, name=None):
                if row[:n] != key:
                    key, until = row[:n], row[n]
                take.append(row[n] >= until)
                until = row[n + 1] if take[-1] else until
            yield b[take]

    order = [*keys, F.asc("char_start"), F.desc("char_end"), *rest]
    return ordered.repartition(*keys).sortWithinPartitions(*order).mapInPandas(run, ordered.schema)


def mentions(docs: DataFrame, lexicon: list[tuple[str, str]], keys: list[str], text_col: str = "text") -> DataFrame:
    """Occurrences of a lexicon's names (entity, name of 2 or more characters), longest match first on overlap.

    Row by row in Arrow batches: a document's hits are found and chosen in one linear pass, without a shuffle.
    """
    from storyloom.operators.attribution import find_mentions

    targets = [(e, [n]) for e, n in lexicon]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *m) for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()) for m in find_mentions(t or "", targets)]
            at, *told = zip(*found, strict=True) if found else [()] * 5
            columns = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            columns += [pa.array(x, kind) for x, kind in zip(told, kinds, strict=True)]
            yield pa.record_batch(columns, names=[*b.schema.names[:-1], "entity", "surface", "char_start", "char_end"])

    kept = docs.select(*keys, text_col)
    schema = T.StructType([*[kept.schema[k] for k in keys], T.StructField("entity", T.StringType()), T.StructField("surface", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])
    return kept.mapInArrow(run, schema)


#: Bytes of all quotes up to which they are sent to every task; beyond, they meet the documents by a join.
QUOTE_BYTES = 8 << 20


def quote_places(quotes: DataFrame, docs: DataFrame, quote_key: str, doc_key: str) -> DataFrame:
    """Where quotes (quote_key, quote) stand in documents (doc_key, text) exactly once: quote_key, doc_key, char_start.

    Few quotes, by their bytes, are sent to every task, where one automaton finds them all in one pass over each text,
    and nothing is shuffled. Of many, those of four or more words meet the texts by equality on their second and third
    word (whole in any text that holds the quote), and every candidate is located exactly; the others go the first way
    in parts.
    """
    kinds = [quotes.schema[quote_key].dataType.simpleString(), docs.schema[doc_key].dataType.simpleString()]
    schema = f"q {kinds[0]}, d {kinds[1]}, char_start int"
    usable = quotes.where("length(quote) > 0").select(F.col(quote_key).alias("q"), "quote")
    n_bytes = usable.agg(F.sum(F.octet_length("quote"))).first()[0] or 0
    texts = docs.select(F.col(doc_key).alias("d"), "text")
    names = [F.col("q").alias(quote_key), F.col("d").alias(doc_key), "char_start"]

    def by_automaton(chosen: DataFrame) -> DataFrame:
        held = chosen.collect()  # bounded by QUOTE_BYTES
        return texts.mapInPandas(partial(_located, quotes=[(r["q"], r["quote"]) for r in held]), schema)

    if n_bytes <= QUOTE_BYTES:
        return by_automaton(usable).select(names)
    words = F.split("quote", " ", -1)
    keyed = usable.withColumn("w", words).select("q", "quote", F.when(F.size("w") >= 4, F.concat(F.col("w")[1], F.lit(" "), F.col("w")[2])).alias("key"))
    parts = texts.select("d", "text", F.split("text", " ", -1).alias("p"))
    pairs = F.zip_with(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    seen = parts.select("d", F.explode(F.array_distinct(pairs)).alias("key"))
    at = X.unique_at(F.col("text"), F.col("quote"))
    found = seen.join(keyed, "key").select("q", "quote", "d").join(texts, "d").select("q", "d", at.alias("char_start")).where("char_start is not null")
    short = keyed.where("key is null").select("q", "quote").withColumn("part", F.pmod(F.xxhash64("quote"), F.lit(-(-n_bytes // QUOTE_BYTES))))
    for r in short.select("part").distinct().collect():  # as many parts as QUOTE_BYTES goes into the quotes
        found = found.unionByName(by_automaton(short.where(F.col("part") == r["part"])))
    return found.select(names)


def _located(batches: Iterator[pd.DataFrame], quotes: list[tuple]) -> Iterator[pd.DataFrame]:
    import ahocorasick

    names: dict[str, list] = {}
    for key, quote in quotes:
        names.setdefault(quote, []).append(key)
    automaton = ahocorasick.Automaton()
    for quote in names:
        automaton.add_word(quote, quote)
    automaton.make_automaton()
    for b in batches:
        rows = []
        for doc, text in zip(b["d"], b["text"], strict=True):
            once: dict[str, int | None] = {}
            for end, quote in automaton.iter(text or "") if names else ():
                once[quote] = None if quote in once else end + 1 - len(quote)
            rows += [(key, doc, at) for quote, at in once.items() if at is not None for key in names[quote]]
        yield pd.DataFrame(rows, columns=["q", "d", "char_start"])


def cover(spoken: Column, length: Column) -> Column:
    """Spoken spans (char_start, char_end) in order, and the narration between them: segments that tile [0, length).

    Each span is paired with the gap before it once, so the cost is that of the spans' number."""
    piece = lambda a, b, kind: F.struct(a.cast("int").alias("char_start"), b.cast("int").alias("char_end"), F.lit(kind).alias("kind"))
    said = F.transform(spoken, lambda x: piece(x["char_start"], x["char_end"], "dialogue"))
    starts = F.concat(F.transform(spoken, lambda x: x["char_start"].cast("int")), F.array(length.cast("int")))
    ends = F.concat(F.array(F.lit(0)), F.transform(spoken, lambda x: x["char_end"].cast("int")))
    between = F.zip_with(ends, starts, lambda a, b: piece(a, b, "narration"))
    return F.filter(F.flatten(F.zip_with(between, said, lambda a, b: F.array(a, b))), lambda x: x["char_start"] < x["char_end"])


def fitted(items: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Skip-and-continue packing: in order, an item is kept if it still fits the budget; later smaller ones may.

    Which are kept depends on all before, so a key's items are one ordered stream; a task holds a batch of them at a
    time, whatever their number.
    """
    rest = [c for c in items.columns if c not in (*keys, *order, cost)]
    kept = items.select(*keys, *order, cost, *rest)
    place, at = len(keys) + len(order), len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used = None, 0
        for b in batches:
            take = []
            for row in b.iloc[:, : place + 1].itertuples(index=False, name=None):
                if row[:at] != key:
                    key, used = row[:at], 0
                fits = used + row[place] <= budget
                used += row[place] if fits else 0
                take.append(fits)
            yield b[take]

    return kept.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, kept.schema)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
