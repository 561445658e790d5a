"""Interval joins by a sweep over the ordered bounds of both sides."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Intervals of one key that are swept as one line; a key with more is cut into bins of position.
CROWD = 200_000
#: Pairs given out at once.
PAIRS = 1 << 15
#: What an open end is taken for.
OPEN = (1 << 63) - 1


def sweep(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], crowd: int = CROWD) -> DataFrame:
    """Pairs of rows of equal keys whose half-open spans [start, end) meet: keys, left's columns, right's columns.

    Both sides go through one shuffle by key and one sort by start. A task passes over a key's line once and keeps the
    spans that are still open in heaps by their end; a row meets those of the other side that are open where it starts,
    so the cost is that of the rows and the pairs, and memory that of the open spans. A key of more than ``crowd`` spans
    is cut into bins of position, each a line of its own: a span goes to every bin that it reaches, and a pair is given
    out in the bin that holds its first common position, so once.

    Starts and ends are whole numbers; a null end is open; empty and reversed spans, null starts and null keys meet
    nothing. Other columns of the two sides must have different names.
    """
    sides = [_side(left, keys, left_span, 0), _side(right, keys, right_span, 1)]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    line = both.select(*keys, "_start", "_end", "_side", "_l", "_r")

    ends = F.max(F.when(F.col("_end") < OPEN, F.col("_end")).otherwise(F.col("_start") + 1))
    crowded = line.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_start").alias("_low"), ends.alias("_high")).where(F.col("_n") > crowd)
    width = F.greatest(F.lit(1), F.ceil((F.col("_high") - F.col("_low")) / F.ceil(F.col("_n") / crowd))).cast("long")
    cut = crowded.select(*keys, "_low", "_high", width.alias("_width"))
    binned = line.join(cut, keys, "left")
    number = lambda at: F.expr(f"({at} - _low) div _width")
    reached = F.sequence(number("_start"), number("greatest(_start, least(_end, _high) - 1)"))
    dealt = binned.withColumn("_bin", F.explode(F.when(F.col("_width").isNotNull(), reached).otherwise(F.array(F.lit(0).cast("long")))))
    first = F.when(F.col("_width").isNotNull(), F.col("_low") + F.col("_bin") * F.col("_width")).otherwise(F.lit(-OPEN))
    placed = dealt.select(*keys, "_bin", first.alias("_first"), "_start", "_end", "_side", "_l", "_r")
    ordered = placed.repartition(*keys, "_bin").sortWithinPartitions(*keys, "_bin", "_start")

    kind = T.StructType([*[left.schema[k] for k in keys], T.StructField("_l", placed.schema["_l"].dataType), T.StructField("_r", placed.schema["_r"].dataType)])
    met = ordered.mapInArrow(partial(_swept, n_keys=len(keys)), kind)
    return met.select(*keys, *[F.col(f"_l.`{c}`") for c in left.columns if c not in keys], *[F.col(f"_r.`{c}`") for c in right.columns if c not in keys])


def _side(rows: DataFrame, keys: list[str], span: tuple[Column, Column], side: int) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    held = rows.select(*keys, span[0].cast("long").alias("_start"), F.coalesce(span[1].cast("long"), F.lit(OPEN)).alias("_end"), F.lit(side).alias("_side"), (F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))).alias("_r" if side else "_l"))
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))
    return held.where(known & (F.col("_start") < F.col("_end")))


def _lines(rows: pa.Table, n_keys: int) -> np.ndarray:
    """For each row whether it begins another line than the row before it."""
    new = np.zeros(rows.num_rows, bool)
    for i in range(n_keys + 1):
        codes = np.asarray(rows.column(i).combine_chunks().dictionary_encode().indices)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _swept(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows (keys, bin, its first position, start, end, side, left, right), by line and start -> pairs."""
    held: pa.Table | None = None  # rows of spans that may still be open, and last the row before
    opened: tuple[list, list] = ([], [])  # heaps of (end, row in held), left and right
    for b in batches:
        if not b.num_rows:
            continue
        n = held.num_rows if held else 0
        rows = pa.concat_tables([held, pa.Table.from_batches([b])]) if held else pa.Table.from_batches([b])
        new = _lines(rows.slice(max(n - 1, 0)), n_keys)[1 if n else 0 :].tolist()
        first, start, end, side = (rows.column(n_keys + i).combine_chunks().slice(n).to_pylist() for i in range(1, 5))
        out: tuple[list[int], list[int]] = ([], [])
        for i in range(b.num_rows):
            if new[i]:
                opened[0].clear()
                opened[1].clear()
            own, other = side[i], opened[1 - side[i]]
            while other and other[0][0] <= start[i]:
                heapq.heappop(other)
            if start[i] >= first[i]:
                out[own].extend([n + i] * len(other))
                out[1 - own].extend(x[1] for x in other)
            else:  # begins before this bin: only what begins in it counts
                for x in other:
                    if x[2] >= first[i]:
                        out[own].append(n + i)
                        out[1 - own].append(x[1])
            heapq.heappush(opened[own], (end[i], n + i, start[i]))
            if len(out[0]) >= PAIRS:
                yield _pairs(rows, out, n_keys)
                out[0].clear()
                out[1].clear()
        if out[0]:
            yield _pairs(rows, out, n_keys)
        # Only open spans' rows are kept, and the last one, to tell whether the next begins another line.
        alive = sorted({x[1] for heap in opened for x in heap if x[0] > start[-1]} | {rows.num_rows - 1})
        place = {r: i for i, r in enumerate(alive)}
        held = rows.take(pa.array(alive)).combine_chunks()
        for heap in opened:
            heap[:] = [(e, place[r], s) for e, r, s in heap if r in place and e > start[-1]]
            heapq.heapify(heap)


def _pairs(rows: pa.Table, out: tuple[list[int], list[int]], n_keys: int) -> pa.RecordBatch:
    at = [pa.array(x, pa.int64()) for x in out]
    last = len(rows.column_names)
    columns = [*[rows.column(i).take(at[0]) for i in range(n_keys)], rows.column(last - 2).take(at[0]), rows.column(last - 1).take(at[1])]
    names = [*rows.column_names[:n_keys], "_l", "_r"]
    return pa.table(columns, names=names).combine_chunks().to_batches()[0]
