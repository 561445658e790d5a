"""Exact vector search through cells with bounds.

Vectors are scaled to length 1, so the largest cosine is the smallest distance. They are dealt to cells around
centroids drawn from the data; a cell's centroid and radius (the distance of its farthest vector) are kept beside the
vectors, which lie in a folder a cell. A vector of a cell is no closer to a query than the centroid is, less the radius
(triangle inequality): the cells whose centroids are closest are searched first, the distance of the k-th vector found
there is a bound, and of the other cells only those that may hold something closer are opened. The result is that of
comparing with all vectors.

Queries are a table; one job answers all of them. What a query may open is told by cells and kept by blocks of cells, so
nothing is written for a query and a cell: queries of neighbouring cells and vectors of neighbouring cells form blocks of up to
BLOCK, and each vector goes once to every block of queries that opens its block. A task compares two blocks by products of
matrices, cell by cell, and gives out what is among a query's k best of them, with its cosine computed as in a scan, so
that equal vectors tie exactly; of many copies of a vector the first k are compared. On vectors without clusters every pair
is compared, which is quadratic in time; what is moved then grows with the rows times the number of blocks. Vectors of
another dimension, null or with null or non-finite components, and those of length 0 are not searched. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.retrieval import norm, usable
from storyloom.shared import pieces, written

#: Cells at most: their centroids are sent to every task. Vectors of a part of a cell, and queries that meet it at once,
#: where the first bounds are found.
CELLS = 1024
PART = 4096
TOGETHER = 512
#: Queries, and vectors, of a block: a SHARE of all, LEAST at least, BLOCK at most. Rows of one product of matrices.
LEAST, BLOCK, SHARE = 1024, 32_768, 8
STEP = 2048
#: What rounding may add to a distance or take from it, and to a cosine.
SLACK = 1e-6
NEAR = 1e-9

CENTROIDS = "cell int, centroid array<double>, radius double, n long"


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of length 1."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def lengths(x: np.ndarray) -> np.ndarray:
    """Of each row, added up in order, as ``retrieval.norm`` does."""
    out = np.zeros(len(x))
    for column in x.T:
        out += column * column
    return np.sqrt(out)


def units(x: np.ndarray) -> np.ndarray:
    return x / lengths(x)[:, None]


def lows(unit: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No vector of a cell is closer than this."""
    return np.maximum(0.0, distances(unit, centroids) - radius[None, :] - SLACK)


def places(of: np.ndarray) -> np.ndarray:
    """The place of each entry among the equal ones; equal ones lie together."""
    first = np.r_[True, of[1:] != of[:-1]][: len(of)]
    at = np.arange(len(of))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def lists(values: np.ndarray, taken: np.ndarray) -> pa.Array:
    """Of each row of a mask the values that it takes."""
    ends = np.r_[0, np.cumsum(taken.sum(axis=1))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.broadcast_to(values, taken.shape)[taken].astype(np.int32)))


def neighbours(centroids: np.ndarray, at: np.ndarray) -> list[int]:
    """Cells in an order in which close ones stand together: halves along the widest component, again and again."""
    if len(at) < 2:
        return at.tolist()
    own = centroids[at]
    cut = at[np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")]
    return neighbours(centroids, cut[: len(cut) // 2]) + neighbours(centroids, cut[len(cut) // 2 :])


def blocks(order: list[int], n: dict[int, int]) -> dict[int, tuple[int, int]]:
    """cell -> its first block and how many it has: neighbouring cells share one, a large cell has several of its own."""
    most = min(BLOCK, max(LEAST, -(-sum(n.values()) // SHARE)))
    out, at, held = {}, 0, 0
    for cell in order:
        own = n.get(cell, 0)
        if held and held + own > most:
            at, held = at + 1, 0
        parts = max(1, -(-own // most))
        out[cell] = (at, parts)
        at, held = (at + parts, 0) if parts > 1 else (at, held + own)
    return out


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(..., unit) -> also cell and the distance to its centroid."""
    for b in pieces(batches):
        apart = distances(matrix(b.column(b.num_columns - 1), centroids.shape[1]), centroids)
        cell = apart.argmin(axis=1)
        more = [pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(cell)), cell])]
        yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, "cell", "apart"])


def _nearest_cells(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, radius: np.ndarray, cells: np.ndarray, n: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, _asked) -> also the closest cells, the closest one first, until some more than k vectors lie there."""
    for b in pieces(batches):
        order = np.argsort(lows(units(matrix(b.column(1), centroids.shape[1])), centroids, radius), axis=1, kind="stable")
        held = n[order]
        yield pa.record_batch([*b.columns, lists(cells[order], np.cumsum(held, axis=1) - held < 2 * k)], names=["query_id", "_asked", "_first"])


def _best_of_parts(batches: Iterator[pa.RecordBatch], dimension: int, k: int) -> Iterator[pa.RecordBatch]:
    """(_queries, _rows) -> (query_id, the k largest cosines)."""
    for b in batches:
        for i in range(b.num_rows):
            queries = b.column(0)[i].values
            q, x = (units(matrix(c, dimension)) for c in (queries.field("_asked"), b.column(1)[i].values))
            dots = q @ x.T
            best = np.partition(dots, -k, axis=1)[:, -k:] if dots.shape[1] > k else dots
            ends = np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]
            yield pa.record_batch([queries.field("query_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel()))], names=["query_id", "best"])


def reach(bound: np.ndarray) -> np.ndarray:
    """The distance within which the k closest lie, of the cosine of k vectors; of an unknown one everything is."""
    return np.where(np.isfinite(bound), np.sqrt(np.maximum(0.0, 2 - 2 * bound)), np.inf) + SLACK


def cosines_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.nan_to_num(np.asarray(column.cast(pa.float64()).fill_null(-np.inf), np.float64), neginf=-np.inf)


def _opened(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, radius: np.ndarray, cells: np.ndarray, places_of: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(query_id, _asked, _first, bound) -> the blocks that hold a cell that may hold one of the k closest, and how many cells are read."""
    total = max(at + parts for at, parts in places_of.values())
    has = np.zeros((len(cells), total), np.int32)
    for i, c in enumerate(cells):
        at, parts = places_of[int(c)]
        has[i, at : at + parts] = 1
    for b in pieces(batches):
        opens = lows(units(matrix(b.column(1), centroids.shape[1])), centroids, radius) <= reach(cosines_of(b.column(3)))[:, None]
        looked = opens.copy()
        first = b.column(2)
        looked[np.repeat(np.arange(b.num_rows), np.asarray(first.value_lengths())), np.searchsorted(cells, np.asarray(first.flatten()))] = True
        met = lists(np.arange(total), opens.astype(np.int32) @ has > 0)
        home = pa.array(np.asarray([x[0].as_py() for x in first], np.int32))
        columns = [b.column(0), b.column(1), b.column(3), home, met, pa.array(looked.sum(axis=1).astype(np.int64))]
        yield pa.record_batch(columns, names=["query_id", "_asked", "bound", "_home", "_blocks", "cells_read"])


def _closest(asked: pa.Table, rows: pa.Table, dimension: int, centroids: np.ndarray, radius: np.ndarray, cells: np.ndarray, k: int, tie: list[str]) -> pa.Table:
    """A block of queries (query_id, _asked, bound) and one of vectors (_row, cell, _vector, tie) -> each query's k best of them."""
    asked, rows = asked.combine_chunks(), rows.combine_chunks()
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(f"_tie{i}", "ascending") for i in range(len(tie))], null_placement="at_start"))
    q, x = (matrix(t.column(c).combine_chunks(), dimension) for t, c in ((asked, "_asked"), (rows, "_vector")))
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * dimension))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    use = np.sort(order[places(same[order]) < k])  # the first k of a vector's copies
    uq, ux, cell = units(q), units(x), np.asarray(rows.column("cell"))
    bound = cosines_of(asked.column("bound"))
    mine = np.searchsorted(cells, np.unique(cell[use]))
    own = [(i, use[cell[use] == cells[i]]) for i in mine]
    taken = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for start in range(0, len(q), STEP):
        part = uq[start : start + STEP]
        least = bound[start : start + STEP] - NEAR
        opens = lows(part, centroids[mine], radius[mine]) <= reach(bound[start : start + STEP])[:, None]
        at, of, near = [], [], []
        for j, (_, members) in enumerate(own):
            sel = np.flatnonzero(opens[:, j])
            for some in (members[i : i + STEP] for i in range(0, len(members) if len(sel) else 0, STEP)):
                dots = part[sel] @ ux[some].T
                hit = dots >= least[sel, None]
                many = np.flatnonzero(hit.sum(axis=1) > k)
                if len(many):
                    least[sel[many]] = np.maximum(least[sel[many]], np.partition(dots[many], -k, axis=1)[:, -k] - NEAR)
                    hit[many] = dots[many] >= least[sel[many], None]
                a, o = np.nonzero(hit)
                at.append(sel[a])
                of.append(some[o])
                near.append(dots[a, o])
        if not at:
            continue
        at, of, near = np.concatenate(at), np.concatenate(of), np.concatenate(near)
        order = np.lexsort((-near, at))
        at, of, near = at[order], of[order], near[order]
        last = places(at) == k - 1
        least[at[last]] = np.maximum(least[at[last]], near[last] - NEAR)
        fine = near >= least[at]
        at, of = at[fine] + start, of[fine]
        for i in range(0, len(at), 1 << 16):
            of_query, of_row = at[i : i + (1 << 16)], of[i : i + (1 << 16)]
            near = np.zeros(len(of_query))
            for d in range(dimension):  # in order, as retrieval.dot adds
                near += x[of_row, d] * q[of_query, d]
            near /= lengths(x[of_row]) * lengths(q[of_query])
            for held, more in zip(taken, (of_query, of_row, near), strict=True):
                held.append(more)
    at, of, near = (np.concatenate(t) for t in taken)
    order = np.lexsort((of, -near, at))  # rows lie in the order of ties
    order = order[places(at[order]) < k]
    kept = rows.take(pa.array(of[order]))
    columns = [asked.column("query_id").take(pa.array(at[order])), pa.array(near[order]), kept.column("_row"), *[kept.column(f"_tie{i}") for i in range(len(tie))]]
    return pa.table(columns, names=["query_id", "similarity", "_row", *[f"_tie{i}" for i in range(len(tie))]])


@dataclass
class CellIndex:
    """An index below a folder: vectors (id and other columns, vector, unit) by cell, and the cells' centroids."""

    spark: SparkSession
    folder: str
    dimension: int

    def build(self, rows: DataFrame, vector: str = "embedding", cells: int | None = None) -> None:
        """Rows with their vectors. There are about as many cells as a cell has vectors, CELLS at most; centroids are the
        vectors whose hashes are smallest, so a build gives the same cells again."""
        length = norm(F.col(vector).cast("array<double>"))
        unit = F.transform(vector, lambda x: x.cast("double") / F.col("_length"))
        held = rows.where(usable(vector, self.dimension)).withColumn("_length", length).where("_length > 0 and _length < double('inf')")
        held = written(held.withColumn("_row", F.monotonically_increasing_id()).withColumn("unit", unit).drop("_length"), "units")
        wanted = min(CELLS, cells or max(1, int(held.count() ** 0.5)))
        drawn = held.select("unit", F.xxhash64("unit").alias("h")).distinct().orderBy("h").limit(wanted).collect()  # CELLS vectors at most
        centroids = np.array([r["unit"] for r in drawn], np.float64).reshape(-1, self.dimension)
        kind = T.StructType([*held.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("apart", T.DoubleType())])
        dealt = held.mapInArrow(partial(_assigned, centroids=centroids), kind) if len(drawn) else self.spark.createDataFrame([], kind)
        dealt.repartition("cell").write.partitionBy("cell").parquet(f"{self.folder}/vectors")
        apart = self.spark.read.schema(kind).parquet(f"{self.folder}/vectors").groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n"))
        told = [(i, c.tolist()) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(told, "cell int, centroid array<double>").join(apart, "cell").select("cell", "centroid", "radius", "n").write.parquet(f"{self.folder}/centroids")

    def search(self, queries: DataFrame, k: int, tie: list[str], scope: str | None = None, vector: str = "embedding", query_vector: str = "vector") -> tuple[DataFrame, DataFrame]:
        """queries (query_id, vector) -> the hits (query_id, rank, similarity and the rows' columns), and what was read
        (query_id, cells, cells_read). scope: a condition that rows must meet."""
        cells = self.spark.read.schema(CENTROIDS).parquet(f"{self.folder}/centroids").orderBy("cell").collect()
        length = norm(F.col(query_vector).cast("array<double>"))
        fine = queries.where(usable(query_vector, self.dimension)).where((length > 0) & (length < F.lit(float("inf")))).select("query_id", F.col(query_vector).alias("_asked"))
        if not cells:  # nothing was searchable, so the rows' columns are not known
            empty = fine.select("query_id").limit(0)
            return empty.withColumns({"rank": F.lit(0), "similarity": F.lit(0.0)}), empty.withColumns({"cells": F.lit(0).cast("long"), "cells_read": F.lit(0).cast("long")})
        centroids, radius, numbers, n = (np.array([r[c] for r in cells], kind) for c, kind in (("centroid", np.float64), ("radius", np.float64), ("cell", np.int32), ("n", np.int64)))
        rows = self.spark.read.parquet(f"{self.folder}/vectors")
        rows = rows.where(scope) if scope else rows
        rest = [c for c in rows.columns if c not in ("unit", "cell", "apart", "_row")]
        table = {"centroids": centroids, "radius": radius, "cells": numbers}

        # The closest cells of each query first; the cosine of the k-th vector found there is a bound.
        kinds = list(fine.schema.fields)
        kind = T.StructType([*kinds, T.StructField("_first", T.ArrayType(T.IntegerType()))])
        asked = written(fine.mapInArrow(partial(_nearest_cells, **table, n=n, k=k), kind), "asked")
        sizes = self.spark.createDataFrame([(r["cell"], r["n"]) for r in cells], "cell int, n long")
        best = self._looked_at(asked.select("query_id", "_asked", F.explode("_first").alias("cell")), rows, sizes, vector, k)
        bound = best.groupBy("query_id").agg(F.get(F.sort_array(F.flatten(F.collect_list("best")), False), F.lit(k - 1)).alias("bound"))

        # What each query opens, by blocks of neighbouring cells.
        order = [int(numbers[i]) for i in neighbours(centroids, np.arange(len(numbers)))]
        of_rows = blocks(order, {r["cell"]: r["n"] for r in cells})
        kind = T.StructType([*kinds, *T.StructType.fromDDL("bound double, _home int, _blocks array<int>, cells_read long").fields])
        bounded = asked.join(bound, "query_id", "left").select("query_id", "_asked", "_first", "bound")
        opened = written(bounded.mapInArrow(partial(_opened, **table, places_of=of_rows), kind), "opened")
        of_queries = blocks(order, {r["_home"]: r["count"] for r in opened.groupBy("_home").count().collect()})  # CELLS numbers at most

        dealt = lambda at, parts: self.spark.createDataFrame([(c, *v) for c, v in at.items()], f"{parts} int, _at int, _parts int")
        share = lambda key: F.col("_at") + F.pmod(F.xxhash64(key), F.col("_parts"))
        wanting = opened.join(F.broadcast(dealt(of_queries, "_home")), "_home").withColumn("_of", share("query_id"))
        wanting = wanting.select("_of", F.explode(F.col("_blocks").cast("array<long>")).alias("_block"), "query_id", "_asked", "bound")
        met = written(wanting.select("_of", "_block").distinct(), "met-blocks")  # a number of blocks, squared
        ties = [F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)]
        placed = rows.join(F.broadcast(dealt(of_rows, "cell")), "cell").select(share("_row").alias("_block"), "_row", "cell", F.col(vector).alias("_vector"), *ties)
        sent = placed.join(F.broadcast(met), "_block")
        kind = T.StructType([kinds[0], *T.StructType.fromDDL("similarity double, _row long").fields, *placed.schema[-len(tie) :]])
        compared = partial(_closest, dimension=self.dimension, **table, k=k, tie=tie)
        found = wanting.groupBy("_of", "_block").cogroup(sent.groupBy("_of", "_block")).applyInArrow(compared, kind)

        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), *[f"_tie{i}" for i in range(len(tie))]))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "similarity", "_row")
        hits = ranked.join(rows.select("_row", *rest), "_row").select("query_id", "rank", "similarity", *rest)
        return hits, opened.select("query_id", F.lit(len(cells)).cast("long").alias("cells"), "cells_read")

    def _looked_at(self, pairs: DataFrame, rows: DataFrame, sizes: DataFrame, vector: str, k: int) -> DataFrame:
        """Of pairs (query_id, _asked, cell) the k largest cosines of each part of the cell: parts meet groups of queries."""
        many = pairs.groupBy("cell").agg(F.ceil(F.count("*") / TOGETHER).alias("_groups"))
        groups = pairs.join(many, "cell").withColumn("_of", F.pmod(F.xxhash64("query_id"), F.col("_groups")))
        together = groups.groupBy("cell", "_of").agg(F.collect_list(F.struct("query_id", "_asked")).alias("_queries"))
        parted = rows.join(F.broadcast(sizes), "cell").withColumn("_part", F.pmod(F.xxhash64("_row"), F.ceil(F.col("n") / PART)))
        parts = parted.groupBy("cell", "_part").agg(F.collect_list(vector).alias("_rows"))
        # The vectors go to the queries of their cell; both lists are about as long as TOGETHER and PART.
        met = together.join(parts, "cell").select("_queries", "_rows")
        kind = T.StructType([pairs.schema["query_id"], T.StructField("best", T.ArrayType(T.DoubleType()))])
        return met.mapInArrow(partial(_best_of_parts, dimension=self.dimension, k=k), kind)
