"""Exact top-k inner-product search with dual cover trees.

Queries and data are both indexed. Every vector is dealt to a cell (that of the best of a bounded number of sampled
pivots, by distance) and a cell to blocks of bounded size; each block gets a cover tree: a node has a centre, a
radius that covers all its points, and children whose centres are a net of a smaller radius. A search walks a tree
of queries and a tree of data together. No query q of a node with centre c and radius r and no point p of a data
node with centre d and radius s can score above <c, d> + r |d| + s |c| + r s, so a pair of nodes whose bound lies
below the worst kth score among the node's queries is pruned; pairs are tried in the order of their bounds.

In Spark, first every query block searches the few data blocks of the largest bounds, which gives each query block
its worst kth score; then the block pairs that this score does not rule out are searched, and the lists are merged by
rank. Bounds are computed from centres and radii, for CHUNK blocks against CHUNK blocks at once, and only pairs to be
searched become rows. A task holds one data block's tree and reads the trees of its query blocks as a stream, up to
LANE of them, so a data block is sent once for each LANE query blocks that need it. A node in which a net of smaller
radius covers next to nothing, as in vectors without structure, is a leaf whatever its size: its products are formed
as one matrix.

Arithmetic is exact: scores are integer products, computed in floating point only where every partial sum is below
2**53, in Python integers otherwise; bounds carry a margin for rounding. Scores beyond 64 bits are clamped.

Defined results: vectors that are null, or hold null or non-finite components, take no part; only vectors of equal
length are compared; rows with a null id take no part (they could neither be named nor told from a query's own);
rows that share an id are candidates each, and none is a candidate for that id's query; of several query rows with
one id the smallest vector asks; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import prepare, release, rows_of, settle

BLOCK = 4096
QUERY_BLOCK = 1024
#: Sampled rows whose vectors the cells lie around: a bound, whatever the table's size.
PIVOTS = 64
LEAF = 64
#: A child's radius, as a share of its parent's.
SHRINK = 0.8
#: Data blocks that each query block searches for its first scores.
FIRST = 2
#: Blocks whose bounds are computed at once, and query blocks that are searched beside one copy of a data block.
CHUNK = 1024
LANE = 64
MARGIN = 1e-9


def floored(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as double times scale."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and all components there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


class Node:
    """Points of one block: ids and vectors are rows of the block's arrays; a leaf has no children."""

    __slots__ = ("centre", "radius", "rows", "children", "norm")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(vectors: np.ndarray) -> Node:
    """The cover tree over all rows of vectors (as float64)."""
    points = vectors.astype(np.float64)
    squares = np.einsum("ij,ij->i", points, points)

    def distances(centre: np.ndarray, rows: np.ndarray) -> np.ndarray:
        gap = squares[rows] - 2 * (points[rows] @ centre) + centre @ centre
        return np.sqrt(np.maximum(gap, 0)) * (1 + MARGIN) + MARGIN

    def node(centre: np.ndarray, rows: np.ndarray, away: np.ndarray) -> Node:
        radius = float(away.max())
        if len(rows) <= LEAF or radius <= 2 * MARGIN:
            parts = [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
            if len(parts) == 1:
                return Node(centre, radius, rows, [])
            return Node(centre, radius, rows, [Node(centre, radius, p, []) for p in parts])
        children, loose = [], []
        left, gap = rows, away
        # The net: its first centre is the node's own, the next ones are points that no earlier one covers.
        at = centre
        while len(left):
            near = gap <= radius * SHRINK
            if near.sum() > LEAF // 8:
                children.append(node(at, left[near], gap[near]))
            elif near.any():
                loose.append(left[near])
            left = left[~near]
            if sum(map(len, loose)) + len(children) * LEAF > len(rows) or not len(left):
                break
            at = points[left[0]]
            gap = distances(at, left)
        if not children:
            return Node(centre, radius, rows, [])
        loose = np.concatenate([*loose, left]) if loose or len(left) else left
        for i in range(0, len(loose), LEAF):
            part = loose[i : i + LEAF]
            middle = points[part].mean(axis=0)
            children.append(Node(middle, float(distances(middle, part).max()), part, []))
        return Node(centre, radius, rows, children)

    every = np.arange(len(points))
    start = points.mean(axis=0)
    return node(start, every, distances(start, every))


def packed(ids: np.ndarray, vectors: np.ndarray, bound: int) -> bytes:
    """A block with its tree; bound: the largest magnitude of a component."""
    small = vectors.astype(np.int32) if bound < 2**31 else vectors
    return pickle.dumps((ids, small, cover_tree(vectors), bound), protocol=5)


def scores(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """All inner products, exact; clamped to 64 bits."""
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far, by score downwards, then id upwards."""

    def __init__(self, n: int, k: int, worst: np.ndarray):
        self.k, self.score, self.id = k, np.full((n, k), np.iinfo(np.int64).min), np.full((n, k), np.iinfo(np.int64).max)
        self.seen = np.zeros(n, np.int64)
        self.start = worst  # scores below it are known not to count

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.start[rows])

    def add(self, rows: np.ndarray, found: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        valid = valid & (found >= self.worst(rows)[:, None])
        some = valid.any(axis=1)
        rows, found, valid = rows[some], found[some], valid[some]
        if not len(rows):
            return
        if found.shape[1] > 4 * self.k:
            # Of many products only those that reach a row's own kth largest can matter.
            own = np.where(valid, found, np.iinfo(np.int64).min)
            valid = valid & (own >= np.partition(own, -self.k, axis=1)[:, -self.k, None])
        used = valid.any(axis=0)
        found, valid, ids = found[:, used], valid[:, used], ids[used]
        # np.iinfo.min with the largest id marks an empty place; a clamped score of a real row stays apart by its id.
        score = np.concatenate([self.score[rows], np.where(valid, found, np.iinfo(np.int64).min)], axis=1)
        named = np.concatenate([self.id[rows], np.where(valid, ids[None, :], np.iinfo(np.int64).max)], axis=1)
        order = np.lexsort((named, ~score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, axis=1)
        self.id[rows] = np.take_along_axis(named, order, axis=1)
        self.seen[rows] = np.minimum(self.k, self.seen[rows] + valid.sum(axis=1))


def bound_of(a_norm, a_radius, b_norm, b_radius, product):
    top = product + a_radius * b_norm + b_radius * a_norm + a_radius * b_radius
    return top + MARGIN * (1 + a_norm + a_radius) * (1 + b_norm + b_radius)


def dual_search(queries: tuple, data: tuple, best: Best) -> int:
    """Search a data tree for all queries of a query tree; the number of products that were computed."""
    q_ids, q_vectors, q_root, q_top = queries
    d_ids, d_vectors, d_root, d_top = data
    top = q_vectors.shape[1] * q_top * d_top
    formed = 0

    def visit(q: Node, d: Node) -> None:
        nonlocal formed
        if not q.children and not d.children:
            rows = q.rows
            found = scores(q_vectors[rows], d_vectors[d.rows], top)
            formed += found.size
            best.add(rows, found, d_ids[d.rows], q_ids[rows][:, None] != d_ids[d.rows][None, :])
            return
        qs, ds = q.children or [q], d.children or [d]
        a, b = np.stack([x.centre for x in qs]), np.stack([x.centre for x in ds])
        norms = [np.array([x.norm for x in s]) for s in (qs, ds)]
        radii = [np.array([x.radius for x in s]) for s in (qs, ds)]
        bounds = bound_of(norms[0][:, None], radii[0][:, None], norms[1][None, :], radii[1][None, :], a @ b.T)
        for at in np.argsort(-bounds, axis=None):
            i, j = divmod(int(at), len(ds))
            if bounds[i, j] >= best.worst(qs[i].rows).min():
                visit(qs[i], ds[j])

    visit(q_root, d_root)
    return formed


def _dealt(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(id, vec) -> (id, dim, cell, vec as bytes, bound)."""
    for b in rows_of(batches):
        rows = b.column(1).to_pylist()
        dims = [len(v) for v in rows]
        cells = np.zeros(len(rows), np.int64)
        for dim in set(dims) & pivots.keys():
            at = [i for i, n in enumerate(dims) if n == dim]
            points, centres = np.array([rows[i] for i in at], np.float64), pivots[dim]
            cells[at] = (np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * points @ centres.T).argmin(axis=1)
        yield pa.record_batch(
            {
                "id": b.column(0),
                "dim": pa.array(dims, pa.int32()),
                "cell": pa.array(cells, pa.int32()),
                "vec": pa.array([np.array(v, np.int64).tobytes() for v in rows], pa.binary()),
                "bound": pa.array([max(map(abs, v), default=0) for v in rows], pa.decimal128(38, 0)),
            }
        )


def _tree(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["id", "vec"])
    vectors = np.frombuffer(b"".join(rows["vec"]), np.int64).reshape(len(rows), -1)
    ids = rows["id"].to_numpy(np.int64)
    bound = int(rows["bound"].max())
    blob = packed(ids, vectors, bound)
    root = pickle.loads(blob)[2]
    out = rows.head(1)[["dim", "block"]].copy()
    out["tree"], out["centre"], out["radius"], out["norm"] = [blob], [root.centre.tolist()], root.radius, root.norm
    return out


def trees(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of at most about size rows: dim, block, tree, centre, radius, norm."""
    held = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).alias("chunks"))
    dealt = rows.join(held, ["dim", "cell"])
    block = F.xxhash64("cell", F.pmod(F.xxhash64("id", "vec"), F.col("chunks")))
    kind = "dim int, block long, tree binary, centre array<double>, radius double, norm double"
    return dealt.withColumn("block", block).groupBy("dim", "block").applyInPandas(_tree, kind)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(side, tree, worst) -> query_id, id, score: each data tree (side 0) is followed by its queries' trees (side 1)."""
    data = None
    for b in rows_of(batches):
        for side, blob, floor in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if side == 0:
                data = pickle.loads(blob)
                continue
            queries = pickle.loads(blob)
            n = len(queries[0])
            start = np.full(n, np.iinfo(np.int64).min) if floor is None else np.frombuffer(floor, np.int64)
            best = Best(n, k, start)
            dual_search(queries, data, best)
            there = np.arange(k)[None, :] < best.seen[:, None]
            yield pa.record_batch({"query_id": np.repeat(queries[0], k).reshape(n, k)[there], "id": best.id[there], "score": best.score[there]})


FOUND = "query_id long, id long, score long"
PAIRS = "dim int, q_block long, block long, bound double"


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one chunk: (block numbers, centres, radii, norms, least scores) as one value."""
    rows = rows.sort_values("block")
    least = rows["least"].to_numpy(np.int64) if "least" in rows else None
    held = (rows["block"].to_numpy(np.int64), np.stack(rows["centre"].to_list()), rows["radius"].to_numpy(), rows["norm"].to_numpy(), least)
    return rows.head(1)[["dim", "chunk"]].assign(held=[pickle.dumps(held, protocol=5)])


def summaries(blocks: DataFrame) -> DataFrame:
    """Blocks (dim, block, centre, radius, norm[, least]) -> settled (dim, chunk, held), about CHUNK blocks a row."""
    per = blocks.groupBy("dim").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))  # a row for each length of vectors
    dealt = blocks.join(per, "dim").withColumn("chunk", F.pmod(F.xxhash64("block"), F.col("chunks"))).drop("chunks")
    return settle(dealt.groupBy("dim", "chunk").applyInPandas(_summary, "dim int, chunk long, held binary"), "summaries")


def _bounded(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
    """(dim, queries' blocks, data's blocks) -> pairs: the first ones of each query block, or those that its least score allows."""
    for b in rows_of(batches):
        for dim, q_held, d_held in zip(*(c.to_pylist() for c in b.columns), strict=True):
            (q, q_centre, q_radius, q_norm, least), (d, d_centre, d_radius, d_norm, _) = pickle.loads(q_held), pickle.loads(d_held)
            bounds = bound_of(q_norm[:, None], q_radius[:, None], d_norm[None, :], d_radius[None, :], q_centre @ d_centre.T)
            if first:
                order = np.argsort(-bounds, axis=1, kind="stable")[:, :first]
                i, j = np.repeat(np.arange(len(q)), order.shape[1]), order.reshape(-1)
            else:
                i, j = np.nonzero(bounds >= least[:, None])
            yield pa.record_batch({"dim": pa.array([dim] * len(i), pa.int32()), "q_block": q[i], "block": d[j], "bound": bounds[i, j]})


def block_pairs(asked: DataFrame, held: DataFrame, first: int = 0) -> DataFrame:
    """Summaries of query blocks and of data blocks -> pairs, chunk by chunk."""
    chunks = asked.select("dim", F.col("chunk").alias("q_chunk")).join(held.select("dim", F.col("chunk").alias("d_chunk")), "dim")
    both = chunks.join(asked.select("dim", F.col("chunk").alias("q_chunk"), F.col("held").alias("q_held")), ["dim", "q_chunk"])
    both = both.join(held.select("dim", F.col("chunk").alias("d_chunk"), F.col("held").alias("d_held")), ["dim", "d_chunk"])
    return both.repartition("dim", "q_chunk", "d_chunk").select("dim", "q_held", "d_held").mapInArrow(partial(_bounded, first=first), PAIRS)


def searched(chosen: DataFrame, q: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """Settled pairs (dim, q_block, block), query trees (dim, block, tree, floor), data trees -> query_id, id, score."""
    lanes = chosen.groupBy("dim", "block").agg(F.ceil(F.count("*") / LANE).alias("lanes"))
    held = lanes.join(d.select("dim", "block", "tree"), ["dim", "block"])
    held = held.select("dim", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"), F.lit(0).alias("side"), "tree", F.lit(None).cast("binary").alias("floor"))
    asked = chosen.join(lanes, ["dim", "block"]).join(q.select("dim", F.col("block").alias("q_block"), "tree", "floor"), ["dim", "q_block"])
    asked = asked.select("dim", "block", F.pmod(F.xxhash64("q_block"), F.col("lanes")).alias("lane"), F.lit(1).alias("side"), "tree", "floor")
    at = ["dim", "block", "lane"]
    dealt = held.unionByName(asked).repartition(*at).sortWithinPartitions(*at, "side")
    return dealt.select("side", "tree", "floor").mapInArrow(partial(_search, k=k), FOUND)


def top_k(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """queries and data: (id, vec array<long>) -> query_id, rank, id, score: for each query its k best other rows."""
    spark = data.sparkSession
    prepare(spark)
    data = data.select(F.col("id").cast("long"), F.col("vec").cast("array<long>")).where("id is not null")
    queries = queries.select(F.col("id").cast("long"), F.col("vec").cast("array<long>")).where("id is not null").groupBy("id").agg(F.min("vec").alias("vec"))
    sampled = data.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots: dict[int, list] = {}
    for r in sampled:
        pivots.setdefault(len(r["vec"]), []).append(r["vec"])
    pivots = {n: np.array(v, np.float64).reshape(len(v), n) for n, v in pivots.items()}
    kind = "id long, dim int, cell int, vec binary, bound decimal(38,0)"
    deal = partial(_dealt, pivots=pivots)
    vectors = settle(data.mapInArrow(deal, kind), "vectors")
    d = settle(trees(vectors, BLOCK), "trees")
    release(vectors)
    q = settle(trees(queries.mapInArrow(deal, kind), QUERY_BLOCK), "query-trees")
    spheres = ["dim", "block", "centre", "radius", "norm"]
    held = summaries(d.select(spheres))

    # The data blocks of the largest bounds come first, for each query block.
    order = Window.partitionBy("dim", "q_block").orderBy(F.desc("bound"), "block")
    best = block_pairs(summaries(q.select(spheres)), held, FIRST).withColumn("nth", F.row_number().over(order))
    early = settle(best.where(F.col("nth") <= FIRST).select("dim", "q_block", "block"), "first-pairs")
    first = settle(searched(early, q.withColumn("floor", F.lit(None).cast("binary")), d, k), "first")
    # Each query's kth score so far rules out block pairs, and rows within those that remain.
    best_first = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    kth = best_first.select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).alias("kth"))
    floors = settle(_floors_of(q.select("dim", "block", "tree"), kth), "floors")
    rest = block_pairs(summaries(q.select(spheres).join(floors.select("dim", "block", "least"), ["dim", "block"])), held)
    chosen = settle(rest.select("dim", "q_block", "block").join(early, ["dim", "q_block", "block"], "left_anti"), "pairs")
    found = first.unionByName(searched(chosen, q.join(floors.select("dim", "block", "floor"), ["dim", "block"]), d, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        for dim, block, tree in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids = pickle.loads(tree)[0]
            n = len(ids)
            yield pa.record_batch({"dim": pa.array([dim] * n, pa.int32()), "block": pa.array([block] * n, pa.int64()), "at": pa.array(range(n), pa.int32()), "query_id": pa.array(ids, pa.int64())})


def _floor_rows(rows: pd.DataFrame) -> pd.DataFrame:
    low = np.iinfo(np.int64).min
    floor = np.array([low if pd.isna(x) else int(x) for x in rows.sort_values("at")["kth"].astype(object)], np.int64)
    return pd.DataFrame({"dim": rows["dim"].iloc[:1], "block": rows["block"].iloc[:1], "floor": [floor.tobytes()], "least": [floor.min()]})


def _floors_of(members: DataFrame, kth: DataFrame) -> DataFrame:
    """For each query block its queries' kth scores so far, in the order of its tree, and the least of them."""
    listed = members.mapInArrow(_ids, "dim int, block long, at int, query_id long")
    joined = listed.join(kth, "query_id", "left").select("dim", "block", "at", F.col("kth").cast("string").alias("kth"))
    return joined.groupBy("dim", "block").applyInPandas(_floor_rows, "dim int, block long, floor binary, least long")
