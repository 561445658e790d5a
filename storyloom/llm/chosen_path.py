"""Near-duplicates by a chosen-path set similarity join.

A document is its set of distinct word shingles. Documents whose sets have at least the wanted Jaccard similarity are
linked; linked documents form components.

1. Signature. FUNCTIONS minwise hash functions each select one token of a set: two sets of similarity s have the same
   one with probability s. 16 bits of each token are kept, and two more of each make a fingerprint of 256 bits.
2. Trees. In each of TREES trees a node hands its documents down to children: it chooses two of the functions, and a
   document goes, for each of the two, to the child of the token that it selects. A node of at most LEAF documents is
   a leaf, as is one that is hardly smaller than its parent (its documents are alike, so going on would not separate
   them). The recursion is by level: all nodes of a depth are counted in one aggregate, which needs keys and names
   only, and only documents of crowded nodes get their signature again to go on.
3. A pair of similarity 0.8 stays together in a tree with a probability of at least 0.9375 (the fixed point of
   q = (0.2 + 0.8 q)^2 is a loss of 1/16), and trees choose different functions, so all TREES of them lose it with
   1/16^8, some 2 in 10^10; more similar ones less.
4. Leaves are compared exhaustively, by fingerprints: a pair within the radius, SPREAD standard deviations above the
   mean distance of pairs of the threshold, is a candidate. A leaf of any size is compared whole, cut into pairs of
   chunks beyond 4,096.
5. The full sets of each component of candidates are then linked by exact intersection and union.

Equal sets share one name and are compared once; a group of copies of any size is one member of its nodes.

Defined results: words end at ASCII white space, A-Z are lower-cased; with fewer words than a shingle the whole
sequence is the one shingle; null and empty texts and texts without words have no shingle and are linked with
nothing; repeated rows and ids keep a row each; null ids never become a component id unless all ids of the component
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import prepare, raw, release, rows_of, settle
from storyloom.llm.graph import components
from storyloom.llm.simhash import NAMES, WORDS, linked_cells, linked_sets, name_of, shingle_set

TREES = 8
FUNCTIONS = 128
#: Documents that a node has at most to be compared at once.
LEAF = 256
#: A child that keeps this share of its parent's documents is a leaf.
ALIKE = 0.5
#: Depth at which every node is a leaf.
DEPTH = 10
#: Standard deviations above the mean distance up to which a pair of the threshold's similarity is a candidate.
SPREAD = 7
#: Rows of a leaf that is compared along with others.
FEW = 16
#: Shingles hashed by all functions at once.
STEP = 4096

_random = np.random.Generator(np.random.PCG64(20240611))
FACTORS = _random.integers(0, 1 << 31, (FUNCTIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, (FUNCTIONS, 1), dtype=np.uint32)
MARKS = [f"w{i}" for i in range(WORDS)]


def selected(found: np.ndarray) -> np.ndarray:
    """The smallest value of each function over a set's hashes."""
    least = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    high = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), STEP):
        np.minimum(least, (FACTORS * high[None, at : at + STEP] + SHIFTS).min(axis=1), out=least)
    return least


def tokens(least: np.ndarray) -> np.ndarray:
    """16 bits of each selected token."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def fingerprints(least: np.ndarray) -> np.ndarray:
    """Rows of selected tokens -> rows of 256 bits, two of each token."""
    two = (least * np.uint32(0x85EBCA6B)) >> np.uint32(30)
    bits = np.stack([two & 1, two >> 1], axis=-1).astype(np.uint8).reshape(len(least), 2 * FUNCTIONS)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def radius_of(similarity: float) -> int:
    """Of two sets a function's bits differ with probability 1 - s, and then each of the two in half of all cases."""
    apart = 1 - similarity
    return int(np.ceil(FUNCTIONS * apart + SPREAD * np.sqrt(FUNCTIONS * (1.5 * apart - apart**2))))


def function_of(tree: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The function by which the child at a place (numbered as in a heap) is chosen. Down to the third level no two
    places share one; below, they are drawn."""
    own = FUNCTIONS // TREES
    drawn = (place * 0x9E3779B1 + tree * 0x85EBCA6B) % 2**32 * FUNCTIONS >> 32
    return np.where(place < 16, tree * own + place - 2, drawn)


def child_keys(key: np.ndarray, node: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of children by their parents' keys, their places and the tokens that led there."""
    z = key.view(np.uint64) ^ ((node.astype(np.uint64) << np.uint64(16)) | token.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def branched(key: np.ndarray, node: np.ndarray, token: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Both children of each row: (keys, nodes). node: tree << 16 | place; token: rows of the signature."""
    out = []
    for side in (0, 1):
        child = (node >> 16 << 16) | (2 * (node & 0xFFFF) + side)
        taken = token[np.arange(len(node)), function_of(node >> 16, child & 0xFFFF)]
        out.append((child_keys(key, child, taken), child))
    return out


def _sketched(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) -> (id, mark, name, n, fingerprint, tokens) of its set; sets without shingles have no name."""
    for b in rows_of(batches):
        sets = [shingle_set(t, shingle) for t in raw(b.column(2))]
        least = np.stack([selected(s) for s in sets])
        words = fingerprints(least)
        names = pa.array([name_of(s) if len(s) else None for s in sets], pa.int64())
        sizes = pa.array([len(s) for s in sets], pa.int64())
        packed = pa.array([t.tobytes() for t in tokens(least)], pa.binary())
        columns = [b.column(0), b.column(1), names, sizes, *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)], packed]
        yield pa.record_batch(columns, names=["id", "mark", "name", "n", *MARKS, "tokens"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, name, n, tokens) -> the children (key, node, name, parent's n)."""
    for b in rows_of(batches):
        key, node, name, n = (np.asarray(c) for c in b.columns[:4])
        token = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint16).reshape(len(key), FUNCTIONS)
        for keys, nodes in branched(key, node, token):
            yield pa.record_batch({"key": keys, "node": nodes, "name": name, "parent": n})


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, tokens) -> the members (key, node, name, parent's n) of every tree's first level."""
    for b in rows_of(batches):
        name = np.asarray(b.column(0))
        token = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(name), FUNCTIONS)
        none = np.full(len(name), np.iinfo(np.int64).max)
        for tree in range(TREES):
            root = np.full(len(name), tree << 16 | 1, np.int64)
            for keys, nodes in branched(np.zeros(len(name), np.int64), root, token):
                yield pa.record_batch({"key": keys, "node": nodes, "name": name, "parent": none})


def leaves(distinct: DataFrame) -> DataFrame:
    """Settled (name, tokens) -> (key, name): the leaves of all trees that hold several documents."""
    kind = "key long, node long, name long, parent long"
    level = settle(distinct.select("name", "tokens").mapInArrow(_rooted, kind), "nodes")
    found = None
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        held = settle(level.join(sizes, "key").select("key", "node", "name", "n", "parent"), "sized-nodes")
        release(level)
        done = (F.col("n") <= LEAF) | (F.col("n") >= ALIKE * F.col("parent")) if depth < DEPTH else F.lit(True)
        ended = held.where(done).select("key", "name")
        found = ended if found is None else found.unionByName(ended)
        crowded = held.where(~done)
        if crowded.isEmpty():
            break
        level = settle(crowded.join(distinct.select("name", "tokens"), "name").select("key", "node", "name", "n", "tokens").mapInArrow(_branch, kind), "nodes")
    return found


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(name, text) -> (name, set), each name once a task."""
    seen: set[int] = set()
    for b in rows_of(batches):
        names = b.column(0).to_pylist()
        new = [i for i, x in enumerate(names) if x not in seen and not seen.add(x)]
        if new:
            texts = raw(b.column(1).take(pa.array(new)))
            yield pa.record_batch({"name": pa.array([names[i] for i in new], pa.int64()), "set": pa.array([shingle_set(t, shingle).tobytes() for t in texts], pa.binary())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reached by links, its own included).

    The sets of candidates are made from the texts once more; which texts these are is joined by a hash of the text,
    broadcast up to NAMES of them."""
    prepare(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    kind = f"id long, mark long, name long, n long, {', '.join(f'{w} long' for w in MARKS)}, tokens binary"
    sketches = settle(own.mapInArrow(partial(_sketched, shingle=shingle), kind), "sketches")
    one = [F.first(c).alias(c) for c in (*MARKS, "tokens")]
    distinct = settle(sketches.where("name is not null").groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.min("mark").alias("mark"), *one), "names")

    cells = settle(leaves(distinct).join(distinct.select("name", *MARKS), "name").select(F.lit(0).cast("long").alias("t"), "key", "name", *MARKS), "leaves")
    near = components(linked_cells(cells, radius_of(similarity), WORDS, FEW)).withColumnRenamed("node", "name")
    release(cells)
    tied = settle(near.join(distinct.select("name", "mark"), "name"), "candidates")
    picked = tied.select("mark", "name")
    texts = own.select("mark", "text").join(F.broadcast(picked) if picked.count() <= NAMES else picked, "mark").select("name", "text")
    sets = settle(texts.mapInArrow(partial(_sets, shingle=shingle), "name long, set binary").dropDuplicates(["name"]), "candidate-sets")
    linked = components(linked_sets(tied.select("name", "root").join(sets, "name"), similarity)).withColumnRenamed("node", "name")
    release(sets, tied)

    # Only names of several rows or with links say more than their rows do.
    labelled = settle(distinct.join(linked, "name", "left").where("root is not null or rows > 1").select("name", "least", F.coalesce("root", "name").alias("root")), "labelled")
    best = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    told = settle(labelled.join(best, "root").select("name", "component_id", F.lit(True).alias("told")), "told")
    release(labelled)
    rows = sketches.select("id", "name", F.col("n").alias("n_shingles"))
    return rows.join(told, "name", "left").select("id", "n_shingles", F.when(F.col("told"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
