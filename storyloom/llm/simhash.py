"""SimHash near-deduplication with pivot distance tables.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half the XXH64 hashes of the text's word
shingles. Fingerprints that differ in at most ``radius`` bits are linked, and linked documents form components.

Search for links, over the distinct fingerprints only (copies share one):

1. Cells. The 64 bits are cut into b blocks; two fingerprints within the radius r agree in at least b - r blocks,
   so grouping by every choice of b - r blocks brings each linked pair together in some cell, with none lost. b
   grows with the number of fingerprints, so that a cell of random fingerprints stays small.
2. A cell beyond ``CELL`` fingerprints is cut into chunks, and each pair of chunks becomes a cell of its own.
3. Pivot tables. In a cell the Hamming distances of every fingerprint to ``PIVOTS`` reference fingerprints are
   tabulated. |d(x, p) - d(y, p)| <= d(x, y) for every reference p, so pairs whose largest coordinate difference
   exceeds the radius are discarded; rows are sorted by the first coordinate, so most are never formed. Survivors
   are verified by their exact distance.
4. A cell reports a spanning forest of its links, not all pairs, so a group of n near copies makes fewer than n
   links a cell. Components follow by star rounds over the links (storyloom.llm.graph).

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any
other; with fewer words than a shingle, the whole sequence is the one shingle; repeated rows and ids keep a row
each; null ids never become a component id unless all ids of the component are null; other columns are ignored
by ``near_duplicates`` and carried by ``survivors``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import prepare, raw, release, rows_of, settle
from storyloom.llm.graph import components

SEED = 42
RADIUS = 4
#: Fingerprints compared with one another in one cell.
CELL = 4096
#: Reference fingerprints, fixed by their seed; the first FIRST are applied to whole blocks of pairs.
PIVOTS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, (32, 4), dtype=np.uint64)
FIRST = 4
BLOCK = 256
#: Shingles hashed at once: bounds the memory that a very long text takes.
SPAN = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """The signed 64-bit fingerprint of UTF-8 text; A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(SEED))
    votes = np.zeros(64, np.int64)
    for at in range(0, n, SPAN):
        h = np.fromiter(islice(hashes, SPAN), np.uint64, min(SPAN, n - at))
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def _add_fingerprint(batches: Iterator[pa.RecordBatch], shingle: int, at: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        marks = pa.array((fingerprint(t, shingle) for t in raw(b.column(at))), pa.int64())
        yield pa.record_batch([*b.columns, marks], names=[*b.schema.names, "fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) of every row."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = plain.mapInArrow(partial(_add_fingerprint, shingle=shingle, at=1), "id long, text string, fp long")
    return marked.select("id", "fp")


def block_masks(n: int, radius: int) -> list[int]:
    """Bit masks of the cells' keys, so that about CELL of n random fingerprints at most share one."""
    blocks = radius + 1
    while n / 2 ** (64 * (blocks - radius) / blocks) > CELL and blocks < radius + 4:
        blocks += 1
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    whole = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances over the last axis, the words of a fingerprint."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def forest(marks: np.ndarray, radius: int) -> np.ndarray:
    """marks: (n, words). For each fingerprint of a cell the index of its component's first one, through the pivot table."""
    pivots = PIVOTS[:, : marks.shape[1]]
    table = np.stack([distance(marks, p) for p in pivots], axis=1)
    order = np.argsort(table[:, 0], kind="stable")
    marks, table = marks[order], table[order]
    label = np.arange(len(marks))
    first = np.ascontiguousarray(table[:, :FIRST].T)
    ends = np.searchsorted(first[0], first[0] + radius, side="right")
    for start in range(0, len(marks), BLOCK):
        stop = min(start + BLOCK, len(marks))
        end = ends[stop - 1]
        near = np.tri(stop - start, end - start, 0, dtype=bool)
        np.logical_not(near, out=near)  # each pair once
        for column in first:
            near &= np.abs(column[start:stop, None] - column[None, start:end]) <= radius
        i, j = np.nonzero(near)
        i, j = i + start, j + start
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        for at in range(0, len(i), 1 << 18):
            a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            close = (np.abs(table[a, FIRST:] - table[b, FIRST:]) <= radius).all(axis=1)
            a, b = a[close], b[close]
            linked = distance(marks[a], marks[b]) <= radius
            a, b = a[linked], b[linked]
            while len(a):
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
    roots = np.empty(len(marks), np.int64)
    roots[order] = order[label]
    return roots


def _link_cells(batches: Iterator[pa.RecordBatch], radius: int, words: int, few: int) -> Iterator[pa.RecordBatch]:
    """(t, key, i, j, name, words of the fingerprint), sorted by cell -> links (a, b) of names. Cells of few rows at
    most are compared together, and report all their links."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch | None:
        new = np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(rows)])
        a, b = [], []
        small = np.flatnonzero(np.repeat(sizes <= few, sizes))
        cell = np.cumsum(new)
        for k in range(1, few):
            x, y = small[:-k], small[k:]
            same = cell[x] == cell[y]
            x, y = x[same], y[same]
            near = distance(rows[x, 5 : 5 + words].view(np.uint64), rows[y, 5 : 5 + words].view(np.uint64)) <= radius
            a.append(rows[y[near], 4])
            b.append(rows[x[near], 4])
        large = sizes > max(1, few)
        for s, n in zip(starts[large], sizes[large], strict=True):
            names = rows[s : s + n, 4]
            root = forest(np.ascontiguousarray(rows[s : s + n, 5 : 5 + words]).view(np.uint64), radius)
            tied = np.flatnonzero(root != np.arange(n))
            a.append(names[tied])
            b.append(names[root[tied]])
        if a and sum(map(len, a)):
            return pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})
        return None

    for batch in rows_of(batches):
        rows = np.stack([np.asarray(c) for c in batch.columns], axis=1)
        tail = held[-1][-1, :4] if held else None
        if tail is not None and (rows[:, :4] == tail).all():
            held.append(rows)
            continue
        # All but the batch's last cell are complete.
        last = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1]) + 1 if (rows[:, :4] != rows[-1, :4]).any() else 0
        if out := links(np.concatenate([*held, rows[:last]])) if held or last else None:
            yield out
        held = [rows[last:]]
    if held and (out := links(np.concatenate(held))):
        yield out


def linked_cells(cells: DataFrame, radius: int, words: int, few: int = 0) -> DataFrame:
    """Rows (t, key, name, w0, w1, ...) -> links (a, b) of names. Crowded cells are cut into pairs of chunks."""
    marks = [f"w{i}" for i in range(words)]
    crowded = cells.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    chunks = F.coalesce(F.ceil(F.col("n") / (CELL / 2)), F.lit(1)).cast("long")
    dealt = cells.join(crowded, ["t", "key"], "left").select("t", "key", "name", *marks, chunks.alias("k"), F.pmod(F.xxhash64("name"), chunks).alias("c"))
    paired = dealt.select("t", "key", "name", *marks, "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
    placed = paired.select(F.col("t").cast("long"), "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "name", *marks)
    order = ["t", "key", "i", "j"]
    return placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(partial(_link_cells, radius=radius, words=words, few=few), "a long, b long")


def links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within the radius."""
    masks = block_masks(marks.count(), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)])
    return linked_cells(marks.select(F.col("fp").alias("name"), F.col("fp").alias("w0"), F.inline(tables)), radius, 1)


def grouped(marked: DataFrame, radius: int) -> DataFrame:
    """Settled (id, fp) -> (fp, component, keep_fp): component is the smallest id linked to fp, keep_fp its fingerprint."""
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))
    tied = components(links(marked.select("fp").distinct(), radius))
    labelled = settle(least.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    # Of fingerprints that hold the same smallest id the smallest stays; nulls count as larger than any id.
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", F.col("fp").alias("keep_fp")))
    best = settle(labelled.groupBy("root").agg(first.alias("first")), "best")  # a table of its own: a large component's rows can be split
    return labelled.join(best, "root").select("fp", F.col("first.least").alias("component"), "first.keep_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fingerprint (hex), component_id."""
    prepare(docs.sparkSession)
    marked = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = grouped(marked, radius).select("fp", F.col("component").alias("component_id"))
    return marked.join(found, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps one: that of its smallest id."""
    prepare(docs.sparkSession)
    marked = settle(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    keep = grouped(marked, radius).where(F.col("fp") == F.col("keep_fp")).select("fp", F.col("component").alias("keep_id"))
    at = docs.columns.index(text_col)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], T.StructField("fp", T.LongType())])
    rows = plain.mapInArrow(partial(_add_fingerprint, shingle=shingle, at=at), schema)
    own = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    kept = rows.join(keep, "fp").where(own.eqNullSafe(F.col("keep_id")))
    if marked.groupBy("id", "fp").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["fp"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


#: Words of a wide fingerprint, and the similarity from which texts are linked.
WORDS = 4
SIMILAR = 0.8
#: Standard deviations above the mean distance at which a pair of the threshold's similarity still is a candidate.
SPREAD = 7
#: One text of SAMPLE tells which shingles are common; at most COMMON of them, each in OFTEN texts of the sample.
SAMPLE = 32
OFTEN = 3
COMMON = 1 << 16
#: Shingles compared with one another in one cell are about twice as many.
CHUNK = 1 << 19
#: Rows of a cell of fingerprints that is compared along with others.
FEW = 8
#: 64-bit words of the bitmap that tells which texts have a candidate.
SLOTS = 1 << 16
#: Names up to which the table of those that several rows or texts have is broadcast (some 50 bytes each).
NAMES = 500_000
#: Rounding allowed where a share of a count is compared with a count.
EPSILON = 1e-9


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of UTF-8 text; words as for ``fingerprint``."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = map(xxhash.xxh3_64_intdigest, grams, repeat(SEED))
    return np.unique(np.concatenate([np.unique(np.fromiter(islice(hashes, SPAN), np.uint64, min(SPAN, n - at))) for at in range(0, n, SPAN)]))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """The 256-bit fingerprint of a set of shingles, as four signed words: each hash gives 256 bits by SplitMix64."""
    votes = np.zeros(64 * WORDS, np.int64)
    steps = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(found), SPAN // 8):
        z = found[at : at + SPAN // 8, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(found), bitorder="little").view(np.int64)


def wide_radius(similarity: float = SIMILAR) -> int:
    """The most bits in which texts of that Jaccard similarity are expected to differ: the angle between their
    shingle counts has cosine 2 s / (1 + s), and a bit differs with the angle's share of a half turn."""
    return int(64 * WORDS * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def candidate_radius(similarity: float = SIMILAR) -> int:
    """SPREAD standard deviations above ``wide_radius``: a pair of that similarity (0.8) is beyond it less than once in 10^9,
    but texts of four and five shingles some times in 10^6."""
    mean = wide_radius(similarity)
    return int(np.ceil(mean + SPREAD * np.sqrt(mean * (1 - mean / (64 * WORDS)))))


def prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's first shingles that sets of that similarity share one of them, whatever the order is, if it
    is the same for all: here by hash, but common ones (sorted by hash) last."""
    n = len(found) - int(np.ceil(similarity * len(found) - EPSILON)) + 1 if len(found) else 0
    if len(common):
        often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~often], found[often]])
    return found[:n]


def _sampled(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        yield pa.record_batch({"h": np.concatenate([shingle_set(t, shingle) for t in raw(b.column(0))]).view(np.int64)})


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts have. Which ones are found decides the cells' sizes, not the result."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = texts.mapInArrow(partial(_sampled, shingle=shingle), "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    top = counted.orderBy(F.desc("count"), "h").limit(COMMON).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def name_of(found: np.ndarray) -> int:
    """The name of a set of shingles; equal sets share one."""
    mark = xxhash.xxh3_64_intdigest(found.tobytes(), SEED)
    return mark - (1 << 64) if mark >> 63 else mark


def _sketched(batches: Iterator[pa.RecordBatch], shingle: int, common: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, the name of its set of shingles, its fingerprint, its prefix)."""
    for b in rows_of(batches):
        sets = [shingle_set(t, shingle) for t in raw(b.column(1))]
        marks = np.stack([wide_fingerprint(s) for s in sets])
        firsts = [prefix(s, common, similarity) for s in sets]
        offsets = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts).view(np.int64)))
        columns = [b.column(0), pa.array(map(name_of, sets), pa.int64()), *[pa.array(np.ascontiguousarray(marks[:, i])) for i in range(WORDS)], keys]
        yield pa.record_batch(columns, names=["id", "name", *[f"w{i}" for i in range(WORDS)], "keys"])


def _add_name(batches: Iterator[pa.RecordBatch], shingle: int, at: int) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        names = pa.array((name_of(shingle_set(t, shingle)) for t in raw(b.column(at))), pa.int64())
        yield pa.record_batch([*b.columns, names], names=[*b.schema.names, "name"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name), sorted -> the distinct rows whose key has several names."""
    tail = np.empty((0, 2), np.int64)
    told = False  # whether the row before the tail has the tail's key
    for b in rows_of(batches):
        rows = np.concatenate([tail, np.stack([np.asarray(c) for c in b.columns], axis=1)])
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
        # The last row waits, as its key may go on in the next batch.
        if len(rows) > 1:
            same = rows[1:, 0] == rows[:-1, 0]
            some = np.r_[told, same[:-1]] | same
            if some.any():
                yield pa.record_batch({"key": rows[:-1][some, 0], "name": rows[:-1][some, 1]})
            told = bool(same[-1])
        tail = rows[-1:]
    if told:
        yield pa.record_batch({"key": tail[:, 0], "name": tail[:, 1]})


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the index of its component's first one; sets of that Jaccard similarity or more are linked."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    label = np.full(len(sets), -1)
    left, flat, starts = np.arange(len(sets)), codes, ends - sizes
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], queue = first, [first]
        while queue:
            free = label[left] < 0
            if not free.any():
                break
            if 2 * free.sum() <= len(left):  # forget those that have their component
                flat = flat[np.repeat(free, sizes[left])]
                left, free = left[free], free[free]
                starts = np.cumsum(sizes[left]) - sizes[left]
            x = queue.pop()
            own = codes[ends[x] - sizes[x] : ends[x]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            near = left[free & (both >= similarity * (sizes[x] + sizes[left] - both) - EPSILON)]
            label[near] = first
            queue += near.tolist()
    return label


def _sets_of(batches: Iterator[pa.RecordBatch], shingle: int, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(text) -> (name, its set) of the names that the bitmap has."""
    for b in rows_of(batches):
        out: dict[int, bytes] = {}
        for t in raw(b.column(0)):
            found = shingle_set(t, shingle)
            name = name_of(found)
            if name not in out and int(slots[(name & (1 << 64) - 1) >> 6 & SLOTS - 1]) >> (name & 63) & 1:
                out[name] = found.tobytes()
        if out:
            yield pa.record_batch({"name": pa.array(out, pa.int64()), "set": pa.array(out.values(), pa.binary())})


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(root, i, j, name, set), sorted by cell -> links (a, b) of names whose sets are similar."""
    cell, names, sets = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        if len(names) > 1:
            held, root = np.array(names, np.int64), alike(sets, similarity)
            tied = np.flatnonzero(root != np.arange(len(held)))
            if len(tied):
                yield pa.record_batch({"a": held[tied], "b": held[root[tied]]})

    for b in rows_of(batches):
        root, i, j, name, found = (c.to_pylist() for c in b.columns)
        for k, at in enumerate(zip(root, i, j, strict=True)):
            if at != cell:
                yield from links()
                cell, names, sets = at, [], []
            names.append(name[k])
            sets.append(np.frombuffer(found[k], np.uint64))
    yield from links()


def _similar(texts: DataFrame, tied: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Texts and their components of candidates (name, root) -> links (a, b) of similar texts, and the settled sets that
    they are read from."""
    words = tied.groupBy(F.expr(f"pmod(shiftrightunsigned(name, 6), {SLOTS})").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(name & 63 as int)))").alias("bits"))
    slots = np.zeros(SLOTS, np.int64)
    for r in words.collect():
        slots[r["at"]] = r["bits"]
    sets = texts.mapInArrow(partial(_sets_of, shingle=shingle, slots=slots.view(np.uint64)), "name long, set binary")
    held = settle(sets.dropDuplicates(["name"]), "candidate-sets")
    return linked_sets(tied.join(held, "name"), similarity), held


def linked_sets(members: DataFrame, similarity: float) -> DataFrame:
    """Sets by component of candidates (name, root, set) -> links (a, b) of similar ones. Crowded components are cut into
    pairs of chunks."""
    crowded = members.groupBy("root").agg(F.sum(F.length("set") / 8).alias("n")).where(F.col("n") > 2 * CHUNK)
    chunks = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("long")
    dealt = members.join(crowded, "root", "left").select("root", "name", "set", chunks.alias("k"), F.pmod(F.xxhash64("name"), chunks).alias("c"))
    paired = dealt.select("root", "name", "set", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
    placed = paired.select("root", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "name", "set")
    order = ["root", "i", "j"]
    return placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(partial(_verified, similarity=similarity), "a long, b long")


def similar_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """The rows of docs, all columns, of which each component of similar texts keeps one: that of its smallest id.

    Texts are linked if the Jaccard similarity of their sets of shingles is at least that. Candidates share one of
    the first shingles of their sets, as all such pairs do (``prefix``), and their 256-bit fingerprints, compared in
    cells of a shingle each, differ in at most ``candidate_radius`` bits. Each component of candidates is then
    linked anew by its sets. Otherwise as ``survivors``.

    No table holds texts: rows are read again and named anew where they are needed, and tables go when they are used.
    Rows learn whether they stay from the names of several rows or of several texts alone, broadcast up to NAMES of
    them, joined by shuffle beyond.
    """
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index(text_col)
    marks = [f"w{i}" for i in range(WORDS)]
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text)
    sketch = partial(_sketched, shingle=shingle, common=common_shingles(docs, text_col, shingle), similarity=similarity)
    kind = f"id long, name long, {', '.join(f'{w} long' for w in marks)}, keys array<long>"
    sketches = settle(own.mapInArrow(sketch, kind), "sketches")
    distinct = settle(sketches.groupBy("name").agg(F.min("id").alias("least"), F.count("*").alias("rows"), *[F.first(w).alias(w) for w in marks]), "names")
    repeated = sketches.groupBy("id", "name").count().where("count > 1").limit(1).count() > 0

    keys = sketches.select(F.explode("keys").alias("key"), "name").repartition("key").sortWithinPartitions("key", "name")
    shared = keys.mapInArrow(_shared, "key long, name long")
    cells = settle(shared.join(distinct, "name").select(F.lit(0).cast("long").alias("t"), "key", "name", *marks), "wide-cells")
    release(sketches)
    near = components(linked_cells(cells, candidate_radius(similarity), WORDS, FEW)).withColumnRenamed("node", "name")
    release(cells)
    links_found, sets = _similar(own.select("text"), near, shingle, similarity)
    tied = components(links_found)
    release(sets)

    # Of each component one name stays, and of a name's rows that of the smallest id.
    labelled = settle(distinct.join(tied.withColumnRenamed("node", "name"), "name", "left").where("root is not null or rows > 1").select("name", "least", F.coalesce("root", "name").alias("root")), "labelled")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "name"))
    best = settle(labelled.groupBy("root").agg(first.alias("first")), "best")
    told = settle(labelled.join(best, "root").select("name", (F.col("name") == F.col("first.name")).alias("stays"), F.col("first.least").alias("keep_id")), "told")
    release(labelled, best, distinct)
    n = told.count()
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    named = plain.mapInArrow(partial(_add_name, shingle=shingle, at=at), T.StructType([*plain.schema.fields, T.StructField("name", T.LongType())]))
    joined = named.join(F.broadcast(told) if n <= NAMES else told, "name", "left")
    mine = F.col(f"c{docs.columns.index(id_col)}").cast("long").eqNullSafe(F.col("keep_id"))
    kept = joined.where(F.col("stays").isNull() | (F.col("stays") & mine))
    if repeated:
        kept = kept.dropDuplicates(["name"])
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
