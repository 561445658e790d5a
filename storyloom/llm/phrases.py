"""Phrase collocations counted through minimal perfect hashes.

A phrase is 2 to LONGEST words that stand together in a piece of text between punctuation marks or line ends. Frequent
phrases are found length by length; a phrase can only be frequent if both phrases that it has but for its last and
its first word are (Apriori).

1. Words. A task codes its texts once, by local numbers, in rows that hold their own words; words and counts go through
   one aggregate, which gives the frequent words their numbers and each language its total. The frequent words go to
   all tasks (in shards of VOCABULARY, one after the other), and each row finds the numbers of its own words. What
   follows reads sequences of numbers, in which everything else is a break.
2. A level. In the sequence of frequent phrases of k - 1 words, two neighbours that overlap are a phrase of k words
   whose parts are frequent: its key is the pair of their numbers, exactly 64 bits.
   - Mappers count keys by hashed buckets (bincount); the arrays are summed in a tree. A bucket below the threshold
     holds no frequent phrase. Buckets follow the pairs and the threshold: their mean load is a quarter of it at most.
     On a large level, the keys in the other buckets are counted once more by buckets of another hash.
   - The distinct keys that are left are the candidates. They are looked for in portions of the sequences, each three
     times as large as all before it, and a task gives out only keys that no portion before had: so a key is given out
     a few times, however many tasks meet it. A minimal perfect hash over them, whose keys are stored by slot, is built
     for each shard of about SLOTS keys.
   - Mappers look up the slots of their keys, verified against the stored ones, and bincount them; the arrays are
     summed in a tree, and the slots that reach the threshold are the frequent phrases, with exact counts.
   - The sequence is written anew with their slots as numbers, and the next level reads that.
3. Cuts. A phrase's first words are the first words of its head, and so on, so the counts of all parts come from the
   tables of the lengths below, read by slot: a join with the head's and one with the tail's row. A phrase inside a
   longer one that is as frequent is inside one that has one word more and is as frequent, so only these are looked at.

All counts are exact; scores are computed in decimals of 38 digits. Slots are numbers below 2^32 a level.

Defined results: null text counts as empty; a null language is ``und``; A-Z are lower-cased; repeated rows count each;
ties go by count and then by the phrase's bytes; an empty table, and one without frequent phrases, give no rows; ids
and other columns play no part. A very long text is read in parts, cut at a space, and counts as one.
"""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import numbered, prepare, raw, release, rows_of, settle, trim
from storyloom.llm.perfect_hash import PerfectHash, mixed

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Keys of one perfect hash: what a mapper holds is some 30 bytes a key.
SLOTS = 1 << 21
#: Frequent words that a task looks up at once, some 100 bytes each.
VOCABULARY = 1 << 19
#: Tokens and distinct words that a task codes together.
TOKENS = 1 << 18
DISTINCT = 100_000
#: Characters split at once.
CHARS = 1 << 20
#: Counters that a task keeps as one array; beyond, it gives out what each row of the input has.
DENSE = 1 << 22
#: Keys of candidates that a task holds before it gives them out.
TOGETHER = 1 << 20
#: Buckets of a hash at most: their bits reach the driver. Beyond, more keys are candidates; the result is the same.
BUCKETS = 1 << 29
#: Buckets of a hash from which on a second one is worth its pass.
TWICE = 1 << 19
#: Files of the first portion that candidates are looked for in, and keys at most that tasks are told of, 8 bytes each;
#: those beyond are given out again by later portions.
FIRST = 4
KNOWN = 1 << 22
#: Counters summed together, and the lanes of the first round of sums.
CHUNK = 1 << 16
LANES = 16

#: A-Z lower-cased, and all marks that end a piece made one, which is no part of any word then.
MARK = b"."
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + MARK * 9)
SEQUENCE = "ids binary, pairs long"


def split_words(text: bytes) -> Iterator[list[bytes]]:
    """The words and marks of a text, in parts of about CHARS bytes; a mark stands at its end."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + CHARS)
        end = len(text) if end < 0 else end
        yield text[at:end].translate(PLAIN).replace(MARK, b" . ").split()
        at = end
    yield [MARK]


CODED = "lang string, words binary, counts binary, codes binary"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> rows of CODED: a batch's words of one language, how often each occurs, and its texts as numbers
    of these words, from 1; 0 is a break."""
    words: dict[str, dict[bytes, int]] = {}
    codes: dict[str, list[np.ndarray]] = defaultdict(list)
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        for lang, own in words.items():
            together = np.concatenate(codes[lang])
            counts = np.bincount(together, minlength=len(own))[1:]
            parts = [b" ".join(list(own)[1:]), counts.tobytes(), together.tobytes()]
            yield pa.record_batch([pa.array([lang], pa.string()), *[pa.array([x], pa.binary()) for x in parts]], names=["lang", "words", "counts", "codes"])
            own.default_factory = None  # it holds the words themselves, which would stay until cycles are looked for
        words.clear()
        codes.clear()
        held = 0
        trim()

    for b in rows_of(batches):
        for lang, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
            if lang not in words:
                words[lang] = defaultdict(None, {MARK: 0})
                words[lang].default_factory = words[lang].__len__
            code = words[lang].__getitem__
            for part in split_words(text):
                codes[lang].append(np.fromiter(map(code, part), np.int32, len(part)))
                held += len(part)
            if held >= TOKENS or sum(map(len, words.values())) >= DISTINCT:
                yield from flush()
    yield from flush()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words, counts) -> (lang, word, n)."""
    for b in rows_of(batches):
        for lang, words, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if words:
                own = pa.array(words.split(b" "), pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([lang] * len(own), pa.string()), own, pa.array(np.frombuffer(counts, np.int64))], names=["lang", "word", "n"])


def numbers_of(lang: str, words: bytes, known: dict[str, dict[bytes, int]]) -> np.ndarray:
    """The numbers of a row's words, -1 for those that are not known."""
    own = words.split(b" ") if words else []
    return np.fromiter(map(known.get(lang, {}).get, own, repeat(-1)), np.int64, len(own))


def _looked_up(batches: Iterator[pa.RecordBatch], told) -> Iterator[pa.RecordBatch]:
    """(lang, words, codes, numbers) -> the same with the numbers of those words that are told."""
    for b in rows_of(batches):
        for lang, words, codes, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
            numbers = numbers_of(lang, words, told.value)
            if before is not None:
                numbers = np.maximum(numbers, np.frombuffer(before, np.int64))
            columns = [pa.array([lang], pa.string()), *[pa.array([x], pa.binary()) for x in (words, codes, numbers.tobytes())]]
            yield pa.record_batch(columns, names=["lang", "words", "codes", "numbers"])


def squeezed(ids: np.ndarray) -> np.ndarray:
    """Runs of two numbers or more, each followed by one break (-1)."""
    there = np.r_[False, ids >= 0, False]
    run = there[1:-1] & (there[:-2] | there[2:])
    return np.where(run, ids, -1)[run | np.r_[False, run[:-1]]]


def pair_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbours are no breaks, and the keys of these pairs."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) else np.empty(0, np.int64)
    return at, ids[at] << 32 | ids[at + 1] if len(at) else np.empty(0, np.int64)


def sequence_row(ids: np.ndarray) -> pa.RecordBatch:
    """A row of SEQUENCE; numbers as unsigned 32 bits, the largest is the break."""
    ids = squeezed(ids)
    return pa.record_batch({"ids": pa.array([ids.astype(np.uint32).tobytes()], pa.binary()), "pairs": pa.array([len(pair_keys(ids)[0])], pa.int64())})


def sequences(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column.to_pylist():
        ids = np.frombuffer(x, np.uint32).astype(np.int64)
        ids[ids == 0xFFFFFFFF] = -1
        yield ids


def _encoded(batches: Iterator[pa.RecordBatch], told) -> Iterator[pa.RecordBatch]:
    """(lang, words, codes, numbers of words that are known already) -> sequences."""
    for b in rows_of(batches):
        for lang, words, codes, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
            numbers = numbers_of(lang, words, told.value)
            if before is not None:
                numbers = np.maximum(numbers, np.frombuffer(before, np.int64))
            yield sequence_row(np.r_[-1, numbers][np.frombuffer(codes, np.int32)])


def encoded(coded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The settled sequences of frequent words (lang, word, id)."""
    spark = coded.sparkSession
    shards = max(1, -(-vocabulary.count() // VOCABULARY))
    rows = coded.select("lang", "words", "codes", F.lit(None).cast("binary").alias("numbers"))
    for shard in range(shards):
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in vocabulary.where(F.pmod(F.xxhash64("lang", "word"), F.lit(shards)) == shard).select("lang", "word", "id").toLocalIterator():
            known[r["lang"]][r["word"].encode()] = r["id"]
        told = spark.sparkContext.broadcast(dict(known))
        if shard < shards - 1:  # no worker holds the words of several shards at once
            rows = settle(rows.mapInArrow(partial(_looked_up, told=told), "lang string, words binary, codes binary, numbers binary"), "looked-up", large=True)
    return settle(rows.mapInArrow(partial(_encoded, told=told), SEQUENCE), "sequences", large=True)


class Filter:
    """Which keys may be frequent: those whose buckets reach the threshold, by one hash after the other."""

    def __init__(self, bits: int, *held: np.ndarray):
        self.bits, self.held = bits, held

    def bucket(self, keys: np.ndarray, nth: int) -> np.ndarray:
        return (mixed(keys, 63 - nth) >> np.uint64(64 - self.bits)).astype(np.int64)

    def passed(self, keys: np.ndarray) -> np.ndarray:
        """The keys that pass, in their order."""
        return keys[self.where(keys)]

    def where(self, keys: np.ndarray) -> np.ndarray:
        """The places of the keys that pass."""
        places = np.arange(len(keys))
        for nth, held in enumerate(self.held):
            at = self.bucket(keys[places], nth)
            places = places[(held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
        return places


def counted(numbers: Iterator[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    """Arrays of numbers below size -> rows (chunk, lane, at, n): how often each occurs, by chunks of CHUNK numbers."""
    lane = TaskContext.get().partitionId() % LANES

    def rows(number: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(number >> 16)) + 1
        for at, count in zip(np.split(number, cut), np.split(n, cut), strict=True):
            if len(at):
                yield pa.record_batch({"chunk": pa.array([int(at[0]) >> 16]), "lane": pa.array([lane]), "at": pa.array([(at & 0xFFFF).astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([count.astype(np.int64 if count.max() >= 1 << 31 else np.int32).tobytes()], pa.binary())})

    if size > DENSE:
        for x in numbers:
            yield from rows(*np.unique(x, return_counts=True))
        return
    total = np.zeros(size, np.int64)
    for x in numbers:
        if 4 * len(x) > size:
            total += np.bincount(x, minlength=size)
        elif len(x):  # few numbers for many counters: no second array of all of them
            some, place = np.unique(x, return_inverse=True)
            total[some] += np.bincount(place)
    at = np.flatnonzero(total)
    for low in range(0, size, CHUNK):  # chunk by chunk, so that not all is copied at once
        a, b = np.searchsorted(at, (low, low + CHUNK))
        yield from rows(at[a:b], total[at[a:b]])
    del total
    trim()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, lane) -> one for each of these."""
    key, total = None, np.zeros(CHUNK, np.int64)

    def row() -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.record_batch({"chunk": pa.array([key[0]]), "lane": pa.array([key[1]]), "at": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([total[at].tobytes()], pa.binary())})

    for b in rows_of(batches):
        for chunk, lane, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key is not None and (chunk, lane) != key:
                yield row()
                total[:] = 0
            key = (chunk, lane)
            at = np.frombuffer(at, np.uint16)
            total[at] += np.frombuffer(n, np.int64 if len(n) == 8 * len(at) else np.int32)
    if key is not None:
        yield row()


ARRAYS = "chunk long, lane long, at binary, n binary"


def tree_sum(arrays: DataFrame) -> DataFrame:
    """Arrays of counts by chunk and lane -> one row a chunk: first the lanes' arrays are summed, then these."""
    by_lane = arrays.repartition("chunk", "lane").sortWithinPartitions("chunk", "lane").mapInArrow(_summed, ARRAYS)
    return by_lane.withColumn("lane", F.lit(0).cast("long")).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, ARRAYS)


def _bucket_counts(batches: Iterator[pa.RecordBatch], sieve) -> Iterator[pa.RecordBatch]:
    """Sequences -> counts of those keys that pass, by the buckets of the next hash."""
    sieve = sieve.value
    passed = (sieve.passed(pair_keys(ids)[1]) for b in rows_of(batches) for ids in sequences(b.column(0)))
    yield from counted((sieve.bucket(keys, len(sieve.held)) for keys in passed), 1 << sieve.bits)


def _reaching(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Chunks of counts -> a bit for each that reaches the threshold."""
    for b in rows_of(batches):
        for chunk, at, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            held = np.zeros(CHUNK, np.uint8)
            held[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.int64) >= least
            yield pa.record_batch({"chunk": pa.array([chunk]), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})


def sieve_of(level: DataFrame, pairs: int, least: int) -> Filter:
    """The filter of a level's keys. Buckets are a power of two, four times as many as frequent keys there can be."""
    bits = min(BUCKETS.bit_length() - 1, max(16, (4 * pairs // least).bit_length()))
    sieve = Filter(bits)
    for _ in range(2 if 1 << bits >= TWICE else 1):
        counts = level.mapInArrow(partial(_bucket_counts, sieve=level.sparkSession.sparkContext.broadcast(sieve)), ARRAYS)
        told = tree_sum(counts).mapInArrow(partial(_reaching, least=least), "chunk long, bits binary")
        held = np.zeros((1 << bits) // 8, np.uint8)
        for r in told.toLocalIterator():
            held[r["chunk"] * CHUNK // 8 :][: CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
        sieve = Filter(bits, *sieve.held, held)
    return sieve


def _candidates(batches: Iterator[pa.RecordBatch], sieve, known) -> Iterator[pa.RecordBatch]:
    """Sequences -> the keys that pass the filter and are not known, each once a task as long as TOGETHER of them are
    held."""
    held, waiting = np.empty(0, np.int64), []
    for b in rows_of(batches):
        for ids in sequences(b.column(0)):
            keys = np.unique(sieve.value.passed(pair_keys(ids)[1]))
            waiting.append(keys[~among(keys, known.value)])
            if sum(map(len, waiting)) >= TOGETHER:
                held, waiting = np.unique(np.concatenate([held, *waiting])), []
                if len(held) >= TOGETHER:
                    yield pa.record_batch({"key": held})
                    held = held[:0]
    held = np.unique(np.concatenate([held, *waiting]))
    if len(held):
        yield pa.record_batch({"key": held})


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the keys are known; these are sorted."""
    return known[np.searchsorted(known[:-1], keys)] == keys if len(known) else np.zeros(len(keys), bool)


def candidates(level: DataFrame, sieve) -> DataFrame:
    """Settled sequences -> their distinct keys that pass the filter, settled."""
    names = sorted(f.rsplit("/", 1)[-1] for f in level.inputFiles())
    random.Random(0).shuffle(names)  # a portion is like the whole, in whatever order the texts came
    known, before, at = np.empty(0, np.int64), [], 0
    while True:
        size = max(3 * at, FIRST)
        portion = level.where(F.col("_metadata.file_name").isin(names[at : at + size])).select("ids")
        told = level.sparkSession.sparkContext.broadcast(known)
        given = portion.mapInArrow(partial(_candidates, sieve=sieve, known=told), "key long")
        at += size
        if at >= len(names):
            break
        before.append(settle(given, "given"))
        if before[-1].count() + len(known) <= KNOWN:
            known = np.union1d(known, np.asarray(before[-1].toArrow().column("key")))
    keys = settle(reduce(DataFrame.unionByName, [*before, given]).distinct(), "keys")
    release(*before)
    return keys


def _hash_of(found: pa.Table) -> pa.Table:
    """The perfect hash over a shard's keys."""
    made = PerfectHash.of(np.asarray(found.column("key")).copy()).dump()
    return pa.table({"shard": found.column("shard").slice(0, 1)} | {k: pa.array([v], pa.binary()) for k, v in made.items()})


def _slot_counts(batches: Iterator[pa.RecordBatch], told, sieve) -> Iterator[pa.RecordBatch]:
    held = PerfectHash.load(told.value)

    def slots() -> Iterator[np.ndarray]:
        for b in rows_of(batches):
            for ids in sequences(b.column(0)):
                found = held.slots(sieve.value.passed(pair_keys(ids)[1]))
                yield found[found >= 0]

    yield from counted(slots(), len(held.keys))


def _frequent(batches: Iterator[pa.RecordBatch], told, base: int, least: int) -> Iterator[pa.RecordBatch]:
    """Chunks of counts by slot -> (id, head, tail, a) of those that reach the threshold."""
    keys = np.frombuffer(told.value["keys"], np.int64)
    for b in rows_of(batches):
        for chunk, at, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            n = np.frombuffer(n, np.int64)
            slot = (np.frombuffer(at, np.uint16).astype(np.int64) + chunk * CHUNK)[n >= least]
            yield pa.record_batch({"id": slot + base, "head": keys[slot] >> 32, "tail": keys[slot] & 0xFFFFFFFF, "a": n[n >= least]})


def _renumbered(batches: Iterator[pa.RecordBatch], told, sieve, frequent, base: int) -> Iterator[pa.RecordBatch]:
    """(ids, next) -> the same with the numbers of this shard's frequent phrases in next."""
    held = PerfectHash.load(told.value)
    counts = np.zeros(len(held.keys), bool)
    counts[frequent.value] = True
    for b in rows_of(batches):
        for ids, own, after in zip(sequences(b.column(0)), b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            out = np.full(max(len(ids) - 1, 0), -1, np.int64) if after is None else np.frombuffer(after, np.int64).copy()
            at, keys = pair_keys(ids)
            some = sieve.value.where(keys)
            at, slot = at[some], held.slots(keys[some])
            some = (slot >= 0) & counts[slot]
            out[at[some]] = slot[some] + base
            yield pa.record_batch({"ids": pa.array([own], pa.binary()), "next": pa.array([out.tobytes()], pa.binary())})


def _next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches):
        for x in b.column(0).to_pylist():
            yield sequence_row(np.frombuffer(x, np.int64))


def next_level(level: DataFrame, least: int, last: bool) -> tuple[DataFrame, DataFrame] | None:
    """Settled sequences of frequent phrases -> the frequent ones of one word more (id, head, tail, a), settled, and the
    sequences of these; None if there are none."""
    spark = level.sparkSession
    pairs = level.agg(F.sum("pairs")).first()[0] or 0
    if pairs < least:
        return None
    rows = level.select("ids")
    sieve = spark.sparkContext.broadcast(sieve_of(rows, pairs, least))
    keys = candidates(level, sieve)
    shards = max(1, -(-keys.count() // SLOTS))
    dealt = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    hashes = settle(dealt.groupBy("shard").applyInArrow(_hash_of, "shard long, keys binary, bits binary, sizes binary"), "hashes", large=True)
    release(keys)

    found, base, now = [], 0, rows.withColumn("next", F.lit(None).cast("binary"))
    for shard in range(shards):
        row = hashes.where(F.col("shard") == shard).first()
        if row is None:
            continue
        told = spark.sparkContext.broadcast({k: bytes(row[k]) for k in ("keys", "bits", "sizes")})
        sums = tree_sum(rows.mapInArrow(partial(_slot_counts, told=told, sieve=sieve), ARRAYS))
        found.append(settle(sums.mapInArrow(partial(_frequent, told=told, base=base, least=least), "id long, head long, tail long, a long"), "frequent"))
        if not last:
            slots = spark.sparkContext.broadcast(np.array([r["id"] for r in found[-1].select("id").collect()], np.int64) - base)
            now = now.mapInArrow(partial(_renumbered, told=told, sieve=sieve, frequent=slots, base=base), "ids binary, next binary")
            if shards > 1:  # no worker holds the hashes of several shards at once
                now = settle(now, "renumbered", large=True)
        base += len(row["keys"]) // 8
    release(hashes)
    frequent = reduce(DataFrame.unionByName, found) if found else None
    if frequent is None or frequent.isEmpty():
        return None
    return frequent, None if last else settle(now.select("next").mapInArrow(_next_level, SEQUENCE), "sequences", large=True)


def worded(frequent: DataFrame, below: DataFrame) -> DataFrame:
    """Frequent phrases with what the tables of their heads and tails say: the words, and the counts of all first and
    last parts, by the number of their words."""
    head = below.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("before"), F.col("firsts").alias("f"))
    tail = below.select(F.col("id").alias("tail"), "word", F.col("lasts").alias("r"))
    joined = frequent.join(head, "head").join(tail, "tail")
    return joined.select("id", "lang", F.concat_ws(" ", "before", "word").alias("phrase"), "word", "a", F.concat("f", F.array("a")).alias("firsts"), F.concat("r", F.array("a")).alias("lasts"))


def best_cut(n: str) -> str:
    """The lowest score of a phrase's cuts, the first of equals, with its parts' counts."""
    wide = "cast({} as decimal(20, 0))"
    l, r = "element_at(firsts, k)", "element_at(lasts, size(firsts) - k)"
    score = f"({wide.format(1000)} * {wide.format('a')} * {wide.format(n)}) div ({wide.format(l)} * {wide.format(r)})"
    return f"array_min(transform(sequence(1, size(firsts) - 1), k -> struct({score} as score, k as k, {l} as l, {r} as r)))"


def best(scored: DataFrame, top: int) -> DataFrame:
    """Each language's best phrases. Of a language's phrases first the best of each of some groups are taken, so no
    task holds more than a group's, or the groups' best."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    groups = max(1, int((scored.count() / top) ** 0.5))
    group = F.pmod(F.xxhash64("phrase"), F.lit(groups))
    place = F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))
    some = scored.withColumn("_group", group).withColumn("_place", place).where(F.col("_place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).drop("_group", "_place")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a (its count), l and r (those of its weakest cut's parts), n
    (all words of the language), score (the floor of 1000 a n / (l r))."""
    prepare(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    coded = settle(plain.mapInArrow(_coded, CODED), "coded", large=True)
    words = coded.select("lang", "words", "counts").mapInArrow(_word_counts, "lang string, word string, n long")
    counts = settle(words.groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = settle(counts.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    vocabulary = settle(numbered(counts.where(F.col("a") >= min_count).withColumn("all", F.lit(0)), ["all"], ["lang", "word"], "id").drop("all"), "vocabulary")
    level = encoded(coded, vocabulary)
    release(coded, counts)

    below = vocabulary.select("id", "lang", F.col("word").alias("phrase"), "word", "a", F.array("a").alias("firsts"), F.array("a").alias("lasts"))
    tables, longer = [], []
    for k in range(2, longest + 1):
        made = next_level(level, min_count, last=k == longest)
        release(level)
        if made is None:
            break
        frequent, level = made
        longer.append(frequent.select(F.explode(F.array("head", "tail")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer")))
        below = settle(worded(frequent, below), "phrases")
        tables.append(below)
    if not tables:
        kind = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return docs.sparkSession.createDataFrame([], kind)
    none = docs.sparkSession.createDataFrame([], "id long, longer long")
    kept = [t.join(x, "id", "left").where("longer is null or longer < a") for t, x in zip(tables, [*longer[1:], none], strict=True)]
    cut = reduce(DataFrame.unionByName, kept).join(totals, "lang").withColumn("cut", F.expr(best_cut("n")))
    scored = settle(cut.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "scored")
    return best(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
