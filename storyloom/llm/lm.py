"""Language-model scoring with a gated recurrent network in numpy.

Counting. Words of the training documents are counted in full: partial counts a task, one shuffle by word. The HEAD
most frequent words, a fixed number, go to all workers with their counts; the counts of all others stay in a table
that the words to be scored are joined with. Every document is then coded once, two bytes a word, for all that follows.

Model. A gated recurrent unit reads the words of a text and predicts each next one, and the text's end, through a
class-factored softmax over all words: P(word | state) = P(class | state) P(member | class, state) P(word | member).
The SHORT most frequent words are in classes by frequency and are members themselves. All others are in one more
class, whose members are BUCKETS sets of words by their last two bytes; inside a set, a word has its smoothed
relative frequency, one share being kept for words never seen. So the probabilities of all words sum to one after
every prefix, whatever the size of the vocabulary, and what the network says of a rare word follows its context down
to the set. Classes and members start at their frequencies.

Training. Every training document is read. Documents are dealt by a hash of what they are into groups of about
GROUP_WORDS words, wherever they lie, and groups into ROUNDS rounds. In a round each group starts from the weights of
the round before: its documents, whole, are laid on parallel streams (the longest first, each on the shortest stream;
the state is reset at a document's start), and Adagrad steps are taken by backpropagation through windows of STEPS
words, the state carried from window to window. The groups' weights are averaged by their words, GROUP at a time,
over as many levels as it takes; a fixed number of weights reaches the driver. So the weights do not depend on how
rows lie in partitions.

Scoring. Whole texts: the state is carried through a document from its first word to its end, many documents side
by side in order of their lengths, and the hidden states of many steps meet the output layer at once.

Defined results: null text counts as empty and has the end alone; a row with a null id is held out; repeated rows
are scored each (and counted each in training); without training words the base is 0 and the model knows only the
sets of unseen words; other columns play no part.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial
from heapq import heapreplace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import prepare, raw, release, rows_of, settle

HEAD = 200_000
SHORT = 2048
CLASSES = 40
#: Sets that words outside the short list are in, by their last two bytes; each has an input row as well.
BUCKETS = 64
HIDDEN = 16
STREAMS = 512
STEPS = 16
RATE = 0.08
CLIP = 1.0
#: Words of a group of documents and of a stream of one, about; rounds of averaging; weights that are added up at once.
GROUP_WORDS = 1 << 21
STREAM_WORDS = 1024
ROUNDS = 4
GROUP = 8
#: Words that a task holds at once, in training and in scoring, and words of the partial counts.
HELD = 3_000_000
COUNTED = 300_000
#: The end of a text, as a word: no word has white space in it.
END = b"\n"


def words_of(text: bytes) -> list[bytes]:
    """The text's words, A-Z in lower case (bytes.lower touches ASCII only), and its end."""
    return [*text.lower().split(), END]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (word, n), summed over many rows."""
    held: Counter = Counter()

    def batch() -> pa.RecordBatch:
        out = pa.record_batch({"word": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()
        return out

    for b in rows_of(batches):
        for t in raw(b.column(0)):
            held.update(words_of(t))
            if len(held) > COUNTED:
                yield batch()
    if held:
        yield batch()


def counted(texts: DataFrame) -> DataFrame:
    """(text) -> settled (word binary, c): how often each word, and the end, occurs."""
    prepare(texts.sparkSession)
    return settle(texts.select(F.col("text").cast("string")).mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")


def set_of(word: bytes, sets: int) -> int:
    """The set of a word outside the short list."""
    return zlib.crc32(word[-2:]) % sets


@dataclass
class Vocabulary:
    """The head's words by falling frequency, their counts, the totals over all training words, and for each set of
    words outside the short list how many training words it has, and how many distinct."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    key: str
    short: int
    set_words: np.ndarray
    set_distinct: np.ndarray

    @property
    def rows(self) -> int:
        """Words of the short list and sets: a word's row is its place in that list, or behind it that of its set."""
        return self.short + len(self.set_words)

    def ends(self) -> np.ndarray:
        """The ends of the classes in the rows: classes of about equal sums of the roots of the counts, then the sets."""
        n = self.short
        if not n:
            return np.array([self.rows])
        mass = np.cumsum(np.sqrt(self.counts[:n]))
        of = np.minimum((mass / mass[-1] * CLASSES).astype(np.int64), CLASSES - 1)
        return np.r_[np.flatnonzero(np.diff(of)) + 1, n, self.rows]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head is all words from a count on, the lowest that leaves at most HEAD; it is found by a histogram of the
    counts' logarithms, so that neither a sort nor more than HEAD words reach the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2(F.col("c")) * 16).cast("int")
    least, held = 2**31 - 1, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > HEAD:
            break
        least = r["level"]
    top = counts.where(level >= least).select("word", "c").toArrow()
    pairs = sorted(zip(top["c"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    words, short = [w for _, w in pairs], min(SHORT, len(pairs))
    sets = np.zeros((2, BUCKETS), np.int64)
    of = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(BUCKETS)).cast("int")
    for r in counts.groupBy(of.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # BUCKETS rows at most
        sets[:, r["k"]] = r["n"], r["v"]
    for c, w in pairs[:short]:
        sets[:, set_of(w, BUCKETS)] -= c, 1
    return Vocabulary(words, np.array([c for c, _ in pairs], np.int64), total, distinct, f"{zlib.crc32(b' '.join(words)):08x}{total}", short, *sets)


_indexes: dict[str, tuple[dict[bytes, int], np.ndarray]] = {}


def index_of(v: Vocabulary) -> tuple[dict[bytes, int], np.ndarray]:
    """word -> place in the head; and by place the word's row. One vocabulary is kept a worker."""
    if v.key not in _indexes:
        _indexes.clear()
        rows = np.array([i if i < v.short else v.short + set_of(w, len(v.set_words)) for i, w in enumerate(v.words)], np.uint16)
        _indexes[v.key] = {w: i for i, w in enumerate(v.words)}, rows
    return _indexes[v.key]


_ending = cache(set_of)  # of the last two bytes, so there are few


def coded_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place in the head or -1, row) of each word."""
    places, rows = index_of(v)
    at = np.fromiter(map(places.get, words, repeat(-1)), np.int32, len(words))
    found = rows[at] if len(rows) else np.zeros(len(words), np.uint16)
    far = np.flatnonzero(at < 0)
    found[far] = [v.short + _ending(words[i][-2:], len(v.set_words)) for i in far.tolist()]
    return at, found


CODED = "id long, n_tokens long, n_known long, base double, fixed double, rows binary, tail array<struct<word:binary,n:int>>"


def _code(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(id, text) -> the rows of its words, what the head's counts say, and the words whose counts must be looked up.
    fixed: log10 P(word | its set), summed, but for the counts of the words to be looked up."""
    v = pickle.loads(shared.value)
    logs = np.log10(v.counts + 1.0) if len(v.counts) else np.zeros(1)
    sizes = np.log10(v.set_words + v.set_distinct + 1.0)
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
    names = ("id", "n_tokens", "n_known", "base", "fixed", "rows", "tail")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), kind]
    for b in rows_of(batches):
        out = []
        for own, t in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
            words = words_of(t)
            places, rows = coded_words(v, words)
            known = places[places >= 0]
            sets = rows[rows >= v.short].astype(np.int64) - v.short
            tail = [{"word": w, "n": n} for w, n in Counter([words[i] for i in np.flatnonzero(places < 0)]).items()]
            out.append((own, len(words), len(known), float(logs[known].sum()), float(logs[known[known >= v.short]].sum() - sizes[sets].sum()), rows.tobytes(), tail))
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def coded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(id, text) -> settled (row, id, n_tokens, n_known, base, fixed, rows, tail)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(v, protocol=5))
    plain = docs.select(F.col("id").cast("long"), F.col("text").cast("string"))
    return settle(plain.mapInArrow(partial(_code, shared=shared), CODED).withColumn("row", F.monotonically_increasing_id()), "coded")


class Network:
    """Weights by name; float32. Class k holds the rows ends[k - 1] to ends[k]; the last one's are the sets."""

    def __init__(self, v: Vocabulary, seed: int = 11):
        rng, n, h = np.random.Generator(np.random.PCG64(seed)), v.rows, HIDDEN
        self.ends = v.ends()
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)
        self.class_of = np.searchsorted(self.ends, np.arange(n), side="right").astype(np.int16)
        counts = np.r_[v.counts[: v.short], v.set_words].astype(np.float64)
        mass = np.array([counts[a:b].sum() for a, b in zip(self.starts, self.ends, strict=True)]) + 1.0
        random = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.w = {
            "in": random(n + 1, h),  # the last row is a text's start
            "x": random(h, 3 * h),
            "h": random(h, 3 * h),
            "b": np.zeros(3 * h, np.float32),
            "class": np.zeros((h, len(self.ends)), np.float32),
            "class_b": np.log(mass / mass.sum()).astype(np.float32),
            "out": np.zeros((n, h), np.float32),
            "out_b": np.log((counts + 1.0) / mass[self.class_of]).astype(np.float32),
        }

    @property
    def start(self) -> int:
        return len(self.w["in"]) - 1

    @property
    def hidden(self) -> int:
        return len(self.w["h"])

    def by_row(self, states: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """An order that puts equal rows together, and so those of a class; states (a column of ones for the biases
        behind them) and rows in that order; and where each class begins in it."""
        order = np.argsort(rows, kind="stable")
        own = np.ones((len(rows), self.hidden + 1), states.dtype)
        own[:, :-1] = states[order]
        member = rows[order]
        return order, own, member, np.r_[np.searchsorted(member, self.starts), len(member)]

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights with their biases: of the classes, of the rows, and what a row and its class have together; a row
        that is alone in its class has nothing of its own."""
        w = self.w
        classes, members = np.r_["0,2", w["class"], w["class_b"]], np.c_[w["out"], w["out_b"]]
        both = np.where((self.ends - self.starts > 1)[self.class_of][:, None], members, 0)
        both += classes.T[self.class_of]
        return classes, members, both

    def far(self) -> bool:
        """Whether a logit could be too large for exp: states lie between -1 and 1."""
        w = self.w
        return max(np.abs(w["class"]).sum(axis=0).max() + np.abs(w["class_b"]).max(), np.abs(w["out"]).sum(axis=1).max() + np.abs(w["out_b"]).max()) > 60

    def log_probability(self, states: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log P(class | state) + log P(member | class, state) of each row."""
        far = self.far()
        classes, members, both = self.joined()
        order, own, member, cut = self.by_row(states, rows)
        found = np.einsum("ij,ij->i", own, both[member]).astype(np.float64)
        found -= np.log(total(exps(own @ classes, far)))
        for k, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            part = slice(cut[k], cut[k + 1])
            if cut[k + 1] > cut[k] and b - a > 1:
                found[part] -= np.log(total(exps(own[part] @ members[a:b].T, far)))
        out = np.empty(len(rows))
        out[order] = found
        return out


def exps(logits: np.ndarray, far: bool) -> np.ndarray:
    """exp, in place; far logits are cut before they overflow."""
    if far:
        np.clip(logits, -60, 60, out=logits)
    return np.exp(logits, out=logits)


def total(p: np.ndarray) -> np.ndarray:
    """Sums of the rows."""
    return p @ np.ones(p.shape[1], p.dtype)


def columns(p: np.ndarray) -> np.ndarray:
    """Sums of the columns."""
    return np.ones(len(p), p.dtype) @ p


def cell(x: np.ndarray, state: np.ndarray, w: np.ndarray, gates: np.ndarray, new: np.ndarray, of_c: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The unit's next state, from the input's part and the state before; the other arrays take what it computes."""
    h = state.shape[1]
    of_h = state @ w
    np.add(x[:, : 2 * h], of_h[:, : 2 * h], out=gates)
    gates *= 0.5  # the logistic function, by the hyperbolic tangent
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    of_c[:] = of_h[:, 2 * h :]
    np.multiply(gates[:, h:], of_c, out=new)
    new += x[:, 2 * h :]
    np.tanh(new, out=new)
    np.subtract(state, new, out=out)
    out *= gates[:, :h]
    out += new
    return out


class Trainer:
    """Adagrad by backpropagation through windows of parallel streams."""

    def __init__(self, network: Network):
        self.net, self.seen = network, 0
        self.squares = {k: np.full_like(x, 1e-4) for k, x in network.w.items()}
        self.state = np.zeros((STREAMS, network.hidden), np.float32)

    def step(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        size = float(np.sqrt((gradient * gradient).sum()))
        if size > CLIP:
            gradient = gradient * (CLIP / size)
        self.squares[name][rows] += gradient * gradient
        self.net.w[name][rows] -= RATE * gradient / np.sqrt(self.squares[name][rows])

    def window(self, inputs: np.ndarray, rows: np.ndarray, resets: np.ndarray, live: np.ndarray) -> None:
        """One step on (steps, streams) words: rows read, rows to predict, resets of the state, and which words there are."""
        w, h = self.net.w, self.net.hidden
        steps, n = inputs.shape
        x = w["in"][inputs] @ w["x"] + w["b"]
        kind_of = x.dtype
        before, gates, news, of_c, states = (np.empty((steps, n, k), kind_of) for k in (h, 2 * h, h, h, h))
        state = self.state[:n]
        for t in range(steps):
            np.multiply(state, resets[t][:, None], out=before[t])
            state = cell(x[t], before[t], w["h"], gates[t], news[t], of_c[t], states[t])
        self.state[:n] = state
        there = live.reshape(-1)
        whole = bool(there.all())
        flat, rows = states.reshape(-1, h), rows.reshape(-1)
        if not whole:
            flat, rows = flat[there], rows[there]
        scale, far = np.float32(1.0 / STREAMS), self.net.far()
        classes, members, both = self.net.joined()
        order, own, member, cut = self.net.by_row(flat, rows)
        p = exps(own @ classes, far)
        size = (scale / total(p))[:, None]
        back = p @ w["class"].T
        back *= size
        g_class, g_out = (own * size).T @ p, np.zeros_like(members)
        for k, (a, b) in enumerate(zip(self.net.starts, self.net.ends, strict=True)):
            part = slice(cut[k], cut[k + 1])
            if cut[k + 1] > cut[k] and b - a > 1:
                mine = own[part]
                q = exps(mine @ members[a:b].T, far)
                size = (scale / total(q))[:, None]
                back[part] += (q @ w["out"][a:b]) * size
                g_out[a:b] = q.T @ (mine * size)
        # What was to be predicted: the words of a row, and of a class, lie together.
        back -= (scale * both[:, :h])[member]
        first = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
        there_sums, there_rows = np.add.reduceat(own, first, axis=0) * scale, member[first]
        alone = (self.net.ends - self.net.starts == 1)[self.net.class_of[there_rows]]
        g_out[there_rows[~alone]] -= there_sums[~alone]
        kind = self.net.class_of[there_rows]
        begin = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
        g_class[:, kind[begin]] -= np.add.reduceat(there_sums, begin, axis=0).T
        up_all = np.zeros((steps * n, h), back.dtype)
        up_all[order if whole else np.flatnonzero(there)[order]] = back
        up_all = up_all.reshape(steps, n, h)
        g_of_h, g_news = np.empty_like(x), np.empty_like(states)
        carry = np.zeros((n, h), kind_of)
        slope = gates * (1 - gates)
        of_z, of_r, of_new = (before - news) * slope[:, :, :h], of_c * slope[:, :, h:], 1 - news * news
        for t in range(steps - 1, -1, -1):
            up = up_all[t] + carry
            through = up * gates[t, :, :h]
            g = g_of_h[t]
            np.multiply(up, of_z[t], out=g[:, :h])
            g_new = np.multiply(up - through, of_new[t], out=g_news[t])
            np.multiply(g_new, of_r[t], out=g[:, h : 2 * h])
            np.multiply(g_new, gates[t, :, h:], out=g[:, 2 * h :])
            through += g @ w["h"].T
            carry = np.multiply(through, resets[t][:, None], out=through)
        g_h = before.reshape(-1, h).T @ g_of_h.reshape(-1, 3 * h)
        g_of_h[:, :, 2 * h :] = g_news  # what reaches the input's part differs there alone
        read, flat_x = inputs.reshape(-1), g_of_h.reshape(-1, 3 * h)
        seen = w["in"][read]
        g_in = flat_x @ w["x"].T
        order = np.argsort(read, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(read[order].astype(np.int32)) > 0])
        self.step("in", np.add.reduceat(g_in[order], first, axis=0), read[order][first])
        for name, gradient in (("x", seen.T @ flat_x), ("h", g_h), ("b", columns(flat_x)), ("class", g_class[:-1]), ("class_b", g_class[-1]), ("out", g_out[:, :-1]), ("out_b", g_out[:, -1])):
            self.step(name, gradient)

    def read(self, docs: list[np.ndarray]) -> None:
        """Train on whole documents, the rows of their words, laid on streams: the longest first, each on the shortest."""
        lengths = np.array([len(d) for d in docs])
        self.seen += int(lengths.sum())
        streams = min(STREAMS, len(docs), max(1, int(lengths.sum()) // STREAM_WORDS))
        held: list[list[int]] = [[] for _ in range(streams)]
        heap = [(0, k) for k in range(streams)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            size, k = heap[0]
            held[k].append(d)
            heapreplace(heap, (size + int(lengths[d]), k))
        size = np.array([lengths[k].sum() for k in held])
        by_size = np.argsort(-size, kind="stable")
        size = size[by_size]
        # Within a stream the documents come in the order they were given in.
        order = [d for k in by_size for d in sorted(held[k])]
        rows = np.concatenate([docs[d] for d in order])
        firsts = np.r_[0, np.cumsum(lengths[order])[:-1]]
        inputs = np.r_[np.uint16(0), rows[:-1]]
        inputs[firsts] = self.net.start
        resets = np.ones(len(rows), np.float32)
        resets[firsts] = 0
        begin, t = np.r_[0, np.cumsum(size)[:-1]], 0
        self.state[:] = 0
        while t < size[0]:
            alive = int(np.searchsorted(-size, -t, side="left"))  # streams longer than t
            steps = STEPS if 4 * alive >= streams else 4 * STEPS  # few streams take longer windows
            steps = min(steps, int(size[0]) - t)
            at = t + np.arange(steps)[:, None]
            live = at < size[:alive]
            at = np.where(live, begin[:alive] + at, begin[:alive])
            self.window(inputs[at], rows[at], resets[at] * live, live)
            t += steps


def _train(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(group, rows), sorted by group -> one row a group: its number, words and weights."""
    trainer, group, docs, size = None, None, [], 0

    def read() -> None:
        nonlocal size
        if docs:
            trainer.read(docs)
            docs.clear()
            size = 0

    def done() -> pa.RecordBatch:
        read()
        blob = pickle.dumps({k: x.astype(np.float64) * trainer.seen for k, x in trainer.net.w.items()}, protocol=5)
        return pa.record_batch({"k": pa.array([group], pa.int64()), "words": pa.array([trainer.seen], pa.int64()), "weights": pa.array([blob], pa.binary())})

    for b in rows_of(batches):
        for own, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if own != group:
                if trainer is not None:
                    yield done()
                trainer, group = Trainer(pickle.loads(shared.value)), own
            docs.append(np.frombuffer(rows, np.uint16))
            size += len(docs[-1])
            if size > HELD:
                read()
    if trainer is not None:
        yield done()


TRAINED = "k long, words long, weights binary"


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("k")
    total = pickle.loads(rows["weights"].iloc[0])
    for blob in rows["weights"].iloc[1:]:
        for k, x in pickle.loads(blob).items():
            total[k] += x
    return pd.DataFrame({"k": [int(rows["k"].iloc[0]) // GROUP], "words": [int(rows["words"].sum())], "weights": [pickle.dumps(total, protocol=5)]})


def averaged(made: DataFrame) -> tuple[dict[str, np.ndarray] | None, int]:
    """Settled rows of groups -> the weights, averaged by words, and the words."""
    while made.count() > 1:
        after = settle(made.groupBy(F.floor(F.col("k") / GROUP)).applyInPandas(_add_up, TRAINED), "weights")
        release(made)
        made = after
    found = made.collect()  # one row of a fixed size at most
    release(made)
    if not found:
        return None, 0
    words = found[0]["words"]
    return {k: (x / words).astype(np.float32) for k, x in pickle.loads(found[0]["weights"]).items()}, words


def train(docs: DataFrame, v: Vocabulary) -> Network:
    """One pass over coded training documents (id, rows), a share of them in each round."""
    spark, network = docs.sparkSession, Network(v)
    if not v.total:
        return network
    groups = -(-v.total // GROUP_WORDS)
    rounds = min(ROUNDS, groups)
    # Group g of round r is number g * rounds + r of all: each round has some of the groups, whatever their number.
    own = F.xxhash64("id", "rows")
    dealt = docs.select("id", "rows", own.alias("h"), F.pmod(own, F.lit(groups)).alias("group"))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(pickle.dumps(network, protocol=5))
        mine = dealt.where(F.col("group") % rounds == r).withColumn("group", F.floor(F.col("group") / rounds))
        ordered = mine.repartition("group").sortWithinPartitions("group", "h", "id", "rows").select("group", "rows")
        weights, words = averaged(settle(ordered.mapInArrow(partial(_train, shared=shared), TRAINED), "weights"))
        if words:
            network.w = weights
    return network


class Scorer:
    """Whole documents side by side; each one's state is carried from its start to its end."""

    def __init__(self, network: Network):
        self.net = network
        self.table = network.w["in"] @ network.w["x"] + network.w["b"]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The rows of each document's words -> natural log of what the network answers for."""
        if not docs:
            return np.zeros(0)
        lengths = np.array([len(d) for d in docs])
        order = np.argsort(-lengths, kind="stable")
        h, w, falling = self.net.hidden, self.net.w["h"], lengths[order]
        # The words of all documents by their steps; of a step, those of the longest documents first.
        alive = np.searchsorted(-falling, -np.arange(falling[0]), side="left")  # documents longer than t
        begins = np.r_[0, np.cumsum(alive)]
        ends = np.cumsum(falling)
        place = np.arange(ends[-1], dtype=np.int32) - np.repeat((ends - falling).astype(np.int32), falling)
        place = begins.astype(np.int32)[place]
        place += np.repeat(np.arange(len(docs), dtype=np.int32), falling)
        rows = np.empty(len(place), np.uint16)
        rows[place] = np.concatenate([docs[d] for d in order.tolist()])
        got = np.empty(len(rows))
        states = np.empty((min(len(rows), (1 << 16) + len(docs)), h), np.float32)
        gates, news, of_c = (np.empty((len(docs), k), np.float32) for k in (2 * h, h, h))
        state, done = np.zeros((len(docs), h), np.float32), 0
        x = np.repeat(self.table[self.net.start][None], len(docs), axis=0)
        for t, n in enumerate(alive.tolist()):
            begin = int(begins[t])
            if t:
                before = int(begins[t - 1])
                x = self.table[rows[before : before + n]]
            state = cell(x, state[:n], w, gates[:n], news[:n], of_c[:n], states[begin - done : begin - done + n])
            if begin + n - done > 1 << 16 or begin + n == len(rows):
                got[done : begin + n] = self.net.log_probability(states[: begin + n - done], rows[done : begin + n])
                done = begin + n
        out = np.empty(len(docs))
        out[order] = np.add.reduceat(got[place], ends - falling)
        return out


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(id, n_tokens, n_known, base, fixed, row, rows) -> the same, and what the network says in place of rows."""
    scorer = Scorer(pickle.loads(shared.value))
    held, docs, size = [], [], 0

    def scored() -> Iterator[pa.RecordBatch]:
        model, at = scorer.score(docs) / np.log(10), 0
        for b in held:
            yield pa.record_batch([*b.columns[:-1], pa.array(model[at : at + b.num_rows])], names=[*b.schema.names[:-1], "model"])
            at += b.num_rows

    for b in rows_of(batches):
        mine = [np.frombuffer(x, np.uint16) for x in b.column(b.num_columns - 1).to_pylist()]
        held.append(b)
        docs += mine
        size += sum(map(len, mine))
        if size > HELD:
            yield from scored()
            held, docs, size = [], [], 0
    if held:
        yield from scored()


def score_coded(found: DataFrame, counts: DataFrame, v: Vocabulary, network: Network) -> DataFrame:
    """Coded documents -> id, n_tokens, n_known, base_score, score of every row; log10."""
    shared = found.sparkSession.sparkContext.broadcast(pickle.dumps(network, protocol=5))
    columns = ["id", "n_tokens", "n_known", "base", "fixed", "row"]
    kind = "id long, n_tokens long, n_known long, base double, fixed double, row long, model double"
    scored = found.select(*columns, "rows").mapInArrow(partial(_score, shared=shared), kind)
    # Words outside the head: their counts, by a join on the word, summed again by row.
    words = found.select("row", F.inline("tail"))
    looked_up = words.join(counts, "word").groupBy("row").agg(F.sum("n").cast("long").alias("t_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("t_sum"))
    whole = scored.join(looked_up, "row", "left").fillna(0, ["t_known"]).fillna(0.0, ["t_sum"])
    base = F.col("base") + F.col("t_sum") - F.col("n_tokens") * float(np.log10(v.total + v.distinct + 1.0))
    model = F.col("model") + F.col("fixed") + F.col("t_sum")
    return whole.select("id", "n_tokens", (F.col("n_known") + F.col("t_known")).alias("n_known"), base.alias("base_score"), model.alias("score"))


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, network: Network) -> DataFrame:
    """(id, text) -> id, n_tokens, n_known, base_score, score of every row; log10."""
    return score_coded(coded(docs, v), counts, v, network)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id's text falls into the fold; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def fit(docs: DataFrame) -> tuple[DataFrame, Vocabulary, Network]:
    """Training documents (id, text) -> counts, vocabulary, network."""
    counts = counted(docs.select("text"))
    v = vocabulary(counts)
    own = coded(docs, v)
    network = train(own, v)
    release(own)
    return counts, v, network


def fit_and_score(docs: DataFrame, training: Column) -> tuple[DataFrame, Vocabulary]:
    """(id, text), and a condition on id -> the scores of all rows by what the training rows teach, and the vocabulary.
    Every document is coded once, for both."""
    counts = counted(docs.where(training).select("text"))
    v = vocabulary(counts)
    own = coded(docs, v)
    return score_coded(own, counts, v, train(own.where(training), v)), v
