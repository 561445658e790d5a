import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storyloom.llm import lm
from storyloom.llm.queries import op8_recurrent_lm_scoring

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), "\n"]


def small(monkeypatch, **sizes):
    for k, n in {"SHORT": 8, "CLASSES": 4, "HEAD": 12, "HIDDEN": 5, "BUCKETS": 3, "STREAMS": 6, "STEPS": 4, **sizes}.items():
        monkeypatch.setattr(lm, k, n)


def made(texts):
    counts = Counter(w for t in texts for w in lm.words_of(t.encode()))
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    head, short = top[: lm.HEAD], min(lm.SHORT, len(top[: lm.HEAD]))
    sets = np.zeros((2, lm.BUCKETS), np.int64)
    for w, n in top[short:]:
        sets[:, lm.set_of(w, lm.BUCKETS)] += n, 1
    v = lm.Vocabulary([w for w, _ in head], np.array([n for _, n in head], np.int64), sum(counts.values()), len(counts), str(len(top)), short, *sets)
    return counts, v, lm.Network(v)


def rows_of_texts(v, texts):
    return [lm.coded_words(v, lm.words_of(t.encode()))[1] for t in texts]


TEXTS = ["the cat sat on the mat", "the dog sat on the log and the cat ran", "a bird and a cat and a dog", "", "rare words here once upon some time", "the the the cat"] * 3


def plain_score(net, v, counts, text):
    """One document, one word at a time, in 64 bits."""
    w = {k: x.astype(np.float64) for k, x in net.w.items()}
    state, row, total, h = np.zeros(lm.HIDDEN), net.start, 0.0, lm.HIDDEN
    for word in lm.words_of(text.encode()):
        x, of = w["in"][row] @ w["x"] + w["b"], state @ w["h"]
        z, r = 1 / (1 + np.exp(-x[:h] - of[:h])), 1 / (1 + np.exp(-x[h : 2 * h] - of[h : 2 * h]))
        c = np.tanh(x[2 * h :] + r * of[2 * h :])
        state = (1 - z) * c + z * state
        p = np.exp(state @ w["class"] + w["class_b"])
        p /= p.sum()
        place = v.words.index(word) if word in v.words[: v.short] else -1
        row = place if place >= 0 else v.short + lm.set_of(word, lm.BUCKETS)
        k = net.class_of[row]
        a, b = net.starts[k], net.ends[k]
        q = np.exp(w["out"][a:b] @ state + w["out_b"][a:b])
        total += np.log10(p[k] * q[row - a] / q.sum())
        if place < 0:
            at = lm.set_of(word, lm.BUCKETS)
            total += np.log10((counts.get(word, 0) + 1) / (v.set_words[at] + v.set_distinct[at] + 1))
    return total


def test_gradients(monkeypatch):
    small(monkeypatch)
    _, v, net = made(TEXTS)
    rng = np.random.default_rng(0)
    net.w = {k: x.astype(np.float64) + rng.normal(0, 0.3, x.shape) for k, x in net.w.items()}
    rows = np.concatenate(rows_of_texts(v, TEXTS))
    cut, shape = lm.STREAMS * lm.STEPS, (lm.STREAMS, lm.STEPS)
    live = np.ones(shape, bool)
    live[-1, 2:] = live[-2, 3:] = False
    targets = rows[:cut].reshape(shape)
    inputs = np.concatenate([np.full((lm.STREAMS, 1), net.start, np.uint16), targets[:, :-1]], axis=1)
    resets = (rng.random(shape) > 0.3).astype(float)
    window = [x.T for x in (inputs, targets, resets, live)]
    found = {}

    class Catcher(lm.Trainer):
        def step(self, name, gradient, rows=slice(None)):
            whole = np.zeros_like(self.net.w[name])
            whole[rows] = gradient
            found[name] = whole

    def loss():
        state, total = np.zeros((lm.STREAMS, lm.HIDDEN)), 0.0
        h, w = lm.HIDDEN, net.w
        sigmoid = lambda x: 1 / (1 + np.exp(-x))
        for i, p, r, there in zip(*window, strict=True):
            state = state * r[:, None]
            x, of = w["in"][i] @ w["x"] + w["b"], state @ w["h"]
            z, g = sigmoid(x[:, :h] + of[:, :h]), sigmoid(x[:, h : 2 * h] + of[:, h : 2 * h])
            c = np.tanh(x[:, 2 * h :] + g * of[:, 2 * h :])
            state = c + z * (state - c)
            total -= net.log_probability(state[there], p[there]).sum()
        return total / lm.STREAMS

    trainer = Catcher(net)
    trainer.state = np.zeros((lm.STREAMS, lm.HIDDEN))
    trainer.window(*window)
    for name, x in net.w.items():
        for _ in range(12):
            at = tuple(rng.integers(n) for n in x.shape)
            old, e = x[at], 1e-5
            x[at] = old + e
            up = loss()
            x[at] = old - e
            down = loss()
            x[at] = old
            assert found[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-6), name


def test_every_document_is_read_whole_from_a_fresh_state(monkeypatch):
    """Windows put together again, stream by stream, are the documents, each reset at its first word alone."""
    small(monkeypatch, STREAM_WORDS=20)
    _, v, net = made(TEXTS)
    docs = rows_of_texts(v, [*TEXTS, " ".join(["the cat sat"] * 40)])
    streams = {}

    class Catcher(lm.Trainer):
        def window(self, inputs, rows, resets, live):
            for k in range(rows.shape[1]):
                streams.setdefault(k, []).extend(zip(inputs[live[:, k], k].tolist(), rows[live[:, k], k].tolist(), resets[live[:, k], k].tolist(), strict=True))

    trainer = Catcher(net)
    trainer.read(docs)
    read = []
    for words in streams.values():
        for before, row, keep in words:
            if not keep:
                assert before == net.start
                read.append([])
            else:
                assert before == read[-1][-1]
            read[-1].append(row)
    assert sorted(read) == sorted(d.tolist() for d in docs) and trainer.seen == sum(map(len, docs)) and len(streams) > 1


def test_probabilities_sum_to_one(monkeypatch):
    small(monkeypatch)
    counts, v, net = made(TEXTS)
    lm.Trainer(net).read(rows_of_texts(v, TEXTS))
    states = np.tanh(np.random.default_rng(1).normal(0, 1, (3, lm.HIDDEN))).astype(np.float32)
    every = sum(np.exp(net.log_probability(states, np.full(3, i, np.uint16))) for i in range(v.rows))
    assert np.allclose(every, 1, atol=1e-5)
    for k in range(lm.BUCKETS):  # inside a set: its words, and one share for words never seen
        inside = [c + 1 for w, c in counts.items() if w not in v.words[: v.short] and lm.set_of(w, lm.BUCKETS) == k]
        assert sum(inside) + 1 == v.set_words[k] + v.set_distinct[k] + 1


def test_scoring_against_one_word_at_a_time(spark, monkeypatch, docs_of):
    small(monkeypatch)
    counts_df, v, net = lm.fit(spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string"))
    counts = {bytes(r["word"]): r["c"] for r in counts_df.collect()}
    own, plain_v, _ = made(TEXTS)
    if len(v.words) == len(plain_v.words):
        assert v.set_words.tolist() == plain_v.set_words.tolist() and v.set_distinct.tolist() == plain_v.set_distinct.tolist()
    assert v.set_words.sum() == v.total - v.counts[: v.short].sum() and v.set_distinct.sum() == v.distinct - v.short
    assert counts == dict(own) and v.words == sorted(v.words, key=lambda w: (-counts[w], w)) and 0 < len(v.words) <= lm.HEAD
    assert min(v.counts) > max((c for w, c in counts.items() if w not in v.words), default=0)
    asked = ["", "the cat sat", "Unseen WORDS and the log", "time upon once " * 50, "dog"]
    rows = lm.score(spark.createDataFrame(list(enumerate(asked)), "id long, text string"), counts_df, v, net).collect()
    assert len(rows) == len(asked)
    for r in rows:
        t = asked[r["id"]]
        assert r["score"] == pytest.approx(plain_score(net, v, counts, t), rel=1e-4)
        words = plain_words(t)
        total, distinct = sum(counts.values()), len(counts)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w.encode(), 0) + 1) / (total + distinct + 1)) for w in words))
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w.encode() in counts for w in words))


def test_query(spark, monkeypatch):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"], strict=True))
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, x in texts.items() if not out[d] for w in plain_words(x))
    total, distinct = sum(counts.values()), len(counts)
    monkeypatch.setattr(lm, "HEAD", 3000)
    rows = op8_recurrent_lm_scoring(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = plain_words(texts[r["doc_id"]])
        want = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert r["base_score"] == pytest.approx(want) and r["held_out"] == out[r["doc_id"]] and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(counts[w] > 0 for w in words))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_weights_and_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    small(monkeypatch, GROUP=3, GROUP_WORDS=40, ROUNDS=2)
    rows = list(enumerate(TEXTS * 4))
    docs = spark.createDataFrame(rows, "id long, text string")
    one, other = (lm.fit(docs.repartition(n)) for n in (4, 16))
    assert one[1].total == sum(len(plain_words(t)) for _, t in rows) > 10 * lm.GROUP_WORDS
    assert all(np.array_equal(x, other[2].w[k]) and np.isfinite(x).all() for k, x in one[2].w.items())
    got = [{r["id"]: r["score"] for r in lm.score(docs.repartition(n), *one).collect()} for n in (3, 9)]
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(x, rel=1e-6) for k, x in got[1].items())


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "x y"), (3, "x y"), (4, "word " * 30_000)]
    docs = docs_of(rows).withColumn("row", F.lit(1)).withColumn("c", F.lit("clash"))
    plain = docs.select(F.col("doc_id").alias("id"), "text")
    fitted = lm.fit(plain)
    got = lm.score(plain, *fitted).collect()
    assert len(got) == len(rows) and sorted(r["n_tokens"] for r in got) == [1, 1, 3, 3, 3, 30_001]
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    none = lm.fit(plain.limit(0))
    empty = lm.score(plain, *none).collect()
    assert {r["base_score"] for r in empty} == {0.0} and {r["n_known"] for r in empty} == {0}
    assert lm.score(plain.limit(0), *fitted).count() == 0
    assert [r["h"] for r in docs.select(lm.held_out("doc_id", 7, 2).alias("h")).where("doc_id is null").collect()] == [True]


def test_all_words_follow_their_context():
    """Each of the 2,000 most frequent words, and each set of the others, has weights of its own."""
    words = [f"w{i}".encode() for i in range(3000)]
    sets = np.zeros((2, lm.BUCKETS), np.int64)
    for i, w in enumerate(words[lm.SHORT :]):
        sets[:, lm.set_of(w, lm.BUCKETS)] += 3952 - i, 1
    v = lm.Vocabulary(words, np.arange(6000, 3000, -1), 13_500_000, 3000, "short", min(lm.SHORT, len(words)), *sets)
    net = lm.Network(v)
    net.w["out"] = np.random.default_rng(3).normal(0, 1, net.w["out"].shape).astype(np.float32)
    rows = np.r_[1500, 2000, v.short + np.flatnonzero(sets[1])].astype(np.uint16)
    one, other = (net.log_probability(np.full((len(rows), lm.HIDDEN), x, np.float32), rows) for x in (0.5, -0.5))
    assert (np.abs(one - other) > 1e-3).all() and len(np.unique(net.class_of[rows])) == 3


def test_scoring_makes_no_array_for_each_word_of_a_long_text(monkeypatch):
    """The states of a text's steps lie in one array; none is made for each step, however few texts are left."""
    small(monkeypatch)
    _, v, net = made(TEXTS)
    made_arrays, plain_empty = [], np.empty
    docs = rows_of_texts(v, ["the cat sat on the mat " * 300, *TEXTS])
    monkeypatch.setattr(lm.np, "empty", lambda *a, **k: made_arrays.append(1) or plain_empty(*a, **k))
    found = lm.Scorer(net).score(docs)
    assert len(docs[0]) > 1800 and len(made_arrays) < 100
    alone = [lm.Scorer(net).score([d])[0] for d in docs]
    assert np.allclose(found, alone, rtol=1e-5) and lm.Scorer(net).score([]).tolist() == []
