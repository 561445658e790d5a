"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Everything here is DataFrame expressions; no Python runs on the executors.

1. A document's size is its number of words. Sources get target shares by weight, capped at ``most`` times what
   they have; what is above the cap is shared again by weight among the others until none is above.
2. A source's documents are dealt by hash into blocks (at most BLOCKS of them, about BLOCK_WORDS words each), and
   its blocks are put in a hashed, permuted order. Its target, in whole words, is met by whole passes over all
   blocks and then by the first blocks of that order; the block in which the target falls is cut, document by
   document, and in it one document is cut to the word. So a source's words taken equal its rounded target. The
   place of the cut is found in two steps, by the sums of SLICES ranges of the order and then in one range alone, so
   no task sorts a whole block.
3. Each source thus has an exact quota of block draws. The splitting tree starts with all quotas at its root and
   halves the output shards at each level: the left half's draws from each source are hypergeometric given what
   is left (sources one after another, by inversion of the distribution function at a hashed uniform number), the
   right half gets the rest. At the leaves every shard has an exact number of draws from each source.
4. A source's draws, numbered in permuted order, are handed to the shards in runs of those numbers, so the shards
   are disjoint; a shard's documents are put in a hashed order of their own. There is a shard for each SHARD_WORDS
   words of the mix (within the bounds SHARDS), and it is written in parts of PART_WORDS words, ranges of its order.

Per document only its own columns, one row of its source and one of its block are needed; both tables are small
(BLOCKS rows a source) and are broadcast up to KEYS rows, joined by shuffle beyond. Documents move once, into
their shard, and not at all for ``plan``.

Defined results: null text has size 0; a null source is a source, ordered last; null ids take part (and share
their place in the order); rows that agree in id and size and fall on the cut share it evenly, rounded down; with
no words at all every target is 0; a node of the tree is one row with a count for each source, so sources, unlike
documents, must be some 100,000 at most; columns that clash with working names are kept apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import settle

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
BLOCK_WORDS = 1 << 14
BLOCKS = 4096
#: Ranges of a cut block's order that are summed before one of them is sorted.
SLICES = 4096
#: Words of an output shard and of a part of one, about; how many shards there are at least and at most.
SHARD_WORDS = 1 << 24
SHARDS = (16, 1024)
PART_WORDS = 1 << 20
#: Rows of a source or block table up to which it is broadcast (some 60 bytes each).
KEYS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def number(*parts: Column | str) -> Column:
    """A whole number below 2**32 that depends on nothing but the parts."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """_id, _src, _size, _h (place in the source's order) and the kept columns."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    with_size = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("_src"), size.alias("_size"), *keep)
    return with_size.withColumn("_h", number("_id"))


def targets(of: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(_src, source_size) -> one row a source: _src, source_size, rank, target, passes, rest, n_blocks.

    The level at which a source reaches its cap is cap / weight. In the order of those levels, the first k sources
    are capped if what is left for the others, by weight, lies at or above the kth level.
    """
    by_name = Window.orderBy(F.col("_src").isNull(), "_src")
    ranked = of.withColumn("rank", F.row_number().over(by_name) - 1)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", cycle).withColumn("cap", F.col("source_size") * float(most))
    every, by_level = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    upward = by_level.rowsBetween(0, Window.unboundedFollowing)
    money = F.sum("source_size").over(every) * float(budget)
    left = F.greatest(money - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.lit(0.0)) / F.sum("w").over(upward)
    ranked = ranked.withColumn("left", left).withColumn("free", F.col("left") < F.col("cap") / F.col("w"))
    share = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "rank", "left"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(share["left"], F.lit(float("inf"))) * F.col("w"))
    quota = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0)
    done = ranked.withColumn("target", target).withColumn("passes", passes.cast("long"))
    done = done.withColumn("rest", (quota - F.col("passes") * F.col("source_size")).cast("long"))
    blocks = F.least(F.greatest(F.ceil(F.col("source_size") / F.lit(BLOCK_WORDS)), F.lit(1)), F.lit(BLOCKS))
    return done.select("_src", "source_size", "rank", "target", "passes", "rest", blocks.cast("long").alias("n_blocks"))


def beside(rows: DataFrame, small: DataFrame, on: Column, n: int) -> DataFrame:
    """rows with their row of a small table: broadcast up to KEYS rows, else by shuffle."""
    return rows.join(F.broadcast(small) if n <= KEYS else small, on, "inner")


def in_block() -> Column:
    return F.pmod(F.col("_h"), F.col("n_blocks"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(good: Column, total: Column, draws: Column, uniform: Column) -> Column:
    """How many of the draws are good, by inversion: weights relative to the mode, out to where they vanish."""

    def grow(length: Column, ratio) -> Column:
        """Weights 1, r0, r0 r1, ... for 1 + length values."""

        def step(acc, i):
            return let(acc["w"] * ratio(i), lambda w: F.struct(w.alias("w"), F.concat(acc["all"], F.array(w)).alias("all")))

        span = F.when(length > 0, F.sequence(F.lit(0), length.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(span, F.struct(F.lit(1.0).alias("w"), F.array(F.lit(1.0)).alias("all")), step, lambda acc: acc["all"])

    def of_range(x):
        up = lambda v: (x["good"] - v) * (x["draws"] - v) / ((v + 1) * (x["total"] - x["good"] - x["draws"] + v + 1))  # noqa: E731  P(v + 1) / P(v)
        above = grow(x["last"] - x["mode"], lambda i: up(x["mode"] + i))
        below = grow(x["mode"] - x["first"], lambda i: F.lit(1.0) / up(x["mode"] - i - 1))
        return let(F.concat(F.reverse(F.slice(below, F.lit(2), F.size(below))), above), lambda w: x["first"] + passed(w, x["uniform"]))

    def passed(weights, uniform):
        """How many of the weights lie below the uniform share of their sum."""
        goal = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) * uniform
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), goal.alias("goal"))
        step = lambda a, w: let(a["sum"] + w, lambda t: F.struct(t.alias("sum"), (a["n"] + F.when(t < a["goal"], 1).otherwise(0)).alias("n"), a["goal"].alias("goal")))
        return F.aggregate(weights, start, step, lambda a: a["n"])

    def of_mode(x):
        p = x["good"] / F.greatest(x["total"], F.lit(1.0))
        spread = F.sqrt(x["draws"] * p * (1 - p)) * 12 + 8
        first, last = F.greatest(x["low"], F.floor(x["mode"] - spread).cast("double")), F.least(x["high"], F.ceil(x["mode"] + spread).cast("double"))
        return let(F.struct(*[x[k].alias(k) for k in ("good", "total", "draws", "uniform", "mode")], first.alias("first"), last.alias("last")), of_range)

    def of_bounds(x):
        mode = F.greatest(x["low"], F.least(x["high"], F.floor((x["draws"] + 1) * (x["good"] + 1) / (x["total"] + 2)).cast("double")))
        some = let(F.struct(*[x[k].alias(k) for k in ("good", "total", "draws", "uniform", "low", "high")], mode.alias("mode")), of_mode)
        return F.when(x["high"] <= x["low"], x["low"]).otherwise(F.least(x["high"], some)).cast("long")

    def of_counts(x):
        low, high = F.greatest(F.lit(0.0), x["draws"] - (x["total"] - x["good"])), F.least(x["draws"], x["good"])
        return let(F.struct(*[x[k].alias(k) for k in ("good", "total", "draws", "uniform")], low.alias("low"), high.alias("high")), of_bounds)

    counts = F.struct(good.cast("double").alias("good"), total.cast("double").alias("total"), draws.cast("double").alias("draws"), uniform.alias("uniform"))
    return let(counts, of_counts)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, draws) -> (rank, ends): for each source the number of its draws in the first 1, 2, ... shards."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "draws"))), lambda x: x["draws"])
    node = quotas.agg(ordered.alias("counts")).select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "counts")
    width = shards
    while width > 1:
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        half = F.floor(F.col("width") / 2).cast("int")
        parted = node.withColumn("half", half).withColumn("total", total).withColumn("draws", F.floor(F.col("total") * F.col("half") / F.col("width")))

        def draw(acc, i):
            here = F.element_at("counts", (i + 1).cast("int"))
            uniform = (number(F.lit(f"tree{seed}"), F.col("first"), F.col("width"), i) + 0.5) / 2.0**32
            after = lambda got: F.struct((acc["total"] - here).alias("total"), (acc["draws"] - got).alias("draws"), F.concat(acc["out"], F.array(got)).alias("out"))
            return let(hypergeometric(here, acc["total"], acc["draws"], uniform), after)

        start = F.struct("total", "draws", F.array().cast("array<bigint>").alias("out"))
        order = F.when(F.size("counts") > 0, F.sequence(F.lit(0), F.size("counts") - 1)).otherwise(F.array().cast("array<int>"))
        left = F.when(F.col("half") == 0, F.transform("counts", lambda x: x * 0)).otherwise(F.aggregate(order, start, draw, lambda a: a["out"]))
        parted = parted.withColumn("left", left).withColumn("right", F.zip_with("counts", "left", lambda a, b: a - b))
        sides = F.array(
            F.struct("first", F.col("half").alias("width"), F.col("left").alias("counts")),
            F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("width") - F.col("half")).alias("width"), F.col("right").alias("counts")),
        )
        node = parted.select(F.inline(sides)).where("width > 0")
        width = (width + 1) // 2
    per = node.select("first", F.posexplode("counts").alias("rank", "n"))
    runs = F.transform(F.array_sort(F.collect_list(F.struct("first", "n"))), lambda x: x["n"])
    ends = F.transform(F.sequence(F.lit(1), F.size("runs")), lambda k: F.aggregate(F.slice("runs", F.lit(1), k), F.lit(0).cast("long"), lambda a, n: a + n))
    return per.groupBy("rank").agg(runs.alias("runs")).select("rank", ends.alias("ends"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, shards: int | None = None, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: _id, _src, _size, the kept columns, source_size, target, draws: array<(shard, words)>."""
    keep = keep or []
    rows = sized(docs, id_col, text_col, source_col, keep)
    plain = rows.drop(*keep)
    if not keep:
        rows = plain = settle(plain, "sizes")
    else:
        plain = settle(plain, "sizes")
    sums = plain.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    sources = settle(targets(sums, weights, budget, most), "sources")
    n_sources = sources.count()
    same = F.col("_src").eqNullSafe(F.col("s_src"))
    named = sources.select(*[F.col(c).alias(f"s{c}" if c == "_src" else c) for c in sources.columns])

    # Blocks in their permuted order, with the words before each.
    held = beside(plain, named, same, n_sources).groupBy("rank", in_block().alias("block"), "_src", "rest", "passes").agg(F.sum("_size").alias("words"))
    at = Window.partitionBy("rank").orderBy(number(F.lit(f"block{seed}"), F.col("_src"), F.col("block")), "block")
    blocks = held.withColumn("place", F.row_number().over(at) - 1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = settle(blocks, "blocks")
    n_blocks = blocks.count()

    # The place in each source's order where its target is met: one block, in it one slice, one place, one document.
    cut = blocks.where("before < rest and rest < before + words").select(F.col("rank").alias("c_rank"), F.col("block").alias("c_block"), (F.col("rest") - F.col("before")).alias("room"))
    n_cut = n_sources
    inside = beside(plain, named, same, n_sources).withColumn("block", in_block())
    inside = beside(inside, cut, (F.col("rank") == F.col("c_rank")) & (F.col("block") == F.col("c_block")), n_cut)
    inside = inside.select("rank", "_h", "_id", "_size", "room", F.floor(F.col("_h") / (2**32 // SLICES)).alias("slice"))
    slices = inside.groupBy("rank", "room", "slice").agg(F.sum("_size").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("rank").orderBy("slice"))
    met = slices.withColumn("upto", upto).where((F.col("upto") - F.col("held") < F.col("room")) & (F.col("room") <= F.col("upto")))
    met = met.select(F.col("rank").alias("m_rank"), F.col("slice").alias("m_slice"), (F.col("room") - F.col("upto") + F.col("held")).alias("left"))
    near = beside(inside, met, (F.col("rank") == F.col("m_rank")) & (F.col("slice") == F.col("m_slice")), n_cut)
    peers = near.groupBy("rank", "_h", "_id", "_size", "left").agg(F.count("*").alias("n"))
    line = Window.partitionBy("rank").orderBy("_h", F.col("_id").asc_nulls_first(), "_size")
    earlier = F.coalesce(F.sum(F.col("n") * F.col("_size")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = peers.withColumn("earlier", earlier).where((F.col("earlier") < F.col("left")) & (F.col("left") <= F.col("earlier") + F.col("n") * F.col("_size")))
    ends = ends.select("rank", F.col("_h").alias("e_h"), F.col("_id").alias("e_id"), F.col("_size").alias("e_size"), F.floor((F.col("left") - F.col("earlier")) / F.col("n")).alias("e_words"))
    cut_at = cut.join(ends, cut["c_rank"] == ends["rank"]).select("c_rank", "c_block", "e_h", "e_id", "e_size", "e_words")

    # Draws of each source: whole passes over all blocks, then the blocks that the rest reaches.
    reached = F.sum(F.when(F.col("before") < F.col("rest"), 1).otherwise(0))
    quotas = blocks.groupBy("rank").agg((F.max("passes") * F.count("*") + reached).alias("draws"), F.count("*").alias("blocks_held"))
    if shards is None:
        shards = shards_for(sources.agg(F.sum("target")).first()[0])
    dealt = splitting_tree(quotas.select("rank", "draws"), shards, seed)
    per_source = named.join(quotas.select(F.col("rank").alias("q_rank"), "blocks_held"), F.col("rank") == F.col("q_rank"))
    per_source = per_source.join(dealt.withColumnRenamed("rank", "t_rank"), F.col("rank") == F.col("t_rank"))
    per_source = per_source.join(cut_at, F.col("rank") == F.col("c_rank"), "left").drop("q_rank", "t_rank", "c_rank")
    parts = F.greatest(F.lit(1), F.ceil(F.sum("target").over(Window.partitionBy()) / F.lit(PART_WORDS * shards)))
    per_source = settle(per_source.withColumn("n_parts", parts.cast("int")), "plan")

    full = beside(rows, per_source, same, n_sources).withColumn("block", in_block())
    order = blocks.select(F.col("rank").alias("b_rank"), F.col("block").alias("b_block"), "place", "before")
    full = beside(full, order, (F.col("rank") == F.col("b_rank")) & (F.col("block") == F.col("b_block")), n_blocks)

    key = F.struct(F.col("_h"), F.coalesce(F.col("_id"), F.lit(-(2**63))), F.col("_size"))
    edge = F.struct(F.col("e_h"), F.coalesce(F.col("e_id"), F.lit(-(2**63))), F.col("e_size"))
    of_rest = (
        F.when(F.col("before") >= F.col("rest"), 0)
        .when(F.col("c_block").isNull() | (F.col("block") != F.col("c_block")), F.col("_size"))
        .when(key < edge, F.col("_size"))
        .when(key == edge, F.col("e_words"))
        .otherwise(0)
    )
    shard = lambda copy: F.size(F.filter("ends", lambda e: e <= copy * F.col("blocks_held") + F.col("place")))
    words = lambda copy: F.when(copy < F.col("passes"), F.col("_size")).otherwise(of_rest).cast("long")
    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda c: F.struct(shard(c).alias("shard"), words(c).alias("words"), c.alias("copy")))
    return full.select("_id", "_src", "_h", "_size", *keep, "source_size", "target", "n_parts", F.filter(copies, lambda x: x["words"] > 0).alias("draws"))


def shards_for(words: float | None) -> int:
    """How many shards a mix of so many words has."""
    return min(SHARDS[1], max(SHARDS[0], math.ceil((words or 0) / SHARD_WORDS)))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 0, **how) -> DataFrame:
    """The mix: docs' rows once for each draw, with shard, words and copy, dealt into shards and shuffled in each.

    A shard's order is that of a hashed place; its rows come in parts that are ranges of places, each sorted, so a
    shard of any size is written by many tasks.
    """
    from_docs = docs.select(id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    drawn = plan(from_docs, id_col, text_col, source_col, shards=shards, seed=seed, keep=["_row"], **how)
    rows = drawn.select("_id", "_row", F.inline("draws"), "_h", "_size", "n_parts")
    place = number(F.lit(f"shard{seed}"), F.col("shard"), F.col("_id"), F.col("copy"))
    placed = rows.withColumn("_place", place).withColumn("part", F.floor(F.col("_place") * F.col("n_parts") / 2.0**32).cast("int"))
    return placed.repartition("shard", "part").sortWithinPartitions("shard", "part", "_place", "_id", "_size").drop("n_parts")
