"""Words of texts without spaces: a lexicon learned from the texts, and the cheapest path through it.

A run of letters is a word if its parts hold together (cohesion: how much more often they occur together than their
own frequencies say, at the weakest cut) and its neighbours are free (entropy: how many different characters stand
before and after it). Both come from counts of n-grams by aggregation, so the lexicon grows from any number of texts.
A text is cut where the sum of its words' costs is smallest; a word costs the logarithm of its rarity, and a character
in no word as much as the rarest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.shared import written

#: Runs in which words are looked for, by default those of Chinese characters.
HAN = r"\p{IsHan}+"
#: Characters of a word at most. Words of a lexicon at most: it is sent to every task.
LONGEST = 4
MOST = 200_000


def _contexts(texts: DataFrame, text_col: str, pattern: str, longest: int) -> DataFrame:
    """n-grams with the characters before and after them (none at the ends of runs), and how often they stand so. Equal
    runs are counted first, so a word is cut once, however often it occurs."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0))).alias("run"))
    counted = runs.groupBy("run").agg(F.count("*").alias("f"))
    placed = counted.select("run", "f", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.length("run") >= F.col("n"))
    at = placed.select("run", "f", "n", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("n") + 1)).alias("i"))
    piece = lambda start, n: F.substring("run", start, n)
    before = F.when(F.col("i") > 1, piece(F.col("i") - 1, F.lit(1)))
    after = F.when(F.col("i") + F.col("n") <= F.length("run"), piece(F.col("i") + F.col("n"), F.lit(1)))
    grams = at.select("n", piece(F.col("i"), F.col("n")).alias("gram"), before.alias("before"), after.alias("after"), "f")
    return written(grams.groupBy("n", "gram", "before", "after").agg(F.sum("f").alias("f")), "contexts")


def _entropy(contexts: DataFrame, side: str) -> DataFrame:
    """Of each n-gram the entropy of its neighbours on one side; an end of a run is a neighbour of its own each time."""
    n = F.col("n")
    counts = contexts.where(F.col(side).isNotNull()).groupBy("gram", side).agg(F.sum("f").alias("n"))
    ends = contexts.where(F.col(side).isNull()).groupBy("gram").agg(F.sum("f").alias("ends"))
    inner = counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum(n * F.log(n)).alias("x"))
    both = inner.join(ends, "gram", "full").fillna(0, ["n", "ends"]).fillna(0.0, ["x"])
    total = F.col("n") + F.col("ends")
    return both.select("gram", (F.log(total) - F.col("x") / total).alias(f"free_{side}"))


def statistics(texts: DataFrame, text_col: str = "text", pattern: str = HAN, longest: int = LONGEST, least: int = 10) -> DataFrame:
    """n-grams of 2 to longest characters that occur least times: gram, n (how often), cohesion, free_before, free_after."""
    contexts = _contexts(texts, text_col, pattern, longest)
    counted = contexts.groupBy("n", "gram").agg(F.sum("f").alias("f"))
    total = counted.where("n = 1").agg(F.sum("f").alias("total"))
    common = counted.where(F.col("f") >= least).select("gram", "f")
    kept = counted.where((F.col("n") > 1) & (F.col("f") >= least))
    cut = F.explode(F.sequence(F.lit(1), F.col("n") - 1))
    parts = kept.select("gram", "f", cut.alias("k")).select("gram", "f", F.expr("substring(gram, 1, k)").alias("a"), F.expr("substring(gram, k + 1)").alias("b"))
    scored = parts.join(common.select(F.col("gram").alias("a"), F.col("f").alias("fa")), "a").join(common.select(F.col("gram").alias("b"), F.col("f").alias("fb")), "b")
    scored = scored.crossJoin(F.broadcast(total))  # one row
    cohesion = scored.groupBy("gram").agg(F.max("f").alias("f"), F.min(F.log(F.col("f") * F.col("total") / (F.col("fa") * F.col("fb")))).alias("cohesion"))
    some = contexts.join(kept.select("gram"), "gram", "left_semi")
    return cohesion.join(_entropy(some, "before"), "gram").join(_entropy(some, "after"), "gram").select("gram", F.col("f").alias("n"), "cohesion", "free_before", "free_after")


def learned(stats: DataFrame, cohesion: float = 1.0, freedom: float = 1.0, most: int = MOST) -> DataFrame:
    """The words (word, n) among n-grams; of more than most the most frequent ones, since the lexicon goes to all tasks."""
    free = F.least("free_before", "free_after")
    words = stats.where((F.col("cohesion") >= cohesion) & (free >= freedom)).select(F.col("gram").alias("word"), "n")
    return words.orderBy(F.desc("n"), "word").limit(most)


def cheapest(run: str, cost: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The cut of a run with the smallest sum of costs; of equal ones that with the longer last word."""
    best, step = [0.0], [0]
    for end in range(1, len(run) + 1):
        options = [(best[end - 1] + cost.get(run[end - 1], unknown), 1)]
        options += [(best[end - n] + cost[run[end - n : end]], n) for n in range(2, min(longest, end) + 1) if run[end - n : end] in cost]
        total, n = min(options, key=lambda x: (x[0], -x[1]))
        best.append(total)
        step.append(n)
    out, end = [], len(run)
    while end:
        out.append(run[end - step[end] : end])
        end -= step[end]
    return out[::-1]


def _cut(batches: Iterator[pd.DataFrame], cost: dict[str, float], unknown: float, longest: int, pattern: str) -> Iterator[pd.DataFrame]:
    import regex

    run = regex.compile(pattern.replace(r"\p{Is", r"\p{"))
    for b in batches:
        words = [[w for m in run.findall((t or "").lower()) for w in cheapest(m, cost, unknown, longest)] for t in b["_text"]]
        yield b.drop(columns="_text").assign(words=words)


def segmented(texts: DataFrame, lexicon: DataFrame, keys: list[str], text_col: str = "text", pattern: str = HAN) -> DataFrame:
    """keys and words: the words of each text in order, repeats included. lexicon: word, n."""
    held = lexicon.limit(MOST).collect()  # bounded
    total = sum(r["n"] for r in held) or 1
    cost = {r["word"]: math.log(total / r["n"]) for r in held}
    unknown = max(cost.values(), default=1.0) + 1.0
    longest = max(map(len, cost), default=1)
    plain = texts.select(*keys, F.col(text_col).alias("_text"))
    kind = T.StructType([*[plain.schema[k] for k in keys], T.StructField("words", T.ArrayType(T.StringType()))])
    return plain.mapInPandas(partial(_cut, cost=cost, unknown=unknown, longest=longest, pattern=pattern), kind)


def word_set(words: Column) -> Column:
    """The distinct words of more than one character: what a memory search asks for."""
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))
