"""Aggregates behind the report, the usage table and the evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import shared


def chapters(turns: DataFrame) -> DataFrame:
    """One row per conversation: segment states, narrated and spoken characters, a default title."""
    narrated = F.col("role") == "system"
    chars = lambda cond: F.coalesce(F.sum(F.when(cond, F.length("text"))), F.lit(0)).cast("long")
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("role") == "user").alias("resolved"),
        F.count_if(F.col("role") == "assistant").alias("surface_only"),
        F.count_if(~F.col("role").isin("user", "assistant")).alias("unknown"),
        chars(narrated).alias("narration_chars"),
        chars(~narrated).alias("spoken_chars"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
    )


def top_and_other(per: DataFrame, name: str, by: str, sums: list[str], n: int) -> DataFrame:
    """The n largest rows, and the sum of all others as one."""
    top = per.orderBy(F.desc(by), name).limit(n)
    rest = per.join(top.select(name), name, "left_anti").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(c) for c in sums]).where("_rows > 0")
    return top.select(name, *sums).unionByName(rest.select(F.lit("other").alias(name), *sums))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rn from 0 in the order, and n, the number of rows, without sorting everything in one task."""
    placed = shared.numbered(rows, order, "rn")
    return placed.crossJoin(F.broadcast(placed.agg((F.max("rn") + 1).alias("n"))))  # n is one row


def bucketed(rows: DataFrame, most: int) -> DataFrame:
    """bucket: rows (rn, n) in at most so many runs of equal length."""
    return rows.withColumn("bucket", F.floor(F.col("rn") / F.ceil(F.col("n") / F.lit(float(most)))).cast("int"))


def heatmap(rows: DataFrame, name: str, bucket: str, top: int, steps: int) -> DataFrame:
    """Counts of the top names by bucket, and their step of the largest count."""
    per = rows.groupBy(name, bucket).agg(F.count("*").alias("n"))
    best = per.groupBy(name).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), name).limit(top).select(name)
    kept = per.join(best, name)
    most = kept.agg(F.max("n").alias("most"))
    return kept.join(F.broadcast(most)).select(name, bucket, "n", F.ceil(F.col("n").cast("double") / F.col("most") * steps).cast("int").alias("step"))  # most is one row


def usage(runs: DataFrame, keys: list[str], total: bool = False, price: float = 0.5) -> DataFrame:
    """Counts, conditional sums, distinct chapters, tokens, last run and cost; with a total row by rollup."""
    tokens = F.coalesce(F.sum("value"), F.lit(0.0))
    grouped = runs.rollup(*keys) if total else runs.groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("event_type") == "purchase").alias("succeeded"),
        F.count_if(F.col("event_type") == "error").alias("failed"),
        F.countDistinct("user_id").alias("chapters"),
        F.round(tokens, 2).alias("tokens"),
        F.max("ts").alias("last_run"),
        F.round(tokens * price / 1000, 4).alias("cost"),
    )


def evaluated(scored: DataFrame, keys: list[str], guess: Column, gold: Column) -> DataFrame:
    """correct, wrong, unattributed and accuracy (0 where there is nothing to score)."""
    correct = F.count_if(guess == gold)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("total"),
        correct.alias("correct"),
        F.count_if(guess != gold).alias("wrong"),
        F.count_if(guess.isNull()).alias("unattributed"),
        F.round(F.coalesce(F.try_divide(correct, F.count("*")), F.lit(0.0)), 6).alias("accuracy"),
    )
