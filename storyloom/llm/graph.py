"""Connected components over a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import release, settle


#: Links from which the smallest neighbours are a table of their own, so that Spark can split a hub's partition in the
#: join with them; below, the aggregate is joined as it is. The result is the same.
MANY = 1 << 20


def _least(links: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    if held is None:
        return least
    held.append(settle(least, "least"))
    return held[-1]


def _large_star(edges: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, held).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, held)
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): the smallest node of each linked node's component.

    Each round replaces the links by stars around smaller nodes and settles them in the shared folder; the rounds
    needed grow with the logarithm of the component size, and a round's tables go when the next one is there. Nodes
    without a link do not appear. No round holds more links than twice the first one, and nothing but a count and a
    checksum reaches the driver.
    """
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
    now = settle(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = now.agg(*mark).first()
    while seen["n"]:
        held = [] if seen["n"] >= MANY else None
        large = _large_star(now, held).distinct()
        if held is not None:
            large = settle(large, "large-stars")
        after = settle(_small_star(large, held).distinct(), "links")
        release(now, *(held or []), *([] if held is None else [large]))
        now, told = after, after.agg(*mark).first()
        if told == seen:
            break
        seen = told
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
