"""Who an entity is after merges of merges, with undo, and where its rows go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.shared import written


class Cycle(ValueError):
    """Merges that lead back to where they began."""


def active(merges: DataFrame, undone: DataFrame | None = None) -> DataFrame:
    """Merges (merge_id, source_id, target_id) that hold: not undone, and of several of one source the last."""
    held = merges if undone is None else merges.join(undone.select("merge_id").distinct(), "merge_id", "left_anti")
    return held.groupBy("source_id").agg(F.max_by("target_id", "merge_id").alias("target_id"))


def roots(links: DataFrame) -> DataFrame:
    """Links (source_id, target_id), at most one a source -> (source_id, root_id), where following them ends.

    Pointer doubling: in each round every pointer is replaced by its target's, so chains of n links take log2(n) rounds
    of one join each, whatever their number. Raises Cycle if some links have no end. Null ids lead nowhere, and a link
    to itself is none.
    """
    now = written(links.select("source_id", "target_id").where("source_id <> target_id"), "pointers")
    for _ in range(now.count().bit_length() + 1):
        onward = now.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("_next"))
        moved = now.join(onward, "target_id", "left")
        now = written(moved.select("source_id", F.coalesce("_next", "target_id").alias("target_id"), F.col("_next").isNotNull().alias("_moved")), "pointers")
        if now.where("_moved").isEmpty():
            return now.select("source_id", F.col("target_id").alias("root_id"))
        now = now.drop("_moved")
    # What still moves leads into a cycle; the cycles' own members are those that something points to.
    stuck = now.join(now.select(F.col("target_id").alias("source_id")).distinct(), "source_id", "left_semi").orderBy("source_id").limit(10)
    raise Cycle(f"merges in a circle: {[r['source_id'] for r in stuck.collect()]}")


def refused(merges: DataFrame, undone: DataFrame | None, source, target) -> bool:
    """Whether merging source into target would close a circle, given the merges that hold."""
    if source == target:
        return True
    known = roots(active(merges, undone))
    end = known.where(F.col("source_id") == target).select("root_id").first()
    return (end["root_id"] if end else target) == source


def reassigned(rows: DataFrame, entity: str, at: str, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of an entity go to who it is now, by merges (all of its rows) and splits (from a chapter on) alike.

    moves: source_id, target_id, since (null: a merge). A row goes to where its entity's merges end; if that one was
    split, to the target of the latest split that is not after the row; and to where that one's merges end. Returns the
    rows, and the audit: source_id, target_id (where the rows ended), n.
    """
    ends = roots(moves.where("since is null").groupBy("source_id").agg(F.max("target_id").alias("target_id")))
    line = Window.partitionBy("source_id").orderBy("since")
    splits = moves.where("since is not null").groupBy("source_id", "since").agg(F.max("target_id").alias("target_id"))
    onward = splits.withColumn("_until", F.lead("since").over(line)).select(F.col("source_id").alias("_now"), F.col("since").alias("_since"), "_until", F.col("target_id").alias("_split"))
    onward = onward.join(ends.select(F.col("source_id").alias("_split"), F.col("root_id").alias("_after")), "_split", "left").withColumn("_split", F.coalesce("_after", "_split")).drop("_after")
    merged = rows.join(ends.select(F.col("source_id").alias(entity), F.col("root_id").alias("_root")), entity, "left").withColumn("_now", F.coalesce("_root", entity))
    holds = (F.col("_since") <= F.col(at)) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    met = merged.alias("m").join(onward.alias("s"), (F.col("m._now") == F.col("s._now")) & holds, "left").select(*[F.col(f"m.`{c}`") for c in rows.columns], F.coalesce("s._split", "m._now").alias("_target"))
    audit = met.where(F.col("_target") != F.col(entity)).groupBy(F.col(entity).alias("source_id"), F.col("_target").alias("target_id")).agg(F.count("*").alias("n"))
    return met.withColumn(entity, F.col("_target")).select(*rows.columns), audit
