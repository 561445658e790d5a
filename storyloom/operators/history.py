"""Append-only histories: latest rows, attempts, superseded facts, intervals, as-of recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in the order; a partial aggregate, so no sort and no wide shuffle."""
    best = F.max(F.struct(*order, F.struct(*[c for c in rows.columns if c not in keys]).alias("_row")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b._row.*").select(*rows.columns)


def first_seen_latest(rows: DataFrame, keys: list[str], at: str, ordinal: str) -> DataFrame:
    """Like latest, but of rows with the same time the one seen first."""
    best = F.max(F.struct(F.col(at), (-F.col(ordinal)).alias("_o"), F.struct(*[c for c in rows.columns if c not in keys]).alias("_row")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b._row.*").select(*rows.columns)


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key; the rank filter is pushed below the window's shuffle as a group limit."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def attempts(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each run's number among those of the same key."""
    return runs.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def superseded(facts: DataFrame, keys: list[str], order: list[str], value: str, ident: str, at: str) -> DataFrame:
    """Slowly changing facts: a value that repeats the one before is dropped; others close it.

    Adds valid_to (the next change's time) and superseded_by, and old_value for the change log.
    """
    line = Window.partitionBy(*keys).orderBy(*order)
    changed = facts.withColumns({"old_value": F.lag(value).over(line), "nth": F.row_number().over(line)})
    changed = changed.where((F.col("nth") == 1) | ~F.col("old_value").eqNullSafe(F.col(value))).drop("nth")
    return changed.withColumns({"valid_to": F.lead(at).over(line), "superseded_by": F.lead(ident).over(line)})


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """start <= at < end; an open end never passes."""
    return (start <= at) & (end.isNull() | (at < end))


def as_of(history: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str) -> DataFrame:
    """The fact that held at each point; of a key's facts at most one holds at a time, as in ``superseded``.

    Facts and points are merged into one ordered line a key, on which each point gets the last fact before it: a union
    and one sort, no join, so a key with many of both costs their sum. For facts that overlap see ``held_at``.
    """
    rest = [c for c in history.columns if c not in keys]
    own = [c for c in points.columns if c not in keys]
    fact = F.when(F.lit(True), F.struct(*rest))
    begun = history.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    facts = begun.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), fact.alias("_fact"))
    asked = points.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_point"))
    line = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = facts.unionByName(asked, allowMissingColumns=True).withColumn("_fact", F.last("_fact", ignorenulls=True).over(line))
    met = merged.where((F.col("_side") == 1) & F.col("_fact").isNotNull()).where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    return met.where(F.col(f"_fact.{end}").isNull() | (F.col("_at") < F.col(f"_fact.{end}"))).select(*keys, "_point.*", "_fact.*")


def held_at(history: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str) -> DataFrame:
    """All facts that held at each point, where a key's facts may overlap; times are whole numbers, an open end never
    passes. An interval sweep: facts and points of a key meet in order."""
    from storyloom.operators.intervals import sweep

    return sweep(points, history, keys, (F.col(at), F.col(at) + 1), (F.col(start), F.col(end)))


def unique_names(names: DataFrame, name: str, ident: str) -> DataFrame:
    """Names that stand for one id only; a name of several ids resolves to null."""
    found = names.groupBy(name).agg(F.min(ident).alias("low"), F.max(ident).alias("high"))
    return found.select(name, F.when(F.col("low") == F.col("high"), F.col("low")).alias(ident))


def stale(heartbeat: Column, started: Column, cutoff: Column) -> Column:
    """Strictly before the cutoff, by the last sign of life."""
    return F.coalesce(heartbeat, started) < cutoff


def run_decision(succeeded: Column, failed: Column, live: Column, dead: Column, most: int = 3) -> Column:
    """What to do with a chapter, given its history under one key."""
    return (
        F.when(live, "skip_running")
        .when(dead, "interrupt_and_run")
        .when(succeeded, "skip_done")
        .when(failed >= most, "skip_failed")
        .otherwise("run")
    )


def until_failure(rows: DataFrame, keys: list[str], order: str, failed: Column) -> DataFrame:
    """Rows up to and with the first failed one of each key: what a run that stops at a failure got to."""
    first = F.min(F.when(failed, F.col(order))).over(Window.partitionBy(*keys))
    return rows.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_first")


def neighbours(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    line = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({"previous": F.lag(order).over(line), "next": F.lead(order).over(line)})
