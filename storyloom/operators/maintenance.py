"""Set operations and table maintenance on immutable files: every change is a new DataFrame to be published whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key."""
    return existing.join(incoming, keys, "left_anti").select(existing.columns).unionByName(incoming.select(existing.columns))


def inserted_if_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet are added; others are dropped."""
    return existing.unionByName(incoming.join(existing, keys, "left_anti").select(existing.columns))


def replaced(existing: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """All rows of the scopes that incoming touches are replaced by incoming's."""
    return upserted(existing, incoming, scope)


def compare_and_set(existing: DataFrame, incoming: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert, but only of rows whose version still is the current one."""
    return upserted(existing, incoming.join(current.select(key, version), [key, version], "left_semi"), [key])


def merged_later_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of the parts; of rows with one key that of the last part stays."""
    numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    best = Window.partitionBy(*keys).orderBy(F.desc("_part"))
    whole = reduce(lambda a, b: a.unionByName(b), numbered)
    return whole.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_part", "_n")


def distinct_in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first in the order."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def without(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(seen, keys, "left_anti")


def cascade(parents: DataFrame, chain: list[tuple[str, DataFrame, str, str]]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What goes and what stays when the parents are deleted.

    chain: (name, table, its foreign key, the key of the level above); each level's deleted rows select the next's.
    """
    out, above = {}, parents
    for name, rows, own, upper in chain:
        gone = rows.join(above.select(F.col(upper).alias(own)).distinct(), own, "left_semi")
        out[name] = (gone, rows.join(above.select(F.col(upper).alias(own)).distinct(), own, "left_anti"))
        above = gone
    return out


def matched(existing: DataFrame, incoming: DataFrame, ident: str, key: str, hash_col: str) -> DataFrame:
    """Old rows to new ones in two passes: by content hash, the nth of a hash with the nth; then by identity keys
    that are unique on both sides among what is left. Returns old id, new id and how: kept, edited, removed, added.

    Both sides go through together: one shuffle by hash numbers and pairs them, one by key pairs what is left.
    """
    told = lambda rows, new: rows.select(F.col(ident).alias("id"), F.col(key).alias("k"), F.col(hash_col).alias("h"), F.lit(new).alias("new"))
    nth = F.row_number().over(Window.partitionBy("h", "new").orderBy("k", "id"))
    numbered = told(existing, False).unionByName(told(incoming, True)).repartition("h").withColumn("n", nth)
    side = lambda new: F.max(F.when(F.col("new") == new, F.col("id")))
    pairs = numbered.groupBy("h", "n").agg(side(False).alias("old_id"), side(True).alias("new_id"), F.max("k").alias("k"))
    both = F.col("old_id").isNotNull() & F.col("new_id").isNotNull()
    kept = pairs.where(both).select("old_id", "new_id", F.lit("kept").alias("how"))
    left = pairs.where(~both).select("k", "old_id", "new_id")
    of_key = Window.partitionBy("k")
    counted = left.withColumns({"olds": F.count("old_id").over(of_key), "news": F.count("new_id").over(of_key)})
    # Rows of a key that is unique on both sides meet in one group, all others stay alone.
    alone = F.when((F.col("olds") != 1) | (F.col("news") != 1), F.struct("old_id", "new_id"))
    met = counted.groupBy("k", alone.alias("alone")).agg(F.max("old_id").alias("old_id"), F.max("new_id").alias("new_id"))
    how = F.when(both, "edited").when(F.col("new_id").isNull(), "removed").otherwise("added")
    return kept.unionByName(met.select("old_id", "new_id", how.alias("how")))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, column: str, known: DataFrame, ident: str) -> DataFrame:
    """Rows whose reference is not null and leads nowhere."""
    return rows.where(F.col(column).isNotNull()).join(known.select(F.col(ident).alias(column)), column, "left_anti")


def invalidated(history: DataFrame, at: str, since: Column, closers: list[str]) -> DataFrame:
    """A history without what was derived from a chapter on; rows that only such facts closed are open again.

    closers: the column with the closing time first, then others that go with it.
    """
    reopened = F.col(closers[0]) >= since
    kept = history.where(F.col(at) < since)
    return kept.withColumns({c: F.when(~F.coalesce(reopened, F.lit(False)), F.col(c)) for c in closers})


def cleared(rows: DataFrame, scope: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Derived pointers of the rows in scope become null; the rows stay."""
    hit = rows.join(scope.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return hit.withColumns({c: F.when(F.col("_hit").isNull(), F.col(c)) for c in columns}).drop("_hit")
