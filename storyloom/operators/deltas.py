"""Derived tables kept up to date by changes: rows that come (+1) and go (-1), carried through a derivation.

A derivation is a function of the rows of a key alone (a history, what memory says of an entity). Of a change only the
keys it touches are derived, once from the rows before and once from those after it; what differs is the change of the
derived table. Changes are multisets, so rows that were there twice can go once, and a change and its opposite cancel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGN = "_sign"


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """What must come and go so that before becomes after."""
    return netted(before.withColumn(SIGN, F.lit(-1)).unionByName(after.withColumn(SIGN, F.lit(1))))


def netted(changes: DataFrame) -> DataFrame:
    """One row for each different row, with how many more of it come than go; those that cancel vanish."""
    columns = [c for c in changes.columns if c != SIGN]
    return changes.groupBy(*columns).agg(F.sum(SIGN).cast("long").alias(SIGN)).where(F.col(SIGN) != 0)


def applied(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows after the changes. Rows that are to go and are not there are an error of whoever made the changes: they
    make the row's count negative, and the row is left out."""
    now = netted(rows.withColumn(SIGN, F.lit(1)).unionByName(changes.select(*rows.columns, SIGN)))
    return now.where(F.col(SIGN) > 0).withColumn("_each", F.explode(F.sequence(F.lit(1), F.col(SIGN).cast("int")))).drop("_each", SIGN)


def carried(rows: DataFrame, changes: DataFrame, keys: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The changes of derive(rows) that the changes of rows make. Rows of other keys are read past, not derived: the
    touched keys are a semi-join below the derivation. Null keys are keys like any other."""
    touched = changes.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    before = rows.join(touched, same, "left_semi")
    return changed(derive(before), derive(applied(before, changes)))


def maintained(derived: DataFrame, carried_changes: DataFrame) -> DataFrame:
    """The derived table after its changes."""
    return applied(derived, carried_changes)
