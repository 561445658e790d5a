"""The least that has to move to turn one order into another."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def staying(places: list[int]) -> list[bool]:
    """Which of distinct old places, given in the new order, are those of a longest run that keeps its order. Of several
    such runs the one that ends last in the new order, and before each of whose members the latest possible one stands."""
    tops: list[int] = []  # the smallest last place of a run of each length
    length = []
    for x in places:
        at = bisect_left(tops, x)
        tops[at : at + 1] = [x]
        length.append(at + 1)
    out, wanted = [False] * len(places), len(tops)
    for i in range(len(places) - 1, -1, -1):
        if length[i] == wanted:
            out[i], wanted = True, wanted - 1
    return out


def moves(matched: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """Matched rows (keys, old and new place) with ``moved``: whether a row changes its place among those that stay.

    As few rows as can be are moved: the others are a longest increasing subsequence of the old places in the new
    order, found in n log n. A key's rows are one ordered stream, of which a task holds the places alone; batches may
    hold parts of keys or many of them.
    """
    kind = T.StructType([*matched.schema.fields, T.StructField("moved", T.BooleanType())])
    ordered = matched.repartition(*keys).sortWithinPartitions(*keys, new)
    return ordered.mapInPandas(partial(_moved, keys=keys, old=old), kind)


def _moved(batches: Iterator[pd.DataFrame], keys: list[str], old: str) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        new = (rows[keys] != rows[keys].shift()).any(axis=1) & ~(rows[keys].isna() & rows[keys].shift().isna()).all(axis=1)
        starts = np.flatnonzero(new.to_numpy() | (np.arange(len(rows)) == 0))
        out = np.zeros(len(rows), bool)
        places = rows[old].tolist()
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            out[a:b] = staying(places[a:b])
        return rows.assign(moved=~out)

    for b in batches:
        if not len(b):
            continue
        b = b.astype({c: object for c in b.columns if isinstance(b[c].dtype, pd.StringDtype)})  # parts of such columns cannot be joined for Arrow
        last = tuple(b[keys].iloc[-1].tolist())
        same = np.ones(len(b), bool)
        for k, v in zip(keys, last, strict=True):
            same &= (b[k].isna() if pd.isna(v) else b[k] == v).to_numpy()
        cut = len(b) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:  # all keys but the last one are complete
            yield told(pd.concat([*held, b.iloc[:cut]], ignore_index=True))
            held = []
        held.append(b.iloc[cut:])
    if held:
        yield told(pd.concat(held, ignore_index=True))
