"""Merges of merges, reordering and changes carried through derivations, against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storyloom.operators import deltas as B
from storyloom.operators import facts as K
from storyloom.operators import identity as I
from storyloom.operators import reorder as O

LINKS = "source_id long, target_id long"


def test_long_chains_end_at_one_root(spark):
    rows = [(i, i + 1) for i in range(1000)] + [(5000, 500), (6000, 6000), (7000, None), (None, 3)]
    got = {r["source_id"]: r["root_id"] for r in I.roots(spark.createDataFrame(rows, LINKS)).collect()}
    assert got == {**{i: 1000 for i in range(1000)}, 5000: 1000}
    assert I.roots(spark.createDataFrame([], LINKS)).count() == 0


def test_circles_are_refused(spark):
    with pytest.raises(I.Cycle, match=r"\[1, 2, 3\]"):
        I.roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1), (4, 5)], LINKS))
    merges = spark.createDataFrame([(1, 10, 20), (2, 20, 30)], "merge_id long, source_id long, target_id long")
    undone = spark.createDataFrame([(1,)], "merge_id long")
    assert I.refused(merges, None, 30, 10) and I.refused(merges, None, 7, 7) and not I.refused(merges, None, 30, 40)
    assert not I.refused(merges, undone, 30, 10)  # the merge that would close the circle was undone
    assert {r["source_id"]: r["target_id"] for r in I.active(merges, undone).collect()} == {20: 30}


def test_rows_follow_merges_splits_and_merges(spark):
    moves = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 8, 10), (3, 9, 20), (9, 11, None)], "source_id int, target_id int, since int")
    rows = spark.createDataFrame([(1, 5), (2, 10), (3, 19), (1, 20), (4, 50), (None, 1)], "e int, at int")
    moved, audit = I.reassigned(rows, "e", "at", moves)
    assert sorted(moved.collect(), key=str) == sorted([(3, 5), (8, 10), (8, 19), (11, 20), (4, 50), (None, 1)], key=str)
    assert sorted(tuple(r) for r in audit.collect()) == [(1, 3, 1), (1, 11, 1), (2, 8, 1), (3, 8, 1)]


def test_as_few_as_can_be_move(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for key in ("a", "b", None, "d"):
        places = rng.sample(range(100), 60)
        stays = O.staying(places)
        best = [0] * len(places)
        for i, x in enumerate(places):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] < x), default=0)
        kept = [x for x, s in zip(places, stays, strict=True) if s]
        assert kept == sorted(kept) and len(kept) == max(best)
        rows += [(key, x, i) for i, x in enumerate(places)]
        want |= {(key, x): not s for x, s in zip(places, stays, strict=True)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = O.moves(spark.createDataFrame(rows, "k string, old int, new int").repartition(3), ["k"], "old", "new").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["k"], r["old"]): r["moved"] for r in got} == want and len(got) == len(rows)


def test_changes_give_what_a_rebuild_gives(spark):
    from storyloom.operators import history as H

    rng = random.Random(9)
    fact = lambda: (rng.choice([None, *range(12)]), rng.randrange(6), rng.choice("xyz"), rng.randrange(1000))
    derive = lambda rows: H.superseded(rows, ["k"], ["at", "id"], "v", "id", "at").select("k", "at", "v", "valid_to")
    kind = "k int, at int, v string, id int"
    now = [fact() for _ in range(60)]
    derived = derive(spark.createDataFrame(now, kind))
    for _ in range(2):
        gone, come = rng.sample(now, 4), [fact() for _ in range(3)]
        edits = spark.createDataFrame([(*x, -1) for x in gone] + [(*x, 1) for x in come], kind + ", _sign int")
        rows = spark.createDataFrame(now, kind)
        change = B.carried(rows, edits, ["k"], derive)
        touched = {x[0] for x in gone + come}
        assert {r["k"] for r in change.collect()} <= touched
        left = Counter(now)
        left.subtract(gone)
        now = list(left.elements()) + come
        derived = B.maintained(derived, change)
        assert Counter(map(tuple, derived.collect())) == Counter(map(tuple, derive(spark.createDataFrame(now, kind)).collect()))


def test_changes_that_cancel(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    edits = spark.createDataFrame([(1, -1), (3, 1), (3, -1), (4, 1)], "x int, _sign int")
    assert sorted(r["x"] for r in B.applied(rows, edits).collect()) == [1, 2, 4]
    assert B.changed(rows, rows).count() == 0


def test_chains_are_held_against_stored_parents(spark):
    chain = spark.createDataFrame([("c", 1, "a", None), ("c", 2, "b", "a"), ("c", 4, "d", "c"), ("e", 1, "x", "y")], "chain string, seq int, hash string, parent string")
    assert sorted((r["chain"], r["seq"], r["expected"]) for r in K.broken_chain(chain).collect()) == [("c", 4, "b"), ("e", 1, None)]
    assert K.broken_chain(chain.where(F.lit(False))).count() == 0
