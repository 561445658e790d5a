import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from storyloom import plans
from storyloom.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_against_its_sql(spark, views, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = views.execute(plans.SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    assert got == sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall())


def test_plans_are_those_intended(spark):
    explained = lambda name: plans.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in explained("recent_mentions_top3")
    assert "NestedLoop" not in explained("segment_containing_offset") and "Cartesian" not in explained("evidence_unique_locate")
    assert "TakeOrderedAndProject" in explained("vector_topk") and "TakeOrderedAndProject" in explained("ordered_listing")
    assert "EqualTo(n_nationkey,7)" in explained("edition_with_book").split("== Physical Plan ==")[1]
    read = plans.QUERIES["report_buckets_30"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in read
    assert "Exchange" not in plans.QUERIES["paragraph_offsets"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_same_result_twice(spark):
    for name in ("chapter_reconcile", "mentions_longest_match", "structure_parse"):
        a, b = plans.QUERIES[name](spark, SF), plans.QUERIES[name](spark, SF)
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
