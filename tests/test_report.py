import pytest
from pyspark.sql import functions as F

from storyloom import plans
from storyloom.operators import report as P


@pytest.fixture
def many_slices(spark):
    told = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64kb", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_are_numbered_however_their_ranges_are_dealt(spark, many_slices):
    rows = spark.range(0, 20_000, numPartitions=8).select((F.col("id") * 3).alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text"))
    found = P.numbered(rows, "id")
    assert found.agg(F.sum(F.length("text"))).first()[0] == 256 * 20_000
    assert found.where("id <> 3 * rn or n <> 20000 or length(text) <> 256").isEmpty()


def test_a_stratum_without_a_name_is_sampled(spark, tmp_path):
    spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["source"], r["doc_id"]) for r in plans.QUERIES["gold_sample"](spark, str(tmp_path)).collect()}
    assert got == {(s, 2 * k + (s is None)) for s in ("a", None) for k in (2, 6, 10, 14, 18)}
