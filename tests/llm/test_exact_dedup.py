import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import exact_dedup
from storyloom.llm.queries import op9_exact_dedup

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}


def plain(rows):
    """(id, keep_id, group_size, sha) of every (id, text), and how many rows stay in each group."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    low = [((t or "").translate(UPPER), i) for i, t in rows]
    return sorted((str(i), str(best[k]), len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for k, i in low), len(groups)


def checked(found, rows):
    got = found.collect()
    want, groups = plain(rows)
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["id"] == r["keep_id"] for r in kept)


def table(n, seed):
    rng = random.Random(seed)
    texts = ["", None, "hot text " * 20, "HOT text " * 20, "İ", "i̇", "É", "é", "x" * 50_000, *(f"text {k} " * rng.randrange(1, 40) for k in range(n // 2))]
    rows = [(rng.choice([None, *range(n)]), rng.choice(texts[:4] if rng.random() < 0.3 else texts)) for _ in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("bucket_bytes", [exact_dedup.BUCKET_BYTES, 4000, 1])
def test_membership_and_survivors_against_plain_groups(spark, docs_of, bucket_bytes):
    rows = table(400, bucket_bytes)
    docs = docs_of(rows)
    checked(exact_dedup.membership(docs.repartition(7), bucket_bytes=bucket_bytes), rows)
    kept = exact_dedup.survivors(docs.repartition(7), bucket_bytes=bucket_bytes).collect()
    low = lambda t: (t or "").translate(UPPER)
    best = {}
    for i, t in rows:
        best[low(t)] = max(best.get(low(t), -1), -1 if i is None else i)
    assert sorted((low(r["text"]), -1 if r["doc_id"] is None else r["doc_id"]) for r in kept) == sorted(best.items())
    assert {(r["doc_id"], low(r["text"])) for r in kept} <= {(i, low(t)) for i, t in rows}


def test_overfull_buckets_are_dealt_out_by_key(spark, docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILE_BYTES", 100)
    monkeypatch.setattr(exact_dedup, "MAX_DEPTH", 1)
    rows = table(300, 5)
    checked(exact_dedup.membership(docs_of(rows).repartition(5), bucket_bytes=1000), rows)
    assert exact_dedup.survivors(docs_of(rows).repartition(5), bucket_bytes=1000).count() == plain(rows)[1]


def test_copies_with_wide_columns_in_files_of_several_row_groups(spark, docs_of):
    """600 equal texts with 100 KB beside each: one stays, whatever rows a file's groups hold."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
        hadoop.set("parquet.block.size", str(1 << 20))
        wide = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(3200)), lambda k: F.md5(F.concat_ws(":", "doc_id", k))))
        docs = docs_of([(i, "the same text") for i in range(600)]).repartition(30).withColumn("wide", wide)
        for most in (exact_dedup.FILE_BYTES, 1 << 20):
            exact_dedup.FILE_BYTES, old = most, exact_dedup.FILE_BYTES
            kept = exact_dedup.survivors(docs).select("doc_id", F.length("wide").alias("n")).collect()
            exact_dedup.FILE_BYTES = old
            assert [tuple(r) for r in kept] == [(599, 102_400)]
    finally:
        hadoop.unset("parquet.block.size")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_keys_of_different_texts_stay_apart():
    """A chain of one key: texts are told apart by their bytes, across batches."""
    rows = [(7, 1, i, t) for i, t in enumerate(["a", "B", "b", "a", "c", "A"])] + [(8, 2, 9, "a")]
    kind = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows[i : i + 2]], schema=kind) for i in range(0, len(rows), 2)]
    got = [tuple(r.values()) for b in exact_dedup._groups(iter(batches)) for r in b.to_pylist()]
    of = lambda t, keep, n: (hashlib.sha256(t.encode()).digest(), keep, n)
    assert sorted(got) == sorted([of("a", 5, 3), of("b", 2, 2), of("c", 4, 1), of("a", 9, 2)])


def test_buckets_split_until_they_fit(spark):
    keys = spark.createDataFrame([(k << 56, 10) for k in range(-128, 128)], "key long, n_bytes long")
    entries, depth = exact_dedup.directory(keys, 100)
    rows = entries.collect()
    held = defaultdict(int)
    for r in rows:
        held[r["bucket"]] += 10 * 2 ** (8 - depth) if depth <= 8 else 10
    assert len(rows) == 2 ** min(depth, 8) and max(held.values()) <= 100 and sum(held.values()) == 2560


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    checked(op9_exact_dedup(spark, SF).withColumnRenamed("doc_id", "id"), rows)


def test_edges(spark, docs_of):
    assert exact_dedup.membership(docs_of([])).count() == exact_dedup.survivors(docs_of([])).count() == 0
    rows = [(None, "x"), (None, "x"), (3, "X"), (3, "x"), (None, None), (None, "")]
    clash = docs_of(rows).selectExpr("*", "1 as key", "'z' as bucket", "2 as big", "3 as n", "4 as row", "5 as sha", "6 as n_bytes", "7 as prefix")
    checked(exact_dedup.membership(clash), rows)
    kept = exact_dedup.survivors(clash)
    assert kept.columns == clash.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "None"]
