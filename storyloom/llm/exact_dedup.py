"""Exact deduplication through an extendible-hash index on shared files.

Every text is normalised (A-Z lower-cased, nothing else) and gets a 64-bit key. The index is a set of buckets,
each one file in the shared folder, reached through a directory over the leading bits of the key. The directory
starts with one entry; as long as a bucket holds more than ``bucket_bytes`` and its keys still differ within
``MAX_DEPTH`` bits, it is split in two and the directory doubles. Owner tasks then read the bucket files in key
order. Entries with equal keys form a chain, in which the bytes of the normalised texts are compared: equal keys
of different texts stay apart.

Copies that meet in one batch are merged (by their bytes) before anything is shuffled, so a text of which there
are very many copies reaches its bucket as one entry a batch. A bucket's file is one row group, which one task reads;
a bucket that stays overfull at the deepest level, by the bytes of all its columns, is dealt out by whole keys instead.

Documents learn of their group by a join with the groups of two rows and more only, a table of its own, so that
Spark can split the partition of a text with very many copies.

Defined results: null text counts as empty text (and equals it); null ids are smaller than any id; of rows that
agree in text and id exactly one is kept; an empty table gives an empty result; columns other than the id and the
text are carried by ``survivors`` and ignored by ``membership``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import new_table_path, prepare, raw, remove_table, rows_of, settle, shuffle_width

#: Text bytes at which a bucket is split.
BUCKET_BYTES = 16 << 20
#: The directory doubles at most this often: 2**20 entries bound what is broadcast to 16 MB.
MAX_DEPTH = 20
#: A bucket beyond this many bytes, those of all its columns, is dealt out by key; others are one row group each.
FILE_BYTES = 64 << 20
ROW_GROUP = 128 << 20
#: Bytes of an entry beside those of the document's columns.
ENTRY_BYTES = 32


def normalise(text: bytes) -> bytes:
    """UTF-8 text with A-Z lower-cased; bytes.lower touches ASCII only."""
    return text.lower()


def key_of(normal: bytes) -> int:
    """The signed 64-bit index key of a normalised text."""
    k = xxhash.xxh64_intdigest(normal)
    return k - (1 << 64) if k >> 63 else k


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, others) -> (id, key, sha, n_bytes); others: the bytes of the other columns."""
    for b in rows_of(batches):
        normal = [normalise(t) for t in raw(b.column(1))]
        yield pa.record_batch(
            {
                "id": b.column(0),
                "key": pa.array(map(key_of, normal), pa.int64()),
                "sha": pa.array((hashlib.sha256(t).digest() for t in normal), pa.binary()),
                "n_bytes": pa.array((len(t) + n for t, n in zip(normal, b.column(2).to_pylist(), strict=True)), pa.int64()),
            }
        )


def bytes_of(field: T.StructField) -> Column:
    """How many bytes a column's value takes, about."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        size = F.octet_length(F.to_json(F.struct(c)))
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long")


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key and digest of every text, and the bytes of its row."""
    schema = "id long, key long, sha binary, n_bytes long"
    others = sum((bytes_of(f) for f in docs.schema.fields if f.name != text_col), F.lit(ENTRY_BYTES).cast("long"))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), others.alias("others")).mapInArrow(_sketch, schema)


def directory(keys: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int]:
    """(prefix, bucket, big): for each prefix of ``depth`` bits, the bucket that holds it; and the depth.

    Bucket numbers are those of a heap: the root is 1, and a split turns b into 2b and 2b + 1.
    """
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, total) / bucket_bytes)) + 3))
    prefix = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    by_prefix = keys.groupBy(prefix.alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"))
    # One row for each prefix and depth: the bucket that would hold it if all splits ended at that depth.
    heap = lambda d: F.shiftright(F.col("prefix"), depth - d) + (1 << d)
    levels = by_prefix.select("prefix", "n_bytes", F.posexplode(F.array(*[heap(d) for d in range(depth + 1)])).alias("level", "bucket"))
    held = levels.groupBy("bucket").agg(F.sum("n_bytes").alias("held"))
    fits = (F.col("held") <= bucket_bytes) | (F.col("level") == depth)
    first = F.min(F.struct("level", "bucket", "held"))
    leaf = levels.join(held, "bucket").where(fits).groupBy("prefix").agg(first.alias("leaf"))
    return leaf.select("prefix", F.col("leaf.bucket").alias("bucket"), (F.col("leaf.held") > FILE_BYTES).cast("int").alias("big")), depth


def _merge_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, payload) -> (key, n, id, text, payload): one row for each text of the batch, that of the largest id."""
    for b in rows_of(batches):
        ids, best, count = b.column(0).to_pylist(), {}, {}
        for i, t in enumerate(raw(b.column(1))):
            t = normalise(t)
            if t not in best:
                best[t], count[t] = i, 1
                continue
            count[t] += 1
            if ids[i] is not None and (ids[best[t]] is None or ids[i] > ids[best[t]]):
                best[t] = i
        kept = b.take(pa.array(best.values(), pa.int64()))
        keys, n = pa.array(map(key_of, best), pa.int64()), pa.array(count.values(), pa.int64())
        yield pa.record_batch([keys, n, *kept.columns], names=["key", "n", *kept.schema.names])


def build_index(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> tuple[str, DataFrame]:
    """Write the bucket files of docs, all columns carried in ``row``; return the folder and the table in it."""
    spark = docs.sparkSession
    entries, depth = directory(keys, bucket_bytes)
    entries = settle(entries, "directory")  # at most 2**MAX_DEPTH rows
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), *plain.schema.fields])
    merged = plain.mapInArrow(_merge_batch, schema)
    prefix = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    placed = merged.withColumn("prefix", prefix).join(F.broadcast(entries), "prefix").drop("prefix")
    path = new_table_path(spark, "index")
    width = max(shuffle_width(spark), 1)
    placed.repartition(width, "bucket").sortWithinPartitions("big", "bucket", "key").write.option("parquet.block.size", ROW_GROUP).partitionBy("big", "bucket").parquet(path)
    held = T.StructType([*schema.fields, T.StructField("big", T.IntegerType()), T.StructField("bucket", T.LongType())])
    return path, spark.read.schema(held).parquet(path)


def _owner(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    """Walk the chains of a bucket in key order; emit(columns of one batch's finished chains)."""
    key, chain = None, []  # chain: [normalised text, n, id, batch, row]
    done: list[list] = []
    for b in rows_of(batches):
        names = b.schema.names
        keys, ns, ids = (b.column(names.index(c)).to_pylist() for c in ("key", "n", "id"))
        for i, text in enumerate(raw(b.column(names.index("text")))):
            normal = normalise(text)
            if keys[i] != key:
                done += chain
                key, chain = keys[i], []
            for link in chain:
                if link[0] == normal:
                    link[1] += ns[i]
                    if ids[i] is not None and (link[2] is None or ids[i] > link[2]):
                        link[2:] = ids[i], b.slice(i, 1)
                    break
            else:
                chain.append([normal, ns[i], ids[i], b.slice(i, 1)])
        # What is kept of this batch must not keep the whole batch alive.
        if done:
            yield emit(done)
            done = []
        for link in chain:
            link[3] = link[3].take(pa.array([0]))
    if chain:
        yield emit(chain)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(links):
        return pa.record_batch(
            {
                "sha": pa.array((hashlib.sha256(x[0]).digest() for x in links), pa.binary()),
                "keep_id": pa.array((x[2] for x in links), pa.int64()),
                "n": pa.array((x[1] for x in links), pa.int64()),
            }
        )

    return _owner(batches, emit)


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(links):
        whole = pa.Table.from_batches([x[3] for x in links]).select(["text", "row"]).combine_chunks()
        return whole.to_batches()[0]

    return _owner(batches, emit)


def _owned(index: DataFrame, owner, schema) -> DataFrame:
    """Run owner over the bucket files: small buckets as they lie, overfull ones dealt out by key."""
    columns = ["key", "n", "id", "text", "row"]
    small = index.where("big = 0").select(*columns)
    big = index.where("big = 1").select(*columns).repartition("key").sortWithinPartitions("key")
    return small.mapInArrow(owner, schema).unionByName(big.mapInArrow(owner, schema))


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = settle(sketch(docs, "id", "text").withColumn("row", F.monotonically_increasing_id()), "keys")
    path, index = build_index(docs, keys, "id", "text", bucket_bytes)
    found = settle(_owned(index, _groups, "sha binary, keep_id long, n long"), "groups")
    remove_table(spark, path)
    # A chain of a bucket that was dealt out has one entry, one that several batches of a bucket hold as well.
    several = found.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")
    # Rows that agree in text and id: the first of them is kept. The join spreads a text's copies by their ids.
    same = (F.col("k.sha") == F.col("s.sha")) & F.col("k.id").eqNullSafe(F.col("s.keep_id"))
    first = keys.alias("k").join(several.alias("s"), same).groupBy("s.sha", "s.keep_id", "s.group_size").agg(F.min("k.row").alias("keep_row"))
    joined = keys.select("id", "sha", "row").join(settle(first, "first-rows"), "sha", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of equal texts the one with the largest id."""
    spark = docs.sparkSession
    prepare(spark)
    keys = settle(sketch(docs, id_col, text_col), "keys")
    _, index = build_index(docs, keys, id_col, text_col, bucket_bytes)
    row = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("row", row)])
    kept = _owned(index, _kept_rows, schema)
    return kept.select(*[F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
