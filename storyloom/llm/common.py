"""What the operators of this package share: folders, settled tables, word rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most bytes and rows that one Arrow batch hands to a Python worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000

_own: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that a worker's memory does not follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="storyloom-")
    return _own[key]


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/storyloom/{name}-{uuid.uuid4().hex}"


#: How tables of large rows are written: a reader takes thousands of rows of a row group at once, and a writer looks at
#: sizes every hundred rows, unless told otherwise. So the memory that both take would follow the size of a file.
LARGE_ROWS = {"parquet.block.size": 4 << 20, "parquet.page.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def settle(df: DataFrame, name: str = "table", large: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors cost no recomputation.
    large: rows are up to some megabytes each."""
    spark, path = df.sparkSession, new_table_path(df.sparkSession, name)
    df.write.options(**(LARGE_ROWS if large else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _settled[id(out)] = path
    return out


_settled: dict[int, str] = {}


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; give the very frames that settle returned."""
    for df in tables:
        remove_table(df.sparkSession, _settled.pop(id(df)))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the place (from 0) of each row among those of its group (columns without nulls) in that order.

    Rows are dealt out by ranges of group and order and numbered where they lie; a range's first number is the sum of
    the counts of the group's ranges before it, so no task holds more than its range, however large the group. Equal
    rows are dealt out by where they lie in df, which should be a settled table.
    """
    width = shuffle_width(df.sparkSession)
    keys = [*group, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    held = settle(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "numbered")
    ranges = held.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = settle(ranges.select(*group, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "ranges")
    return held.join(starts, [*group, "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def trim() -> None:
    """Give freed memory back to the machine: a worker stays for the next stages, and so would what it once took."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    trim()
    for b in batches:
        if b.num_rows:
            yield b
    trim()
