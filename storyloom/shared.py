"""The folder that all machines share, and tables written there between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="storyloom-tables-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/storyloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: its plan ends there, and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """The place of each row in the order, from 0. Ranges are sorted where they lie; a range's first number is the sum of
    the counts before it, so no task holds all rows. They are written once: to deal them out again, for their counts, may
    give other ranges."""
    dealt = written(rows.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_at": F.monotonically_increasing_id(), "_range": F.spark_partition_id()}), "numbered")
    ranges = dealt.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    shift = ranges.select("_range", (before - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(shift), "_range").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


#: Rows and bytes that a Python worker turns into objects at once.
ROWS, BYTES = 1000, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ROWS rows and about BYTES bytes at most, none of them empty."""
    for b in batches:
        step = max(1, min(ROWS, BYTES * b.num_rows // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    pa.default_memory_pool().release_unused()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
