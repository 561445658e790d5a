"""Sessions and the tables of a folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(app: str = "storyloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; on a cluster, the master and memory come from outside."""
    n = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    made = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        made = made.master(f"local[{n}]").config("spark.driver.memory", "8g")
    for k, v in (settings | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        made = made.config(k, v)
    return made.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
