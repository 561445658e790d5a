"""Gold labels in JSON lines; blank lines and lines that start with # are comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTRIBUTION = "chapter int, quote string, speaker string, aliases array<string>, occurrence int, note string"
SHADOW = "kind string, chapter int, quote string, occurrence int, claim string, expected string"


class InvalidGold(ValueError):
    """A label line that cannot be used."""


def _lines(lines: DataFrame, schema: str) -> DataFrame:
    raw = lines.where("trim(value) <> '' and not startswith(trim(value), '#')")
    read = raw.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("g"))
    return read.select("value", "g.*")


def _checked(rows: DataFrame, rule, schema: str) -> DataFrame:
    bad = rows.where(F.col("_bad").isNotNull() | ~F.coalesce(rule, F.lit(False))).select("value").limit(5).collect()
    if bad:
        raise InvalidGold("; ".join(r["value"][:80] for r in bad))
    if rows.isEmpty():
        raise InvalidGold("no labels")
    return rows.drop("_bad", "value")


def attribution_labels(lines: DataFrame) -> DataFrame:
    """Lines (value) of speaker labels."""
    rows = _lines(lines, ATTRIBUTION)
    fine = (F.col("chapter") > 0) & (F.trim("quote") != "") & (F.trim("speaker") != "") & (F.col("occurrence").isNull() | (F.col("occurrence") > 0))
    return _checked(rows, fine, ATTRIBUTION).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def attribution_gold(spark: SparkSession, path: str) -> DataFrame:
    return attribution_labels(spark.read.text(path))


def shadow_labels(lines: DataFrame) -> DataFrame:
    """Lines (value) of labels for a second judge: quotes, and evidence with the claim it is for."""
    rows = _lines(lines, SHADOW)
    fine = F.col("kind").isin("quote", "evidence") & (F.col("chapter") > 0) & (F.trim("quote") != "") & F.col("expected").isNotNull() & ((F.col("kind") != "evidence") | F.col("claim").isNotNull())
    return _checked(rows, fine, SHADOW)


def shadow_gold(spark: SparkSession, path: str) -> DataFrame:
    return shadow_labels(spark.read.text(path))


def located(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gold rows with the candidate (chapter, index, inner, char_start, char_end) they mean: the nth that contains the
    quote; status is found, missing, ambiguous or out_of_range."""
    from pyspark.sql import Window

    keyed = gold.withColumn("_g", F.monotonically_increasing_id())
    hits = keyed.select("_g", "chapter", "quote", F.col("occurrence").alias("_o")).join(candidates, "chapter").where(F.col("inner").contains(F.col("quote")))
    line = Window.partitionBy("_g")
    ranked = hits.withColumns({"_n": F.row_number().over(line.orderBy("index")), "_all": F.count("*").over(line)})
    picked = ranked.where(F.col("_n") == F.coalesce("_o", F.lit(1))).select("_g", "_all", "index", "char_start", "char_end")
    many = ranked.groupBy("_g").agg(F.max("_all").alias("_count"))
    joined = keyed.join(many, "_g", "left").join(picked.drop("_all"), "_g", "left")
    status = F.when(F.col("_count").isNull(), "missing").when(F.col("occurrence").isNull() & (F.col("_count") > 1), "ambiguous").when(F.col("index").isNull(), "out_of_range").otherwise("found")
    return joined.withColumn("status", status).drop("_g", "_count")
