"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as (spark, docs, sf_dir), and returns a DataFrame: the documents that
stay, with the columns of documents, or for the last stage the pieces of packed windows. Stages carry whole rows,
so nothing is looked up again by id, and rows with null or repeated ids go through like any others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import exact_dedup, language, mixing, packing, simhash
from storyloom.llm.common import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: texts for which none can be named, as they have no letter, go; where lang is not
    known, it is what was found."""
    prototypes = language.learn(docs.select("lang", "text"))
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found, names = language.identified(docs, prototypes)
    of = {c: F.col(f"c{names.index(c)}") for c in COLUMNS}
    of["lang"] = F.coalesce(of["lang"], "lang_pred")
    return found.where("lang_pred <> 'und'").select(*[of[c].alias(c) for c in COLUMNS])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the document with the largest id."""
    return exact_dedup.survivors(docs).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id."""
    return simhash.similar_survivors(docs, shingle=5, similarity=0.8).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that meets its source's target is cut to its words there."""
    drawn = mixing.mixed(docs)
    text = F.col("_row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(mixing.WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    whole = F.col("words") >= F.col("_size")
    taken = drawn.select(*[F.col(f"_row.{c}").alias(c) for c in COLUMNS if c not in ("text", "n_chars")], F.when(whole, text).otherwise(cut).alias("text"), F.when(whole, F.col("_row.n_chars")).alias("n_chars"))
    return taken.withColumn("n_chars", F.coalesce("n_chars", F.length("text").cast("long"))).select(COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of 2048 tokens, each with its document's language: the label, or what was found."""
    return packing.pack(docs, VOCABULARY, carry=("lang",))


#: Texts cannot be put through a tokenizer or a random projection in SQL: tests compare with plain versions.
ORACLE_SQL = None

STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
