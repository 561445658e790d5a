"""A generated library of novels, for benches and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.numerals import write_number

FAMILY, GIVEN = "赵钱孙李周吴郑王冯陈", "安平 若水 长庚 青禾 明舒 行远 知秋 子衿 云起 怀瑾".split()


def _name(book):
    family = F.array(*[F.lit(c) for c in FAMILY])
    given = F.array(*[F.lit(g) for g in GIVEN])
    return lambda a, b: F.concat(family[((F.col(book) + a) % 10).cast("int")], given[((F.col(book) + b) % 10).cast("int")])


def novels(spark: SparkSession, books: int, chapters: int) -> DataFrame:
    """One row per chapter: book, chapter, heading, text; two speakers a book, built by the executors."""
    numbers = F.array(*[F.lit(write_number(n)) for n in range(chapters + 1)])
    grid = spark.range(books).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(chapters))).alias("chapter"))
    name = _name("b")
    a, b = name(0, 0), name(3, 7)
    lines = [
        F.concat(a, F.lit("推开院门，雪落了一地，檐下的灯还亮着。")),
        F.concat(F.lit("“信送到了吗？”"), a, F.lit("问。")),
        F.concat(b, F.lit("没有抬头，过了一会儿才说道：“送到了，可是没有人收。”")),
        F.concat(F.lit("“那就再送一次。”"), a, F.lit("说。")),
        F.concat(F.lit("远处传来更鼓，"), b, F.lit("放下笔，朝窗外望去。")),
    ]
    heading = F.concat(F.lit("第"), numbers[F.col("chapter")], F.lit("章 第"), F.col("chapter").cast("string"), F.lit("夜"))
    return grid.select(F.format_string("novel%05d", "b").alias("book"), "chapter", heading.alias("heading"), F.concat_ws("\n", *lines).alias("text"))


def as_files(chapters: DataFrame) -> DataFrame:
    """path, text: each book as one plain-text file's content, headings and indented paragraphs."""
    body = F.concat("heading", F.lit("\n\n　　"), F.replace("text", F.lit("\n"), F.lit("\n　　")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", body.alias("body")))), lambda x: x["body"]), "\n\n")
    return chapters.groupBy(F.concat("book", F.lit(".txt")).alias("path")).agg(whole.alias("text"))
