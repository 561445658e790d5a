"""Passes in Python take many small texts, chapters and claims at once, and hold few objects of large tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.operators import attribution, passes, quotes
from storyloom.shared import ROWS
from storyloom.sources import adapters, chapters, lines

MANY = 5 * ROWS // 2


def batch(**columns):
    return iter([pa.record_batch(columns)])


def test_chapters_of_many_texts_come_together():
    out = list(chapters._split_texts(batch(path=[str(i) for i in range(MANY)], text=["第一章 渡口\n　　雪。\n"] * MANY)))
    assert [b.num_rows for b in out] == [ROWS, ROWS, ROWS // 2]
    assert out[0].to_pylist()[0] | {"content_hash": ""} == {"path": "0", "index": 0, "kind": "chapter", "number": 1, "title": "渡口", "heading_raw": "第一章 渡口", "volume_index": None, "volume_title": None, "text": "雪。", "content_hash": "", "warnings": "[]"}


def test_quotes_of_many_texts_come_in_pieces():
    out = list(quotes._quotes(batch(key=list(range(MANY)), text=['"a" "b"', None] * (MANY // 2))))
    assert [b.num_rows for b in out] == [ROWS, ROWS, ROWS // 2]
    assert out[0].slice(0, 2).to_pylist() == [{"key": 0, "index": i, "paragraph": 0, "char_start": 4 * i, "char_end": 4 * i + 3, "quote": f'"{x}"', "inner": x} for i, x in enumerate("ab")]


def test_files_are_decoded_in_pieces():
    out = list(lines._decoded(batch(path=["p"] * MANY, content=["é".encode("utf-16")] * MANY)))
    assert [b.num_rows for b in out] == [ROWS, ROWS, ROWS // 2]
    assert out[0].to_pylist()[0] == {"path": "p", "text": "é", "encoding": "utf-16le", "replaced": 0}
    long = list(lines._decoded(batch(path=["p"] * 40, content=[b"x" * (1 << 20)] * 40)))
    assert max(b.num_rows for b in long) <= 4 and sum(b.num_rows for b in long) == 40


def told(made):
    return made._jdf.queryExecution().executedPlan().toString()


def test_books_share_tasks_and_batches(spark):
    rows = spark.createDataFrame([(b, c, "沈舟说道：“天黑了。”沈舟走了。") for b in ("x", "y", None) for c in (2, 1)], "book string, chapter int, text string")
    made = attribution.parse_books(rows)
    assert "FlatMapGroups" not in told(made)
    got = {(r["book"], r["chapter"]): '"is_new": true' in r["entities"] for r in made.collect()}
    assert got == {(b, c): c == 1 for b in ("x", "y", None) for c in (1, 2)}


def test_claims_share_batches(spark):
    class Judge:
        def choose(self, question, choices):
            if "down" in question:
                raise RuntimeError("down")
            return choices[0] if "yes" in question else "perhaps"

    rows = spark.range(40).select((F.col("id") % 2).alias("chapter_id"), F.floor(F.col("id") / 2).alias("seq"), F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("claim"), F.when(F.col("id") == 5, "down").otherwise("").alias("context"))
    made = passes.judged(rows, Judge(), "does it?", ["supports"])
    assert "FlatMapGroups" not in told(made)
    got = {(r["chapter_id"], r["seq"]): (r["choice"], r["error"]) for r in made.collect()}
    fails = lambda i: i % 2 == 1 and i // 2 < passes.JUDGED_AT_ONCE
    assert got == {(i % 2, i // 2): (None, "down") if fails(i) else ("supports" if i % 3 == 0 else "uncertain", None) for i in range(40)}


@pytest.mark.parametrize("files", [1, 3])
def test_chapters_of_one_file_are_dealt_out(spark, files):
    rows = spark.range(100).coalesce(files).select(F.col("id").cast("string").alias("chapter_id"), F.lit("“走。”").alias("text"))
    answer = '{"attributions": [{"id": "q0", "kind": "dialogue", "speaker": "沈舟", "confidence": 1}]}'
    made = passes.attributed(rows, passes.ChatAttributor(adapters.ScriptedModel(lambda system, user: answer)), [])
    assert made.select(F.spark_partition_id()).distinct().count() == 4
    assert {tuple(r) for r in made.collect()} == {(str(i), 0, 0, 4, "dialogue", "沈舟", 1.0, None, None) for i in range(100)}
