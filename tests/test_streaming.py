import uuid

import pytest

from storyloom.operators import history as H
from storyloom.streaming import runs as R

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def rows(spark, *events):
    """(id, second, chapter, type)"""
    data = [(i, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", u, k, 1.0, "{}") for i, s, u, k in events]
    return spark.createDataFrame(data, EVENTS.replace("ts timestamp", "ts string")).selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props")


def name():
    return f"t_{uuid.uuid4().hex}"


def test_totals_equal_the_batch(spark, tmp_path):
    log = rows(spark, (1, 0, 1, "click"), (2, 5, 1, "error"), (3, 9, 2, "purchase"), (4, 9, 2, "click"))
    log.repartition(3).write.parquet(f"{tmp_path}/log")
    got = R.drained(R.totals(R.run_log(spark, f"{tmp_path}/log")), name(), "complete", f"{tmp_path}/c")
    assert got.exceptAll(R.totals(log)).count() == 0 == R.totals(log).exceptAll(got).count()


def test_duplicates_and_late_rows(spark, tmp_path):
    rows(spark, (1, 0, 1, "click"), (1, 0, 1, "click"), (2, 30, 1, "error")).coalesce(1).write.parquet(f"{tmp_path}/log")
    log = R.run_log(spark, f"{tmp_path}/log")
    assert R.drained(R.deduplicated(log), name(), "append", f"{tmp_path}/c").count() == 2
    windows = R.drained(R.usage_windows(log, "10 seconds", "1 second"), name(), "append", f"{tmp_path}/d").collect()
    assert [(r["event_type"], r["n"]) for r in windows] == [("click", 2)]


def test_decisions_resume_from_their_state(spark, tmp_path):
    def drain():
        got = {}
        put = lambda batch: got.update({r["user_id"]: (r["attempts"], r["decision"]) for r in batch.collect()})
        R.into_store(R.decisions(R.run_log(spark, f"{tmp_path}/log"), None), f"{tmp_path}/c", put, "update").awaitTermination()
        return got

    rows(spark, (1, 0, 1, "error"), (2, 1, 1, "error"), (3, 0, 2, "purchase"), (4, 0, 3, "click")).coalesce(1).write.parquet(f"{tmp_path}/log")
    assert drain() == {1: (2, "run"), 2: (1, "skip_done"), 3: (1, "skip_running")}
    rows(spark, (5, 9, 1, "error"), (6, 9, 2, "view")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    second = drain()
    assert second[1] == (3, "skip_failed") and second[2] == (2, "skip_done")


def test_batches_go_into_a_store(spark, tmp_path):
    seen = []
    rows(spark, (1, 0, 1, "click"), (2, 0, 1, "click")).write.parquet(f"{tmp_path}/log")
    R.into_store(R.run_log(spark, f"{tmp_path}/log"), f"{tmp_path}/c", lambda b: seen.extend(r["event_id"] for r in b.collect())).awaitTermination()
    assert sorted(seen) == [1, 2]


def test_run_states_and_resumption(spark):
    log = spark.createDataFrame([("a", 1, "started", 10), ("a", 2, "heartbeat", 20), ("a", 3, "succeeded", 30), ("a", 4, "interrupted", 40), ("b", 1, "started", 5), ("b", 2, "heartbeat", 7)], "run_id string, seq int, event string, at int")
    got = {r["run_id"]: (r["status"], r["started_at"], r["heartbeat_at"], r["finished_at"]) for r in R.run_states(log).collect()}
    assert got == {"a": ("succeeded", 10, 20, 30), "b": ("running", 5, 7, None)}
    events = spark.createDataFrame([("j", 3), ("j", 4), ("k", None)], "job string, chapter int")
    assert {r["job"]: r["next_chapter"] for r in R.resume_at(events, "job", "chapter", 1).collect()} == {"j": 5, "k": 1}


def test_only_changed_scenes_are_indexed(spark):
    scenes = spark.createDataFrame([("s1", "h1"), ("s2", "h2"), ("s3", "h3")], "scene_id string, content_hash string")
    stored = spark.createDataFrame([("s1", "h1", "m"), ("s2", "old", "m"), ("s3", "h3", "other")], "scene_id string, content_hash string, model string")
    assert sorted(r["scene_id"] for r in R.to_index(scenes, stored, "m").collect()) == ["s2", "s3"]


@pytest.mark.parametrize("flags,want", [((False, 0, False, False), "run"), ((True, 0, False, False), "skip_done"), ((False, 3, False, False), "skip_failed"), ((True, 0, True, False), "skip_running"), ((True, 9, False, True), "interrupt_and_run")])
def test_decision_ladder(spark, flags, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(H.run_decision(*map(F.lit, flags))).first()[0] == want


def test_timers_of_event_time_give_what_the_batch_gives(spark, tmp_path):
    """Events in any order, over several batches; stale runs end by event time, and what is long silent is dropped."""
    import random

    from pyspark.sql import functions as F

    spark.conf.set(*R.ROCKS)
    try:
        rng = random.Random(4)
        events = [(i, rng.randrange(0, 900), rng.randrange(1, 6), rng.choice(["click", "click", "error", "view", "purchase"])) for i in range(80)] + [(80, 901, 1, "click"), (81, 901, 2, "click")]
        parts = [events[:30], events[30:60], events[60:], [(900, 3000, 99, "view")], [(901, 3001, 99, "view")]]
        told = []
        put = lambda batch: told.extend(batch.collect())
        for part in parts:
            rows(spark, *rng.sample(part, len(part))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
            stream = R.ladder(R.run_log(spark, f"{tmp_path}/log"), 60_000, 86_400_000, "20 minutes")
            R.into_store(stream, f"{tmp_path}/c", put, "update").awaitTermination()
        last = {}
        for r in sorted((r for r in told if r["user_id"] != 99), key=lambda r: r["at"]):
            last[r["user_id"]] = (r["attempts"], r["failed"], r["done"], r["running"], r["decision"])
        want = R.ladder_now(rows(spark, *events), F.expr("timestamp'2024-01-01 00:29:00'")).collect()
        assert last == {r["user_id"]: tuple(r)[1:] for r in want} and len(last) == 5
        assert any(r["decision"] == "interrupt_and_run" for r in told)

        before = len(told)  # silent for more than a day: forgotten, so a new event is a first attempt
        for part in ([(902, 200_000, 98, "view")], [(903, 200_001, 98, "view")], [(904, 200_002, 1, "error"), (905, 203_000, 98, "view")], [(906, 203_001, 98, "view")]):
            data = [(i, 1704067200 + s, u, k, 1.0, "{}") for i, s, u, k in part]
            made = spark.createDataFrame(data, EVENTS.replace("ts timestamp", "ts long")).selectExpr("event_id", "timestamp_seconds(ts) ts", "user_id", "event_type", "value", "props")
            made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
            R.into_store(R.ladder(R.run_log(spark, f"{tmp_path}/log"), 60_000, 86_400_000, "20 minutes"), f"{tmp_path}/c", put, "update").awaitTermination()
        assert [(r["attempts"], r["failed"]) for r in told[before:] if r["user_id"] == 1] == [(1, 1)]
    finally:
        spark.conf.unset(R.ROCKS[0])
