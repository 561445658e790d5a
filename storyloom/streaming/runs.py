"""The run log as a stream: live totals, latest state, resumable per-chapter decisions, incremental indexing.

Event-time bounds and windows here are an extension: the run log arrives late in practice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyloom.operators import history as H

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def run_log(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, though writers repeat them; state is dropped when the watermark passes."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def totals(log: DataFrame) -> DataFrame:
    """Counts by status, kept up to date."""
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def usage_windows(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Usage by window of event time; a window is given out when no more of it can come."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


DECISIONS = "user_id long, attempts long, failed long, done boolean, running boolean, decision string"
STATE = "attempts long, failed long, done boolean, running boolean, last double"
MOST_FAILED = 3


def _decide(attempts: int, failed: int, done: bool, running: bool, dead: bool) -> str:
    if running:
        return "interrupt_and_run" if dead else "skip_running"
    if done:
        return "skip_done"
    return "skip_failed" if failed >= MOST_FAILED else "run"


def decisions(log: DataFrame, stale_ms: int | None = 60_000) -> DataFrame:
    """A row per chapter whenever its runs change, or when its running one has shown no sign of life for stale_ms.

    A stream that waits for time never ends by itself; with None it only follows the log and can be drained.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, failed, done, running, last = state.get if state.exists else (0, 0, False, False, 0.0)
        dead = state.hasTimedOut and running
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for kind, at in zip(rows["event_type"], rows["ts"], strict=True):
                attempts += 1
                failed += kind == "error"
                done = done or kind == "purchase"
                running, last = kind == "click", at.timestamp()
        state.update((int(attempts), int(failed), bool(done), bool(running and not dead), float(last)))
        if running and not dead and stale_ms is not None:
            state.setTimeoutDuration(stale_ms)
        told = _decide(attempts, failed, done, running, dead)
        yield pd.DataFrame({"user_id": [key[0]], "attempts": [attempts], "failed": [failed], "done": [done], "running": [running and not dead], "decision": [told]})

    keyed = log.select("user_id", "event_id", "ts", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(step, DECISIONS, STATE, "update", GroupStateTimeout.NoTimeout if stale_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


LADDER = "user_id long, at timestamp, attempts long, failed long, done boolean, running boolean, decision string"
#: What the state store must be for timers: set it before the stream starts.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class RunLadder(StatefulProcessor):
    """A chapter's runs in the order of event time, whatever order they come in.

    Events wait in a list until the watermark has passed them, and are then taken in order, so a replay gives what the
    batch gives. A running chapter has a timer at its last sign of life and stale_ms; if it fires first, the run is
    dead. A chapter that has been silent for keep_ms is forgotten: its state is dropped."""

    def __init__(self, stale_ms: int, keep_ms: int):
        self.stale_ms, self.keep_ms = stale_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "attempts long, failed long, done boolean, running boolean, dead boolean, last long")
        self.waiting = handle.getListState("waiting", "at long, seq long, kind string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at.value // 1_000_000), int(seq), kind) for b in rows for at, seq, kind in zip(b["ts"], b["event_id"], b["event_type"], strict=True)]
        self.waiting.appendList(new)
        for at in {x[0] for x in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        attempts, failed, done, running, dead, last = self.runs.get() if self.runs.exists() else (0, 0, False, False, False, 0)
        held = sorted(tuple(x) for x in self.waiting.get())
        due = [x for x in held if x[0] <= now]
        for at, _, kind in due:
            attempts, failed, done = attempts + 1, failed + (kind == "error"), done or kind == "purchase"
            running, dead, last = kind == "click", False, at
        if due:
            self.waiting.put(held[len(due) :]) if len(due) < len(held) else self.waiting.clear()
        elif running and not dead and now >= last + self.stale_ms:
            dead = True
        elif len(held) == 0 and now >= last + self.keep_ms:
            self.runs.clear()
            self.waiting.clear()
            return iter(())
        else:
            return iter(())
        self.runs.update((attempts, failed, done, running, dead, last))
        self.handle.registerTimer(last + (self.stale_ms if running and not dead else self.keep_ms))
        told = _decide(attempts, failed, done, running, dead)
        row = {"user_id": [key[0]], "at": [pd.Timestamp(now, unit="ms")], "attempts": [attempts], "failed": [failed], "done": [done], "running": [running and not dead], "decision": [told]}
        return iter([pd.DataFrame(row)])

    def close(self) -> None:
        pass


def ladder(log: DataFrame, stale_ms: int = 60_000, keep_ms: int = 30 * 86_400_000, late: str = "10 minutes") -> DataFrame:
    """A row per chapter whenever event time brings it something: its runs, or the silence of a running one.

    at is the event time that brought it. Needs the RocksDB state store (ROCKS)."""
    keyed = log.select("user_id", "event_id", "ts", "event_type").withWatermark("ts", late).groupBy("user_id")
    return keyed.transformWithStateInPandas(RunLadder(stale_ms, keep_ms), LADDER, "Update", "EventTime")


def ladder_now(log: DataFrame, now: Column, stale_ms: int = 60_000) -> DataFrame:
    """The same from the whole log at a moment, by one aggregate: what the last row of each chapter says."""
    of = F.struct("ts", "event_id")
    known = log.where(F.col("ts") <= now).groupBy("user_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failed"), F.bool_or(F.col("event_type") == "purchase").alias("done"),
        F.max_by("event_type", of).alias("kind"), F.max("ts").alias("last"),
    )
    live = F.col("kind") == "click"
    dead = live & (F.unix_millis(now) >= F.unix_millis("last") + stale_ms)
    decision = H.run_decision(F.col("done"), F.col("failed"), live & ~dead, dead, MOST_FAILED)
    return known.select("user_id", "attempts", "failed", "done", (live & ~dead).alias("running"), decision.alias("decision"))


def drained(rows: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the stream, into a table beside the checkpoint: every batch is a folder of its own,
    written anew if the batch is made again. In complete mode the last batch is the table."""
    spark, out = rows.sparkSession, f"{checkpoint.rstrip('/')}-{name}"
    seen: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch-{number}")
        seen.append(number)

    rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    kept = seen[-1:] if mode == "complete" else sorted(set(seen))
    return spark.read.schema(rows.schema).parquet(*[f"{out}/batch-{n}" for n in kept]) if kept else spark.createDataFrame([], rows.schema)


def into_store(rows: DataFrame, checkpoint: str, put: Callable[[DataFrame], None], mode: str = "append"):
    """Every batch through put, which must be repeatable (an upsert by key): together that is exactly once."""
    return rows.writeStream.outputMode(mode).foreachBatch(lambda batch, _: put(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_index(scenes: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Scenes (scene_id, content_hash, ...) whose embedding by this model is missing or of another text."""
    current = stored.where(F.col("model") == model).select("scene_id", F.col("content_hash").alias("stored_hash"))
    joined = scenes.join(current, "scene_id", "left")
    return joined.where(~F.col("stored_hash").eqNullSafe(F.col("content_hash"))).drop("stored_hash")


RUN_STATES = {"started": "running", "heartbeat": "running", "succeeded": "succeeded", "failed": "failed", "interrupted": "interrupted", "skipped": "skipped"}


def run_states(events: DataFrame) -> DataFrame:
    """run_id, status, started_at, heartbeat_at, finished_at from an append-only log (run_id, seq, event, at).

    The first event that ends a run decides; heartbeats and later endings do not change it.
    """
    ends = F.col("event").isin("succeeded", "failed", "interrupted", "skipped")
    return events.groupBy("run_id").agg(
        F.coalesce(F.min_by(F.when(ends, F.col("event")), F.when(ends, F.col("seq"))), F.lit("running")).alias("status"),
        F.min(F.when(F.col("event") == "started", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("event") == "heartbeat", F.col("at"))).alias("heartbeat_at"),
        F.min_by(F.when(ends, F.col("at")), F.when(ends, F.col("seq"))).alias("finished_at"),
    )


def resume_at(events: DataFrame, job: str, chapter: str, start: int) -> DataFrame:
    """The chapter that a job goes on with: one after the last that has an event."""
    return events.groupBy(job).agg((F.coalesce(F.max(chapter), F.lit(start - 1)) + 1).alias("next_chapter"))
