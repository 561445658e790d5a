"""Jobs over books: a queue whose log is a table, so any process can add, take, cancel and watch.

Nothing but the log is kept. A job's state follows from its events (operators.views.queue_states), a worker takes the
first that waits under the queue's lease, and one that was lost while running is queued again and goes on behind the
last chapter it told of.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators import views as W
from storyloom.sources.store import Conflict, Lease, TableStore
from storyloom.streaming.runs import resume_at

LOG = "queue string, job string, seq long, at timestamp, event string, book_id string, chapter int, note string"
ENDS = ("succeeded", "failed", "cancelled")
#: Finished jobs that stay in the list.
KEEP = 50


class Cancelled(RuntimeError):
    """The job was cancelled while it ran."""


class JobQueue:
    """A first-in, first-out queue of jobs on books."""

    def __init__(self, store: TableStore, name: str = "parse", worker: str | None = None):
        self.store, self.name, self.worker = store, name, worker or f"worker-{uuid.uuid4().hex}"

    def _log(self) -> DataFrame:
        return self.store.read("jobs", LOG).where(F.col("queue") == self.name)

    def _put(self, job: str, event: str, book_id: str | None = None, chapter: int | None = None, note: str | None = None) -> None:
        row = self.store.spark.createDataFrame([(self.name, job, time.time_ns(), event, book_id, chapter, note)], "queue string, job string, seq long, event string, book_id string, chapter int, note string")
        at = F.timestamp_micros(F.floor(F.col("seq") / 1000))
        self.store.append("jobs", row.withColumn("at", at).select([c.split()[0] for c in LOG.split(", ")]))

    def enqueue(self, book_id: str) -> str:
        job = f"job_{uuid.uuid4().hex}"
        self._put(job, "enqueued", book_id)
        return job

    def states(self) -> DataFrame:
        """job, status, progress, place, book_id, next_chapter, last event's time, newest job first."""
        log = self._log()
        more = log.groupBy("job").agg(F.max("book_id").alias("book_id"), F.min("seq").alias("born"), F.max("at").alias("last"), F.max_by("note", "seq").alias("note"))
        goes_on = resume_at(log, "job", "chapter", 0)
        return W.queue_states(log).drop("queue").join(more, "job").join(goes_on, "job").orderBy(F.desc("born"))

    def get(self, job: str) -> dict | None:
        found = self.states().where(F.col("job") == job).first()
        return found.asDict() if found else None

    def is_busy(self) -> bool:
        return not self.states().where(F.col("status").isin("waiting", "running")).isEmpty()

    def cancel(self, job: str) -> bool:
        """Whether there was something to cancel; a running job stops before its next wave."""
        now = self.get(job)
        if now is None or now["status"] in ENDS:
            return False
        self._put(job, "cancelled")
        return True

    def take(self) -> dict | None:
        """The first job that waits, now ours; None if there is none, or another worker is just taking one."""
        lease = Lease(self.store, f"queue-{self.name}", self.worker)
        if not lease.acquire():
            return None
        try:
            found = self.states().where("status = 'waiting'").orderBy("place").first()
            if found is None:
                return None
            self._put(found["job"], "started", note=self.worker)
            return found.asDict()
        finally:
            lease.release()

    def sweep(self, stale_s: float = 60.0) -> int:
        """Queue again what has run without a sign of life for so long (0: all that runs); how many."""
        cutoff = F.current_timestamp() - F.make_interval(secs=F.lit(stale_s))
        dead = [r["job"] for r in self.states().where((F.col("status") == "running") & (F.col("last") <= cutoff)).select("job").collect()]
        for job in dead:
            self._put(job, "enqueued")
        return len(dead)

    def run_next(self, work: Callable[[str, int, Callable[[int], None]], object]) -> str | None:
        """Take a job and do work(book_id, first index, told); the job's status afterwards, None if nothing waited.

        told(index) records how far the work is and raises Cancelled if nobody wants it any more. A book that somebody
        else holds sends the job to the end of the queue.
        """
        job = self.take()
        if job is None:
            return None

        def told(index: int) -> None:
            if self.get(job["job"])["status"] == "cancelled":
                raise Cancelled(job["job"])
            self._put(job["job"], "progress", chapter=index)

        try:
            work(job["book_id"], job["next_chapter"], told)
        except Cancelled:
            return "cancelled"
        except Conflict:
            self._put(job["job"], "enqueued")
            return "waiting"
        except Exception as e:
            self._put(job["job"], "failed", note=str(e)[:500])
            return "failed"
        self._put(job["job"], "succeeded")
        return "succeeded"

    def prune(self, keep: int = KEEP) -> int:
        """Forget finished jobs but the newest ones; how many went."""
        ended = self.states().where(F.col("status").isin(*ENDS)).select("job", "born")
        old = ended.join(ended.orderBy(F.desc("born")).limit(keep).select("job"), "job", "left_anti").select("job").collect()
        if old:
            self.store.delete("jobs", self.store.spark.createDataFrame(old, "job string"), ["job"])
        return len(old)



def work_off(store: TableStore, work: Callable[[str, int, Callable[[int], None]], object], name: str = "parse", parallel: int = 1, busy_s: float = 30.0) -> dict[str, int]:
    """All jobs of a queue, so many at a time, each worker with a name of its own; how each ended. A job whose book
    somebody else holds is tried again after busy_s."""

    def one(_: int) -> Counter:
        queue, ended = JobQueue(store, name), Counter()
        while True:
            status = queue.run_next(work)
            if status == "waiting":
                time.sleep(busy_s)
            elif status is not None:
                ended[status] += 1
            elif queue.states().where("status = 'waiting'").isEmpty():
                return ended
            else:  # another worker was just taking one
                time.sleep(0.05)

    with ThreadPoolExecutor(parallel) as pool:
        return dict(sum(pool.map(one, range(parallel)), Counter()))
