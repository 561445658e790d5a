"""What a reader is shown of books, chapters and entities: counts, states, filters, merged searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators import retrieval as R

#: Chapters that are no story, unless all kinds are asked for.
ASIDE = ("note", "front_matter")


def story(rows: DataFrame, kind: str, all_kinds: bool = False) -> DataFrame:
    """Rows of chapters that tell the story."""
    return rows if all_kinds else rows.where(~F.col(kind).isin(*ASIDE))


def counted(rows: DataFrame, counts: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """rows with counts beside them, 0 where there are none. counts: name -> (what is counted, its key to rows)."""
    for name, (of, own) in counts.items():
        per = of.groupBy(F.col(own).alias(f"_{name}")).agg(F.count("*").alias(name))
        rows = rows.join(per, F.col(key) == F.col(f"_{name}"), "left").drop(f"_{name}").fillna(0, [name])
    return rows


def mention_counts(mentions: DataFrame, chapter: str, entity: str) -> DataFrame:
    """How often each chapter mentions each entity."""
    return mentions.groupBy(chapter, entity).agg(F.count("*").alias("n"))


def named(columns: list[str], words: str) -> Column:
    """Whether a name or any alias holds the words, regardless of case."""
    return reduce(lambda a, b: a | b, [F.lower(c).contains(words.lower()) for c in columns])


def parse_status(done: Column, running: Column, failed: Column, interrupted: Column) -> Column:
    """A chapter's state from its runs: done wins, then a running one, then how the last one ended."""
    return F.when(done, "parsed").when(running, "running").when(failed, "failed").when(interrupted, "interrupted").otherwise("unparsed")


def needs_sync(content_hash: Column, synced_hash: Column) -> Column:
    """Whether what is stored elsewhere is missing or of another text."""
    return ~synced_hash.eqNullSafe(content_hash)


def unfinished(status: Column) -> Column:
    return status.isin("failed", "interrupted")


def search_editions(scenes: DataFrame, query: list[float], editions: list[int], edition: str, k: int, tie: list[str]) -> DataFrame:
    """The k best scenes of the asked editions, and a row with status skipped for each that has no usable vector."""
    asked = scenes.where(F.col(edition).isin(*editions))
    fit = asked.where(R.usable("embedding", len(query)))
    best = R.vector_top_k(fit, query, k, tie).withColumn("status", F.lit("found"))
    there = fit.select(edition).distinct()
    wanted = scenes.sparkSession.createDataFrame([(e,) for e in editions], scenes.select(edition).schema)
    skipped = wanted.join(there, edition, "left_anti").withColumn("status", F.lit("skipped"))
    return best.unionByName(skipped, allowMissingColumns=True)


def evaluation_run(chapters: DataFrame, keys: list[str], failed: Column, guess: Column, gold: Column) -> DataFrame:
    """Chapters run one by one: failed ones are counted and left out of the totals."""
    scored = ~F.coalesce(failed, F.lit(False))
    correct = F.count_if(scored & (guess == gold))
    return chapters.groupBy(*keys).agg(
        F.count("*").alias("chapters"),
        F.count_if(~scored).alias("failed"),
        F.count_if(scored).alias("scored"),
        correct.alias("correct"),
        F.round(F.coalesce(F.try_divide(correct, F.count_if(scored)), F.lit(0.0)), 6).alias("accuracy"),
    )


def latest_answers(answers: DataFrame, key: str, version: str) -> DataFrame:
    """Of answers to repeated requests the one to the newest; what comes late to an older request is dropped."""
    rest = [c for c in answers.columns if c not in (key, version)]
    return answers.groupBy(key).agg(F.max(version).alias(version), F.max_by(F.struct(*rest), version).alias("a")).select(key, version, "a.*")


def first_appearances(seen: DataFrame, keys: list[str], place: str, what: str) -> DataFrame:
    """Each scene's cast: distinct ids in the order in which they appear first."""
    first = seen.groupBy(*keys, what).agg(F.min(place).alias(place))
    ordered = F.array_sort(F.collect_list(F.struct(place, what)))
    return first.groupBy(*keys).agg(F.transform(ordered, lambda x: x[what]).alias("cast"))


def leasable(owner: Column, heartbeat: Column, mine: str, now: Column, stale_s: int = 60) -> Column:
    """Whether a lease can be taken: nobody has it, I have it, or its owner has been silent too long."""
    return owner.isNull() | (owner == mine) | (heartbeat < now - F.make_interval(secs=F.lit(stale_s)))


def sync_plan(items: DataFrame, synced: DataFrame, key: str, version: str, checkpoint: Column) -> DataFrame:
    """What a sync that was stopped at a checkpoint still has to send: all beyond it, and what changed before it."""
    old = synced.select(key, F.col(version).alias("_sent"))
    joined = items.join(old, key, "left")
    return joined.where((F.col(key) > checkpoint) | ~F.col("_sent").eqNullSafe(F.col(version))).drop("_sent")


def queue_states(log: DataFrame) -> DataFrame:
    """Jobs from their log (queue, job, seq, at, event): status, progress, and the place of those that wait, first come first.

    Events: enqueued (again, if a worker was lost), started, progress, succeeded, failed, cancelled. One that ends a job
    decides, later ones do not count; a job that was enqueued after it was last worked on waits.
    """
    ends, works = F.col("event").isin("succeeded", "failed", "cancelled"), F.col("event").isin("started", "progress")
    came = F.col("event") == "enqueued"
    per = log.groupBy("queue", "job").agg(
        F.max(F.when(came, F.struct("at", "seq"))).alias("came"),
        F.min_by(F.when(ends, F.col("event")), F.when(ends, F.col("seq"))).alias("ended"),
        F.max(F.when(works, F.col("seq"))).alias("worked"),
        F.max(F.when(came, F.col("seq"))).alias("last_came"),
        F.count_if(F.col("event") == "progress").alias("progress"),
    )
    running = F.coalesce(F.col("worked"), F.lit(-1)) > F.coalesce(F.col("last_came"), F.lit(-1))
    told = per.withColumn("status", F.coalesce("ended", F.when(running, "running").when(F.col("came").isNotNull(), "waiting").otherwise("unknown")))
    place = F.row_number().over(Window.partitionBy("queue", F.col("status") == "waiting").orderBy("came", "job"))
    return told.select("queue", "job", "status", "progress", F.when(F.col("status") == "waiting", place).alias("place"))
