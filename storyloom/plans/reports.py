"""Report, usage, evaluation and run-log queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.operators import history as H
from storyloom.operators import report as P
from storyloom.plans.registry import query


@query("""
select conv_id, count(*) as segments, count(*) filter (role = 'user') as resolved, count(*) filter (role = 'assistant') as surface_only,
       count(*) filter (role not in ('user', 'assistant')) as unknown,
       coalesce(sum(length(text)) filter (role = 'system'), 0)::bigint as narration_chars, coalesce(sum(length(text)) filter (role <> 'system'), 0)::bigint as spoken_chars,
       'Conversation ' || conv_id as title
from conversations group by conv_id
""")
def report_chapters(t):
    """One report row per chapter: states, narrated and spoken characters (A-10, P-10, P-11, P-12)."""
    return P.chapters(t("conversations"))


@query("""
with s as (select source, count(*) as n, sum(n_chars)::bigint as chars from documents group by source),
     r as (select *, row_number() over (order by n desc, source) as rank from s)
select source, n, chars from r where rank <= 10 union all select 'other', sum(n)::bigint, sum(chars)::bigint from r where rank > 10 having count(*) > 0
""")
def report_characters(t):
    """The ten largest speakers and one row for all others (A-11, A-14)."""
    per = t("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return P.top_and_other(per, "source", "n", ["n", "chars"], 10)


BUCKETS = """
with r as (select doc_id, n_chars, row_number() over (order by doc_id) - 1 as rn, count(*) over () as n from documents)
, b as (select floor(rn / ceil(n / 30.0))::int as bucket, * from r)
"""


@query(BUCKETS + "select bucket, min(doc_id) as first_doc, count(*) as n, sum(n_chars)::bigint as chars from b group by bucket")
def report_buckets_30(t):
    """Chapters in at most thirty groups of equal number (A-12); numbering is by range, not in one task."""
    numbered = P.numbered(t("documents").select("doc_id", "n_chars"), "doc_id")
    return P.bucketed(numbered, 30).groupBy("bucket").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
with s as (select source, lang, count(*) as n from documents group by all), top as (select source from documents group by source order by count(*) desc, source limit 12),
     m as (select max(n) as most from s where source in (select source from top))
select source, lang, n, ceil(n::double / most * 7)::int as step from s, m where source in (select source from top)
""")
def report_heatmap(t):
    """Mentions by entity and bucket in seven steps (A-15, W-12)."""
    return P.heatmap(t("documents").select("source", "lang"), "source", "lang", 12, 7)


@query("""
select count(*) as segments, count(distinct conv_id) as chapters, count(*) filter (role = 'user') as resolved,
       round(count(*) filter (role = 'user') / nullif(count(*) filter (role <> 'system'), 0)::double, 6) as share
from conversations
""")
def report_kpis(t):
    """Totals and the share of resolved speech (A-13)."""
    spoken = F.count_if(F.col("role") != "system")
    resolved = F.count_if(F.col("role") == "user")
    return t("conversations").agg(F.count("*").alias("segments"), F.countDistinct("conv_id").alias("chapters"), resolved.alias("resolved"), F.round(F.try_divide(resolved, spoken), 6).alias("share"))


@query(BUCKETS + """
, s as (select bucket, lang, sum(n_chars)::bigint as chars from b join documents using (doc_id, n_chars) group by all)
select bucket, lang, chars, round(chars / sum(chars) over (partition by bucket)::double, 6) as share from s
""")
def report_stacked_shares(t):
    """Series stacked to one in each bucket (A-25)."""
    numbered = P.numbered(t("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    sums = P.bucketed(numbered, 30).groupBy("bucket", "lang").agg(F.sum("n_chars").alias("chars"))
    return sums.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(Window.partitionBy("bucket")), 6))


USAGE = """
  count(*) as runs, count(*) filter (event_type = 'purchase') as succeeded, count(*) filter (event_type = 'error') as failed,
  count(distinct user_id) as chapters, round(coalesce(sum(value), 0), 2) as tokens, max(ts) as last_run, round(coalesce(sum(value), 0) * 0.5 / 1000, 4) as cost
from events
"""


@query(f"select event_type, {USAGE} group by event_type")
def usage_rollup(t):
    """Usage by key: counts, conditional sums, distinct chapters, last run, cost (A-05, A-06, P-08)."""
    return P.usage(t("events"), ["event_type"])


@query(f"select event_type, {USAGE} group by grouping sets ((event_type), ())")
def usage_cost(t):
    """Usage by key with a total row, from one pass over the log (A-06)."""
    return P.usage(t("events"), ["event_type"], total=True)


@query("""
with r as (select user_id, bool_or(event_type = 'purchase') as done, count(*) filter (event_type = 'error') as failed, count(*) as attempts,
                  arg_max(event_type, (ts, event_id)) as last_type, max(ts) as last_ts from events group by user_id)
select user_id, attempts, case when last_type = 'click' and last_ts >= timestamp '2024-01-20' then 'skip_running' when last_type = 'click' then 'interrupt_and_run'
       when done then 'skip_done' when failed >= 3 then 'skip_failed' else 'run' end as decision from r
""")
def run_history_decision(t):
    """What to do with each chapter, from its run history (A-08, R-01)."""
    runs = t("events")
    last = F.max(F.struct("ts", "event_id", "event_type"))
    per = runs.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("attempts"), last.alias("last"))
    running = F.col("last.event_type") == "click"
    fresh = F.col("last.ts") >= F.expr("timestamp_ntz'2024-01-20'")
    return per.select("user_id", "attempts", H.run_decision(F.col("done"), F.col("failed"), running & fresh, running & ~fresh).alias("decision"))


@query("""
with l as (select distinct on (user_id) user_id, ts, event_type, value from events order by user_id, ts desc, event_id desc)
select user_id, ts from l where coalesce(case when value > 50 then ts end, ts - interval 1 hour) < timestamp '2024-01-30 18:00:00'
""")
def stale_runs(t):
    """Chapters whose last sign of life lies before a cutoff (P-07, R-03)."""
    last = H.latest(t("events").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id")
    heartbeat, started = F.when(F.col("value") > 50, F.col("ts")), F.col("ts") - F.expr("interval 1 hour")
    return last.where(H.stale(heartbeat, started, F.expr("timestamp_ntz'2024-01-30 18:00:00'"))).select("user_id", "ts")


@query("""
select lang, count(*) as total, count(*) filter (pred = quality) as correct, count(*) filter (pred <> quality) as wrong, count(*) filter (pred is null) as unattributed,
       round(coalesce(count(*) filter (pred = quality) / nullif(count(*), 0)::double, 0), 6) as accuracy
from (select lang, quality, case when n_chars < 300 then null when contains(text, '%%%') then 0 else 1 end as pred from labels join documents using (doc_id)) group by lang
""")
def eval_attribution(t):
    """Predictions against gold labels by group (A-16, J-21)."""
    guess = F.when(F.col("n_chars") < 300, None).when(F.col("text").contains("%%%"), 0).otherwise(1)
    scored = t("labels").join(t("documents"), "doc_id").select("lang", "quality", guess.alias("pred"))
    return P.evaluated(scored, ["lang"], F.col("pred"), F.col("quality"))


@query("""
select main_ok, judge_ok, count(*) as n from (
  select (case when contains(text, '%%%') then 0 else 1 end) = quality as main_ok, (case when n_chars > 200 then 1 else 0 end) = quality as judge_ok from labels join documents using (doc_id)) group by all
""")
def eval_shadow_confusion(t):
    """A second judge beside the first, two by two (A-17, A-18)."""
    scored = t("labels").join(t("documents"), "doc_id")
    main = F.when(F.col("text").contains("%%%"), 0).otherwise(1) == F.col("quality")
    judge = F.when(F.col("n_chars") > 200, 1).otherwise(0) == F.col("quality")
    return scored.select(main.alias("main_ok"), judge.alias("judge_ok")).groupBy("main_ok", "judge_ok").agg(F.count("*").alias("n"))


VOICES = """(values ('user', 'voice_a'), ('assistant', 'voice_b')) v(role, voice)"""


@query(f"""
select conv_id, turn, coalesce(v.voice, case when c.role = 'system' then 'narrator' end, 'default') as voice, case when c.role = 'system' then 'narration' else 'dialogue' end as kind, length(text) as chars
from conversations c left join {VOICES} on c.role = v.role
""")
def tts_tasks(t):
    """One voice task per segment, with fallbacks (X-13, J-22)."""
    voices = F.create_map(F.lit("user"), F.lit("voice_a"), F.lit("assistant"), F.lit("voice_b"))
    system = F.col("role") == "system"
    voice = F.coalesce(F.try_element_at(voices, F.col("role")), F.when(system, "narrator"), F.lit("default"))
    return t("conversations").select("conv_id", "turn", voice.alias("voice"), F.when(system, "narration").otherwise("dialogue").alias("kind"), F.length("text").alias("chars"))


@query("select conv_id, turn, lag(turn) over w as previous, lead(turn) over w as next from conversations window w as (partition by conv_id order by turn)")
def neighbours(t):
    """The chapters before and after each (W-07, P-13)."""
    return H.neighbours(t("conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("select conv_id, turn, role is distinct from lag(role) over (partition by conv_id order by turn) as banner from conversations")
def scene_banner(t):
    """Whether a banner is due: the scene is not that of the row before (W-10, W-13)."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").select("conv_id", "turn", (~F.col("role").eqNullSafe(before)).alias("banner"))


@query("select event_id, user_id, value from events where event_type in ('purchase', 'view') and value / 100 < 0.6")
def review_queue(t):
    """Facts of low confidence, for review (V-11, D-14); the threshold is on the double."""
    rows = t("events").where(F.col("event_type").isin("purchase", "view") & (F.col("value") / 100 < 0.6))
    return rows.select("event_id", "user_id", "value")


@query("""
select event_id, code from (
  select event_id, unnest(list_filter([case when value < 0 or value > 1 then 'FACT-RANGE' end, case when trim(event_type) = '' then 'FACT-EMPTY' end,
    case when count(*) over (partition by user_id, event_type, date_trunc('hour', ts)) > 1 then 'FACT-DUPLICATE' end], lambda x: x is not null)) as code from events)
""")
def fact_batch_checks(t):
    """Every rule a batch of facts breaks (V-08, V-09, A-21)."""
    same = F.count("*").over(Window.partitionBy("user_id", "event_type", F.date_trunc("hour", "ts")))
    codes = F.array(F.when((F.col("value") < 0) | (F.col("value") > 1), "FACT-RANGE"), F.when(F.trim("event_type") == "", "FACT-EMPTY"), F.when(F.col("same") > 1, "FACT-DUPLICATE"))
    return t("events").withColumn("same", same).select("event_id", F.explode(F.array_compact(codes)).alias("code"))


@query("""
select event_type as status, count(*) as n, round(sum(case when event_type = 'error' then 1 else 0 end) / count(*), 4) as failed_share, min(event_id) as first_event, max(event_id) + 1 as resume_at from events group by event_type
""")
def job_progress(t):
    """Totals of a job's events and where to resume (A-19, R-07, R-08)."""
    failed = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
    return t("events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(failed / F.count("*"), 4).alias("failed_share"), F.min("event_id").alias("first_event"), (F.max("event_id") + 1).alias("resume_at"))


@query("""
select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 50
""")
def newest_finished_50(t):
    """The last fifty finished jobs of each queue, newest first (O-05, O-07)."""
    rows = t("events").select("user_id", "event_id", "ts")
    return H.top_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50, "n").drop("n")
