"""Views, states and maintenance over the driver's tables, which stand in for books, chapters, entities and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import deltas as B
from storyloom.operators import facts as K
from storyloom.operators import history as H
from storyloom.operators import identity as I
from storyloom.operators import maintenance as M
from storyloom.operators import spans as S
from storyloom.operators import validate as V
from storyloom.operators import views as W
from storyloom.plans.library import CHANGES, _priority_history
from storyloom.plans.registry import query
from storyloom.streaming import runs as R


@query("""
select c_custkey, c_name, n_name, coalesce(segments, 0) as segments, coalesce(unresolved, 0) as unresolved, coalesce(mentions, 0) as mentions
from customer left join (select o_custkey, count(*) as segments from orders group by o_custkey) o on c_custkey = o_custkey
left join (select o_custkey, count(*) as unresolved from orders where o_orderstatus = 'P' group by o_custkey) p on c_custkey = p.o_custkey
left join (select user_id, count(*) as mentions from events group by user_id) e on c_custkey = user_id left join nation on c_nationkey = n_nationkey
""")
def chapter_counts(t):
    """Chapters, without their texts, with their segments, unresolved ones, mentions and entity (A-02, A-23, J-16, P-01)."""
    orders = t("orders").select("o_custkey", "o_orderstatus")
    counts = {"segments": (orders, "o_custkey"), "unresolved": (orders.where("o_orderstatus = 'P'"), "o_custkey"), "mentions": (t("events").select("user_id"), "user_id")}
    chapters = W.counted(t("customer").select("c_custkey", "c_name", "c_nationkey"), counts, "c_custkey")
    return chapters.join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "segments", "unresolved", "mentions")


@query("select l_suppkey, l_partkey, count(*) as n from lineitem group by l_suppkey, l_partkey")
def mention_counts(t):
    """Mentions of each entity in each chapter (A-03)."""
    return W.mention_counts(t("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


@query("""
select p_partkey, p_name, p_brand, coalesce(dialogues, 0) as dialogues, coalesce(mentions, 0) as mentions
from part left join (select l_partkey, count(*) as mentions from lineitem group by l_partkey) m on p_partkey = m.l_partkey
left join (select l_partkey, count(*) as dialogues from lineitem where l_returnflag = 'R' group by l_partkey) d on p_partkey = d.l_partkey
where p_size < 45 and p_type <> 'PROMO' and (contains(lower(p_name), 'red') or contains(lower(p_brand), '#1'))
""")
def entity_views(t):
    """Active entities of some type whose name or alias holds a word, with their dialogues and mentions, 0 kept (A-04, P-16)."""
    lines = t("lineitem").select("l_partkey", "l_returnflag")
    chosen = t("part").where("p_size < 45 and p_type <> 'PROMO'").where(W.named(["p_name"], "Red") | W.named(["p_brand"], "#1")).select("p_partkey", "p_name", "p_brand")
    return W.counted(chosen, {"dialogues": (lines.where("l_returnflag = 'R'"), "l_partkey"), "mentions": (lines, "l_partkey")}, "p_partkey")


@query("select (select count(*) from documents) as total, (select count(*) from documents where doc_id in (select doc_id from labels)) as linked")
def linked_counts(t):
    """How many pieces of evidence there are, and how many are linked (A-07)."""
    links = t("labels").select("doc_id").distinct().withColumn("link", F.lit(1))
    return t("documents").select("doc_id").join(links, "doc_id", "left").agg(F.count("*").alias("total"), F.count("link").alias("linked"))


STATUS = """
with r as (select user_id, bool_or(event_type = 'purchase') as done, arg_max(event_type, (ts, event_id)) as last from events group by user_id),
     s as (select c_custkey, case when done then 'parsed' when last = 'click' then 'running' when last = 'error' then 'failed' when last = 'view' then 'interrupted' else 'unparsed' end as status,
                  md5(c_name) as h, case when c_nationkey < 5 then null when c_nationkey < 10 then 'old' else md5(c_name) end as sent
           from customer left join r on c_custkey = user_id)
"""


@query(STATUS + "select c_custkey, status, h is distinct from sent as needs_sync, status in ('failed', 'interrupted') as unfinished from s")
def chapter_status(t):
    """Each chapter's parse status, whether it is unfinished, and whether its external document is stale (P-14, P-17, J-14)."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    runs = t("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("done"), last.alias("last"))
    joined = t("customer").join(runs, F.col("c_custkey") == F.col("user_id"), "left")
    status = W.parse_status(F.col("done"), F.col("last") == "click", F.col("last") == "error", F.col("last") == "view")
    h = F.md5("c_name")
    sent = F.when(F.col("c_nationkey") < 5, None).when(F.col("c_nationkey") < 10, "old").otherwise(h)
    return joined.select("c_custkey", status.alias("status"), W.needs_sync(h, sent).alias("needs_sync")).withColumn("unfinished", W.unfinished(F.col("status")))


@query("""
select event_id, event_type from events where event_type = 'error' or value / 100 < 0.6 or event_type in ('click', 'view')
""")
def shadow_findings(t):
    """A second judge's answers that are worth a look (P-15)."""
    verdict = F.when(F.col("event_type") == "click", "uncertain").when(F.col("event_type") == "view", "contradicts").otherwise("supports")
    return t("events").where(V.finding(F.col("event_type") == "error", F.col("value") / 100, verdict)).select("event_id", "event_type")


KINDS = "case o_orderpriority when '5-LOW' then 'note' when '4-NOT SPECIFIED' then 'front_matter' else 'chapter' end"


@query(f"select o_orderkey, kind from (select o_orderkey, {KINDS} as kind from orders) where kind not in ('note', 'front_matter')")
def story_content(t):
    """Chapters that tell the story (P-18)."""
    return W.story(t("orders").select("o_orderkey", F.expr(KINDS).alias("kind")), "kind")


@query("""
with r as (select event_id, case when event_type = 'error' then null else event_type end as model from events), k as (select model, count(*) as runs from r group by model)
select event_id, runs from r join k on r.model is not distinct from k.model
""")
def null_safe_keys(t):
    """Runs with those of the same model, where no model is a model like any other (P-06)."""
    runs = t("events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("model"))
    per = runs.groupBy(F.col("model").alias("of")).agg(F.count("*").alias("runs"))
    return runs.join(per, F.col("model").eqNullSafe(F.col("of"))).select("event_id", "runs")


@query("""
select p_partkey, p_size between 1 and 20 as limit_ok, coalesce(p_retailprice = floor(p_retailprice) and p_retailprice between 0 and 1000, false) as price_whole, coalesce(isfinite(p_retailprice), false) as finite from part
""")
def argument_checks(t):
    """Ranges, whole and finite numbers (P-09)."""
    return t("part").select("p_partkey", V.whole(F.col("p_size"), 1, 20).alias("limit_ok"), V.whole(F.col("p_retailprice"), 0, 1000).alias("price_whole"), V.finite(F.col("p_retailprice")).alias("finite"))


@query(CHANGES + """
select o_custkey, o_orderkey, o_orderdate, o_orderpriority, case when valid_to >= timestamp '1997-01-01' then null else valid_to end as valid_to,
       case when valid_to >= timestamp '1997-01-01' then null else superseded_by end as superseded_by from s where o_orderdate < timestamp '1997-01-01'
""")
def consistency_invalidated(t):
    """A history without the facts from a chapter on; what they closed is open again (D-10)."""
    return M.invalidated(_priority_history(t), "o_orderdate", F.expr("timestamp_ntz'1997-01-01'"), ["valid_to", "superseded_by"]).drop("old_value")


@query("select l.doc_id, case when source in ('src1', 'src2') then null else quality end as pointer, toxic from labels l join documents d on l.doc_id = d.doc_id")
def derived_cleared(t):
    """Derived pointers of some editions dropped, their rows kept (D-20)."""
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").withColumnRenamed("quality", "pointer")
    scope = t("documents").where(F.col("source").isin("src1", "src2")).select("source").distinct()
    return M.cleared(rows, scope, ["source"], ["pointer"]).select("doc_id", "pointer", "toxic")


_STATES = """
     f{0} as (select * from orders_{0}), w{0} as (select o_custkey, o_orderkey, o_orderpriority, o_orderdate, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) as old, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth from f{0}),
     c{0} as (select * from w{0} where nth = 1 or old is distinct from o_orderpriority),
     s{0} as (select o_custkey, o_orderkey, o_orderpriority, o_orderdate, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to from c{0})"""


@query(f"""
with orders_a as (select o_custkey, o_orderkey, o_orderpriority, o_orderdate from orders where o_orderkey % 11 <> 5),
     orders_b as (select o_custkey, o_orderkey, case when o_orderkey % 13 = 2 then '1-URGENT' else o_orderpriority end as o_orderpriority, o_orderdate from orders where o_orderkey % 17 <> 3),
     {_STATES.format("a")}, {_STATES.format("b")},
     x as (select *, -1 as sign from sa union all select *, 1 from sb)
select o_custkey, o_orderkey, o_orderpriority, o_orderdate, valid_to, sum(sign)::bigint as sign from x group by all having sum(sign) <> 0
""")
def history_changes(t):
    """How histories change when facts come, go and are corrected: only touched entities are derived anew (D-10, D-12, D-16)."""
    facts = t("orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    now = facts.where("o_orderkey % 11 <> 5")
    corrected = F.when(F.col("o_orderkey") % 13 == 2, "1-URGENT").otherwise(F.col("o_orderpriority"))
    later = facts.where("o_orderkey % 17 <> 3").withColumn("o_orderpriority", corrected)
    history = lambda rows: H.superseded(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", "valid_to")
    return B.carried(now, B.changed(now, later), ["o_custkey"], history).withColumnRenamed(B.SIGN, "sign")


MOVES = """
with recursive m as (select p_partkey as source_id, case when p_size <= 25 then p_partkey + 1 else -p_partkey end as target_id, case when p_size = 49 then timestamp '1997-01-01' when p_size = 50 then timestamp '1998-01-01' end as since
                     from part where p_size <= 25 or p_size >= 49),
     way as (select source_id, target_id, 1 as n from m where since is null union all select way.source_id, m.target_id, n + 1 from way join m on m.source_id = way.target_id and m.since is null),
     root as (select source_id, arg_max(target_id, n) as root_id, max(n) as n from way group by source_id),
     r as (select l_orderkey, l_linenumber, l_partkey, l_shipdate, coalesce(root_id, l_partkey) as now from lineitem left join root on l_partkey = root.source_id),
     j as (select l_partkey, coalesce(target_id, now) as entity from r left join m on now = m.source_id and m.since <= l_shipdate)
"""


def _moves(t):
    target = F.expr("case when p_size <= 25 then p_partkey + 1 else -p_partkey end")
    since = F.expr("case when p_size = 49 then timestamp_ntz'1997-01-01' when p_size = 50 then timestamp_ntz'1998-01-01' end")
    return t("part").where("p_size <= 25 or p_size >= 49").select(F.col("p_partkey").alias("source_id"), target.alias("target_id"), since.alias("since"))


def _moved(t):
    return I.reassigned(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"), "l_partkey", "l_shipdate", _moves(t))


@query(MOVES + "select source_id, root_id from root")
def merged_identities(t):
    """Who each merged entity is in the end, after chains of merges (D-13): pointer doubling."""
    return I.roots(_moves(t).where("since is null"))


@query(MOVES + "select entity, count(*) as n from j group by 1")
def entity_merge_split(t):
    """Mentions after entities were merged, one into the next, or split from a chapter on (D-13)."""
    return _moved(t)[0].groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("n"))


@query(MOVES + "select l_partkey as source_id, entity as target_id, count(*) as n from j where entity <> l_partkey group by all")
def entity_move_audit(t):
    """What each merge or split moved, and where to (D-13's audit)."""
    return _moved(t)[1]


@query("""
with q as (select embedding from embeddings where vec_id = 7), asked as (select unnest([1, 2, 3, 999])::int as label),
     s as (select e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as similarity from embeddings e, q where e.label in (select label from asked))
select * from (select vec_id, label, round(similarity, 6) as similarity, 'found' as status from s order by s.similarity desc, vec_id limit 10)
union all select null, label, null, 'skipped' from asked where label not in (select label from s)
""")
def search_editions(t):
    """One search over several editions; those that hold nothing to search are named (J-20)."""
    scenes = t("embeddings").select("vec_id", "label", "embedding")
    asked = scenes.where("vec_id = 7 and embedding is not null").select("embedding").first()
    found = W.search_editions(scenes, list(asked[0]) if asked else [], [1, 2, 3, 999], "label", 10, ["vec_id"])
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), "status")


@query("""
with c as (select lang, n_chars < 300 as failed, case when contains(text, '%%%') then 0 else 1 end as guess, quality from labels join documents using (doc_id))
select lang, count(*) as chapters, count(*) filter (failed) as failed, count(*) filter (not failed) as scored, count(*) filter (not failed and guess = quality) as correct,
       round(coalesce(count(*) filter (not failed and guess = quality) / nullif(count(*) filter (not failed), 0)::double, 0), 6) as accuracy from c group by lang
""")
def evaluation_run(t):
    """Chapters run and scored one by one; failed ones are told and left out of the totals (A-26)."""
    guess = F.when(F.col("text").contains("%%%"), 0).otherwise(1)
    return W.evaluation_run(t("labels").join(t("documents"), "doc_id"), ["lang"], F.col("n_chars") < 300, guess, F.col("quality"))


@query("""
with l as (select distinct on (user_id) user_id, ts, event_type from events order by user_id, ts desc, event_id desc)
select user_id, event_type = 'click' or ts < timestamp '2024-01-30 23:00:00' - interval 3600 second as can_take from l
""")
def lease_decisions(t):
    """Leases that could be taken: mine, or silent too long (D-07, R-02, D-18)."""
    last = H.latest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id")
    return last.select("user_id", W.leasable(F.col("event_type"), F.col("ts"), "click", F.expr("timestamp_ntz'2024-01-30 23:00:00'"), 3600).alias("can_take"))


@query("""
select o_orderkey, o_custkey, o_totalprice from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'P')
union all select o_orderkey, o_custkey, 0.0 from orders where o_orderstatus = 'P'
""")
def replace_on_commit(t):
    """What a pass writes replaces all that its chapters had (D-08, D-15)."""
    rows = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    fresh = t("orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", F.lit(0.0).alias("o_totalprice"))
    return M.replaced(rows, fresh, ["o_custkey"])


@query("""
with i as (select o_orderkey, 'O' as o_orderstatus, 1.0 as o_totalprice from orders where o_totalprice > 100000 union all select -1, 'O', 1.0),
     ok as (select * from i where exists (select 1 from orders o where o.o_orderkey = i.o_orderkey and o.o_orderstatus = i.o_orderstatus))
select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey not in (select o_orderkey from ok) union all select * from ok
""")
def compare_and_set(t):
    """Values are written only where the scene still is what they were made from (D-17)."""
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    made = rows.where("o_totalprice > 100000").select("o_orderkey", F.lit("O").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    gone = made.limit(1).select(F.lit(-1).cast("long").alias("o_orderkey"), "o_orderstatus", "o_totalprice")
    return M.compare_and_set(rows, made.unionByName(gone), rows, "o_orderkey", "o_orderstatus")


@query("""
with a as (select o_orderkey, case when o_orderstatus = 'P' and o_totalprice < 50000 then null else o_orderdate end as valid_from,
                  o_orderdate + case when o_totalprice > 400000 then interval (-1) day else interval 1 day end as valid_to from orders)
select o_orderkey, case when valid_from is null then 'no start' else 'ends before it starts' end as code from a where valid_from is null or valid_to <= valid_from
""")
def alias_intervals(t):
    """Intervals of aliases that cannot be (D-19)."""
    start = F.when(~((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000)), F.col("o_orderdate"))
    end = F.col("o_orderdate") + F.expr("case when o_totalprice > 400000 then interval -1 day else interval 1 day end")
    return V.interval_errors(t("orders").select("o_orderkey", start.alias("valid_from"), end.alias("valid_to")), "valid_from", "valid_to").select("o_orderkey", "code")


@query("""
with s as (select doc_id, case when quality = 0 then 'old' else md5(text) end as h from labels join documents using (doc_id))
select d.doc_id, md5(text) as h from documents d left join s on d.doc_id = s.doc_id where d.doc_id > (select max(doc_id) // 2 from documents) or s.h is distinct from md5(text)
""")
def resumable_sync(t):
    """What a sync that was stopped halfway still has to send (R-10)."""
    items = t("documents").select("doc_id", F.md5("text").alias("h"))
    sent = t("labels").join(items, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "old").otherwise(F.col("h")).alias("h"))
    half = items.agg(F.floor(F.max("doc_id") / 2).alias("half"))
    return W.sync_plan(items.crossJoin(F.broadcast(half)), sent, "doc_id", "h", F.col("half")).select("doc_id", "h")  # half is one row


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def latest_wins(t):
    """The answer to the newest request of each reader (R-11)."""
    return W.latest_answers(t("events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


#: A log entry's job: the reader, by the day, so there are jobs with few entries and many states.
EVENT = "case event_type when 'signup' then 'enqueued' when 'view' then 'progress' when 'click' then 'started' when 'purchase' then 'succeeded' else 'failed' end"


@query(f"""
with l as (select user_id % 7 as queue, user_id || ':' || (event_id % 97) as job, event_id as seq, ts as moment, {EVENT} as event from events),
     p as (select queue, job, max((moment, seq)) filter (event = 'enqueued') as came, arg_min(event, seq) filter (event in ('succeeded', 'failed')) as ended,
                  coalesce(max(seq) filter (event in ('started', 'progress')), -1) > coalesce(max(seq) filter (event = 'enqueued'), -1) as started, count(*) filter (event = 'progress') as progress from l group by queue, job),
     s as (select *, coalesce(ended, case when started then 'running' when came is not null then 'waiting' else 'unknown' end) as status from p)
select queue, job, status, progress, case when status = 'waiting' then row_number() over (partition by queue, status = 'waiting' order by came, job) end::int as place from s
""")
def queue_states(t):
    """Jobs of several queues from their whole log: status, progress and the place of those that wait (R-05, R-06)."""
    job = F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 97).cast("string"))
    log = t("events").select((F.col("user_id") % 7).alias("queue"), job.alias("job"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.expr(EVENT).alias("event"))
    return W.queue_states(log)


@query("""
with l as (select user_id as run_id, event_id as seq, ts as moment, case event_type when 'signup' then 'started' when 'view' then 'heartbeat' when 'purchase' then 'succeeded' when 'error' then 'failed' else 'interrupted' end as event from events)
select run_id, coalesce(arg_min(event, seq) filter (event in ('succeeded', 'failed', 'interrupted')), 'running') as status, min(moment) filter (event = 'started') as started_at,
       max(moment) filter (event = 'heartbeat') as heartbeat_at, arg_min(moment, seq) filter (event in ('succeeded', 'failed', 'interrupted')) as finished_at from l group by run_id
""")
def run_lifecycle(t):
    """Runs from their log: started, alive, ended by the first event that ends them (R-13)."""
    event = F.expr("case event_type when 'signup' then 'started' when 'view' then 'heartbeat' when 'purchase' then 'succeeded' when 'error' then 'failed' else 'interrupted' end")
    return R.run_states(t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), event.alias("event")))


@query("""
with f as (select conv_id, role, min(turn) as first from conversations where role is not null group by conv_id, role)
select conv_id, string_agg(role, ',' order by first, role) as roles from f group by conv_id
""")
def scene_casts(t):
    """Each scene's cast in the order of first appearance (T-20)."""
    found = W.first_appearances(t("conversations").where("role is not null"), ["conv_id"], "turn", "role")
    return found.select("conv_id", F.array_join("cast", ",").alias("roles"))


@query("""
with s as (select doc_id, 10 as a, 40 as b, 30 + doc_id % 100 as c, 60 + doc_id % 100 as d, text from documents)
select doc_id, least(a, c)::int as char_start, greatest(b, d)::int as char_end, substr(text, least(a, c) + 1, greatest(b, d) - least(a, c)) as quote from s
""")
def timed_evidence(t):
    """The hull of evidence and its time anchor, and what the text says there (T-15)."""
    a, b, c, d = F.lit(10), F.lit(40), (30 + F.col("doc_id") % 100), (60 + F.col("doc_id") % 100)
    start, end, quote = K.timed((a, b), (c, d), F.col("text"))
    return t("documents").select("doc_id", start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), quote.alias("quote"))


@query("""
select doc_id::varchar as fact_id, unnest(list_filter([case when doc_id % 5 = 1 then 'FACT-EMPTY' end, case when doc_id % 5 = 2 then 'FACT-CONFIDENCE' end, case when doc_id % 5 = 3 then 'FACT-SCOPE' end,
       case when doc_id % 5 <> 3 and (substr(text, 6, 20) <> case when doc_id % 5 = 4 then 'said by nobody' else substr(text, 6, 20) end) then 'FACT-EVIDENCE' end], lambda x: x is not null)) as code from documents
""")
def fact_evidence(t):
    """Facts against their texts: fields, confidence, scope and the slice that must say it (V-10, D-16's checks)."""
    docs = t("documents")
    k = F.col("doc_id") % 5
    facts = docs.select(
        F.col("doc_id").cast("string").alias("fact_id"),
        F.lit("state").alias("kind"),
        F.when(k == 3, "nowhere").otherwise(F.col("doc_id").cast("string")).alias("chapter_id"),
        F.when(k == 1, " ").otherwise(F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("subject"),
        F.col("doc_id").cast("string").alias("field"),
        F.lit(None).cast("string").alias("object"),
        F.lit("calm").alias("value"),
        F.when(k == 2, 1.5).otherwise(0.9).alias("confidence"),
        F.lit(5).alias("char_start"),
        F.lit(25).alias("char_end"),
        F.when(k == 4, "said by nobody").otherwise(F.substring("text", 6, 20)).alias("quote"),
    )
    return V.fact_errors(facts, docs.select(F.col("doc_id").cast("string").alias("chapter_id"), "text")).select("fact_id", "code")


@query("""
with d as (select doc_id, doc_id % 11 as k from documents where length(text) >= 10)
select doc_id::varchar as chapter_id, unnest(case k when 1 then ['IR-DIALOGUE-SPEAKER'] when 2 then ['IR-SEG-SCENE'] when 3 then ['IR-LENGTH', 'IR-SCENE-PARTITION', 'IR-SEG-COVER'] when 4 then ['IR-MENTION-EVIDENCE']
       when 5 then ['IR-RANGE'] when 6 then ['IR-REF'] when 7 then ['IR-UNIQUE', 'IR-UNIQUE'] else [] end) as code from d
""")
def document_validation(t):
    """Every rule over parsed chapters, each broken in some (V-01, V-05, V-06, V-07, V-12)."""
    docs = t("documents").where("length(text) >= 10").select(F.col("doc_id").cast("string").alias("chapter_id"), "text", (F.col("doc_id") % 11).alias("k"), F.length("text").alias("n"), F.floor(F.length("text") / 2).cast("int").alias("half"))
    chapters = docs.select("chapter_id", (F.col("n") + F.when(F.col("k") == 3, 1).otherwise(0)).alias("char_count"), "text")
    none = F.array().cast("array<string>")
    scene = lambda i, a, b: F.struct(F.lit(f"s{i}").alias("id"), F.lit(i).alias("index"), a.alias("char_start"), b.alias("char_end"), none.alias("character_ids"))
    scenes = docs.select("chapter_id", F.inline(F.array(scene(0, F.lit(0), F.col("half")), scene(1, F.col("half"), F.col("n")))))

    def segment(i, a, b, kind, where, name, surface):
        return F.struct(name.alias("id"), where.alias("scene_id"), F.lit(i).alias("index"), F.lit(kind).alias("kind"), a.alias("char_start"), b.alias("char_end"), F.lit(None).cast("string").alias("entity_id"), surface.alias("surface"), F.when(F.col("k") == 5, F.lit(1.5 if i else 0.5)).otherwise(0.5).alias("confidence"))

    first = segment(0, F.lit(0), F.col("half"), "narration", F.lit("s0"), F.lit("g0"), F.lit(None).cast("string"))
    second = segment(1, F.col("half"), F.col("n"), "dialogue", F.when(F.col("k") == 2, "s0").otherwise("s1"), F.when(F.col("k") == 7, "g0").otherwise("g1"), F.when(F.col("k") != 1, "someone"))
    segments = docs.select("chapter_id", "k", F.inline(F.array(first, second))).drop("k")
    entities = docs.select("chapter_id", F.lit("e1").alias("id"), F.lit(0.9).alias("confidence"))
    mentions = docs.select("chapter_id", F.lit(0).alias("index"), F.when(F.col("k") == 6, "e9").otherwise("e1").alias("entity_id"), F.when(F.col("k") == 4, "elsewhere").otherwise(F.substring("text", 2, 4)).alias("surface"), F.lit(1).alias("char_start"), F.lit(5).alias("char_end"))
    return V.chapter_errors(chapters, scenes, segments, entities, mentions).select("chapter_id", "code")


@query("""
with p as (select b.item_id, d.doc_id, instr(d.text, b.text) - 1 as a, length(b.text) as n from benchmark b join documents d on instr(d.text, b.text) > 0 and length(b.text) > 0 and instr(substr(d.text, instr(d.text, b.text) + 1), b.text) = 0),
     o as (select * from p where doc_id % 3 <> 0 and doc_id % 1000 < 800), n as (select *, row_number() over (partition by doc_id, a, a + n order by item_id desc) as nth from o)
select item_id, doc_id, a::int as char_start, (a + n)::int as char_end from n where nth = 1 order by item_id desc, doc_id limit 10
""")
def hit_validation(t):
    """Hits of a knowledge base that our own text confirms, the best ten: their document is known and current, the chapter
    an earlier one, and it says them once (J-19). A hit in each document that says something else is refused."""
    docs = t("documents").select(F.col("doc_id").cast("string").alias("chapter_id"), (F.col("doc_id") % 1000).alias("chapter"), "text", F.md5("text").alias("content_hash"), "doc_id")
    asked = t("benchmark").select("item_id", F.col("text").alias("content"))
    found = S.quote_places(asked.withColumnRenamed("content", "quote"), docs.select("doc_id", "text"), "item_id", "doc_id").join(asked, "item_id").select("item_id", "doc_id", "content")
    hits = found.unionByName(docs.select(F.lit(10**6).cast("long").alias("item_id"), "doc_id", F.lit("said by nobody").alias("content")))
    named = hits.select(F.format_string("%012d", "doc_id").alias("hit_id"), F.col("doc_id").cast("string").alias("knowledge_id"), "content", F.col("item_id").cast("double").alias("score"), "item_id")
    sources = docs.select(F.col("chapter_id").alias("knowledge_id"), "chapter_id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return K.evidence(named, sources, docs.drop("doc_id"), 800).select("item_id", F.col("chapter_id").cast("long").alias("doc_id"), "char_start", "char_end")


@query("""
with x as (select c_custkey, c_mktsegment as name, 'character' as kind from customer), k as (select c_mktsegment as name, min(c_custkey) as id from customer where c_nationkey < 3 and c_mktsegment <> 'MACHINERY' group by c_mktsegment)
select c_custkey, coalesce(id, -length(x.name)) as entity from x left join k on x.name = k.name
""")
def entity_resolution(t):
    """Extracted names to known entities of their type, new ones where there are none (J-18)."""
    found = t("customer").select("c_custkey", F.col("c_mktsegment").alias("name"), F.lit("character").alias("kind"))
    known = t("customer").where("c_nationkey < 3 and c_mktsegment <> 'MACHINERY'").groupBy(F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("id")).withColumn("kind", F.lit("character"))
    return found.join(known, ["kind", "name"], "left").select("c_custkey", F.coalesce("id", -F.length("name")).alias("entity"))


@query("""
with q as (select doc_id, unnest(range(0, length(text), 200))::int as a, length(text) as n from documents), c as (select doc_id, a, least(a + 200, n)::int as b from q),
     s as (select doc_id, a, case when a % 600 = 400 then b - 1 else b end as b from c where a % 1000 <> 800)
select c.doc_id, c.a as char_start, c.b as char_end, s.a is not null as stored from c left join s on c.doc_id = s.doc_id and c.a = s.a and c.b = s.b
""")
def exact_spans(t):
    """Candidates and the stored segments of exactly their span (J-12)."""
    n = F.length("text")
    starts = t("documents").where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(200))).alias("char_start"))
    spans = starts.select("doc_id", "char_start", F.least(F.col("char_start") + 200, F.col("n")).alias("char_end"))
    held = spans.where("char_start % 1000 <> 800").select("doc_id", "char_start", F.expr("case when char_start % 600 = 400 then char_end - 1 else char_end end").alias("char_end"), F.lit(True).alias("stored"))
    return spans.join(held, ["doc_id", "char_start", "char_end"], "left").fillna(False, ["stored"])


WORDS = ["the", "und", "para", "than", "les", "der", "que", "and"]


@query(f"""
with w as (select unnest({WORDS!r}) as name), f as (select doc_id, name, instr(lower(text), name) as pos from documents, w where contains(lower(text), name))
select doc_id, string_agg(name, ',' order by pos, name) as names from (select *, row_number() over (partition by doc_id order by pos, name) as n from f) where n <= 3 group by doc_id
""")
def recalled_entities(t):
    """The first entities, up to a number, whose names occur in a chapter (C-02)."""
    low = F.lower("text")
    places = F.filter(F.array(*[F.struct(F.instr(low, F.lit(w)).alias("at"), F.lit(w).alias("name")) for w in WORDS]), lambda x: x["at"] > 0)
    first = F.slice(F.array_sort(places), 1, 3)
    return t("documents").where(F.size(places) > 0).select("doc_id", F.array_join(F.transform(first, lambda x: x["name"]), ",").alias("names"))


@query("""
with p as (select doc_id, text, point from documents, (values (0), (100), (500), (2000)) v(point) where point < length(text)), h as (select *, substr(text, 1, point) as head, substr(text, point + 1) as tail from p)
select doc_id, point, (case when instr(reverse(head), chr(10)) = 0 then 0 else length(head) - instr(reverse(head), chr(10)) + 1 end)::int as char_start,
       (point + case when instr(tail, chr(10)) = 0 then length(tail) else instr(tail, chr(10)) - 1 end)::int as char_end from h
""")
def reader_jump(t):
    """The line that holds an offset (T-27)."""
    points = t("documents").select("doc_id", "text", F.explode(F.array(*[F.lit(x) for x in (0, 100, 500, 2000)])).alias("point"))
    return points.withColumn("line", X.line_at(F.col("text"), F.col("point"))).where("line is not null").select("doc_id", "point", "line.char_start", "line.char_end")


@query("""
select p_partkey, case when p_retailprice >= 1000 then printf('%.1fK', p_retailprice / 1000) else printf('%d', floor(p_retailprice)::bigint) end as shown, printf('%.1f%%', p_size::double / 50 * 100) as share,
       case when length(p_name) > 8 then substr(p_name, 1, 7) || '…' else p_name end as cut, length(p_name)::int as width,
       case when p_size / 5.0 / pow(10, floor(log10(p_size / 5.0))) <= 1 then 1 when p_size / 5.0 / pow(10, floor(log10(p_size / 5.0))) <= 2 then 2 when p_size / 5.0 / pow(10, floor(log10(p_size / 5.0))) <= 5 then 5 else 10 end
         * pow(10, floor(log10(p_size / 5.0))) as step
from part where p_retailprice < 1000000
""")
def display_formats(t):
    """Numbers, shares, cut names, widths and axis steps as they are shown (F-01, 2.9)."""
    price = F.when(F.col("p_retailprice") >= 1000, F.col("p_retailprice")).otherwise(F.floor("p_retailprice"))
    rows = t("part").where("p_retailprice < 1000000")
    return rows.select("p_partkey", X.compact(price).alias("shown"), X.percent(F.col("p_size") / 50).alias("share"), X.truncated(F.col("p_name"), 8).alias("cut"), X.display_width(F.col("p_name")).alias("width"), X.nice_step(F.col("p_size"), 5).alias("step"))
