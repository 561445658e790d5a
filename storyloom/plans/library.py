"""Relational queries: listings, joins, counts, lookups, histories, maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.operators import facts as K
from storyloom.operators import history as H
from storyloom.operators import maintenance as M
from storyloom.operators import reorder as O
from storyloom.plans.registry import query


@query("""
select r_regionkey, r_name, count(distinct n_nationkey) as n_nations, count(c_custkey) as n_customers
from region left join nation on r_regionkey = n_regionkey left join customer on n_nationkey = c_nationkey
group by r_regionkey, r_name
""")
def library_listing(t):
    """Books with the number of their editions and chapters; books without any keep a zero (J-02, A-01)."""
    per_nation = t("customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"))
    nations = t("nation").join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    per_region = nations.groupBy("n_regionkey").agg(F.count("*").alias("n_nations"), F.sum("n").alias("n"))
    listed = t("region").join(per_region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return listed.select("r_regionkey", "r_name", F.coalesce("n_nations", F.lit(0)).alias("n_nations"), F.coalesce("n", F.lit(0)).alias("n_customers"))


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey = 7")
def edition_with_book(t):
    """One edition with its book; the key filter reaches the scan (J-01, S-15)."""
    return t("nation").where("n_nationkey = 7").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("select p_brand, string_agg(distinct p_type, ',' order by p_type) as aliases, count(*) as n from part group by p_brand")
def known_entities_aliases(t):
    """Entities with their sorted aliases (J-03, A-20)."""
    return t("part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("aliases"), F.count("*").alias("n"))


@query("""
select conv_id, turn, c.role, label, length(text) as chars
from conversations c left join (values ('user', 'Asker'), ('assistant', 'Answerer')) r(role, label) on c.role = r.role
""")
def reader_view(t):
    """Segments with their speakers where there is one (J-04)."""
    turns = t("conversations")
    named = F.when(F.col("role") == "user", "Asker").when(F.col("role") == "assistant", "Answerer")
    return turns.select("conv_id", "turn", "role", named.alias("label"), F.length("text").alias("chars"))


@query("""
select n_name, p_brand, count(*) as n, round(sum(l_extendedprice), 2) as total
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
join part on l_partkey = p_partkey
where o_orderstatus = 'F' and p_size <= 5 group by n_name, p_brand
""")
def mention_fourway(t):
    """Mentions with chapter, source and entity (J-05): filters below the joins, the fact side read once."""
    parts = t("part").where("p_size <= 5").select("p_partkey", "p_brand")
    orders = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    with_orders = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    with_nation = with_orders.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return with_nation.groupBy("n_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""
select o_custkey, o_orderkey, o_orderdate, rank from (
  select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)::int as rank
  from orders where o_orderdate < timestamp '1998-01-01' and o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')) where rank <= 3
""")
def recent_mentions_top3(t):
    """The three latest mentions of each entity before a chapter (W-01, P-03)."""
    asked = t("orders").where("o_orderdate < timestamp_ntz'1998-01-01'").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select("o_custkey", "o_orderkey", "o_orderdate")
    return H.top_per_key(asked, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)


@query("select distinct on (user_id) user_id, event_id, ts, event_type, value from events order by user_id, ts desc, event_id desc")
def latest_run_per_chapter(t):
    """The newest run of each chapter (W-02, A-09)."""
    return H.latest(t("events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], "ts", "event_id")


@query("""
select user_id, event_id, ts from (select user_id, event_id, date_trunc('day', ts) as ts,
  row_number() over (partition by user_id order by date_trunc('day', ts) desc, event_id) as n from events) where n = 1
""")
def latest_run_first_seen(t):
    """Like the newest run, but of runs of one time the one seen first (W-03)."""
    days = t("events").select("user_id", "event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
    return H.first_seen_latest(days, ["user_id"], "ts", "event_id")


@query("""
select o_custkey, o_orderstatus, o_orderkey, rank from (
  select *, row_number() over (partition by o_custkey order by o_orderstatus, o_orderdate desc, o_orderkey)::int as rank from orders) where rank <= 20
""")
def entity_state_cap20(t):
    """At most 20 states of each entity (W-04)."""
    rows = t("orders").select("o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey")
    return H.top_per_key(rows, ["o_custkey"], [F.col("o_orderstatus"), F.desc("o_orderdate"), F.col("o_orderkey")], 20).drop("o_orderdate")


@query("select event_id, user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id)::int as attempt from events")
def run_attempts(t):
    """The attempt number of every run (W-05)."""
    return H.attempts(t("events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


CHANGES = """
with h as (select o_custkey, o_orderkey, o_orderdate, o_orderpriority,
                  lag(o_orderpriority) over w as old_value, row_number() over w as nth
           from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
     c as (select * from h where nth = 1 or old_value is distinct from o_orderpriority),
     s as (select o_custkey, o_orderkey, o_orderdate, o_orderpriority, old_value, lead(o_orderdate) over w as valid_to, lead(o_orderkey) over w as superseded_by
           from c window w as (partition by o_custkey order by o_orderdate, o_orderkey))
"""


def _priority_history(t):
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return H.superseded(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", "o_orderkey", "o_orderdate")


@query(CHANGES + "select * from s")
def scd2_supersede(t):
    """States that change close the one before; repeated values are dropped (W-06)."""
    return _priority_history(t)


@query(CHANGES + """
select as_of, o_custkey, o_orderkey, o_orderpriority from s, (values (timestamp '1994-06-01'), (timestamp '1996-06-01'), (timestamp '1998-06-01')) p(as_of)
where o_orderdate <= as_of and (valid_to is null or as_of < valid_to)
""")
def state_as_of(t):
    """What held at given times, half-open (J-06, J-07, C-03): points carry the key, the interval is a residual."""
    times = F.array(*[F.expr(f"timestamp_ntz'{y}-06-01'") for y in (1994, 1996, 1998)])
    points = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(times).alias("as_of"))
    return H.as_of(_priority_history(t), points, ["o_custkey"], "o_orderdate", "valid_to", "as_of").select("as_of", "o_custkey", "o_orderkey", "o_orderpriority")


@query("""
with n as (select p_type as name, p_partkey % 40 as id from part union all select s_name, s_suppkey from supplier)
select name, case when min(id) = max(id) then min(id) end as id from n group by name
""")
def alias_resolution_unique(t):
    """Names to ids where they stand for one only (J-08)."""
    names = t("part").select(F.col("p_type").alias("name"), (F.col("p_partkey") % 40).alias("id")).unionByName(t("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))
    return H.unique_names(names, "name", "id")


@query("""
select event_id, ts, event_type, c_name from events left join customer on user_id = c_custkey and c_acctbal > 0 where event_type in ('purchase', 'error')
""")
def timeline(t):
    """Events in a book with their actor, where known (J-09)."""
    actors = t("customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    events = t("events").where(F.col("event_type").isin("purchase", "error")).select("event_id", "ts", "event_type", "user_id")
    return events.join(actors, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "ts", "event_type", "c_name")


@query("""
select d.doc_id, sha256(d.text) as content_hash from documents d left join (select doc_id, case when quality = 1 then sha256(text) else 'old' end as h
from labels join documents using (doc_id)) e on d.doc_id = e.doc_id where e.h is distinct from sha256(d.text)
""")
def unindexed_scenes(t):
    """Scenes whose stored hash is missing or stale (J-13, T-22); texts are hashed once and not shuffled."""
    now = t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    stored = t("labels").select("doc_id", "quality")
    joined = now.join(stored, "doc_id", "left")
    h = F.when(F.col("quality") == 1, F.col("content_hash")).when(F.col("quality").isNotNull(), "old")
    return joined.where(~h.eqNullSafe(F.col("content_hash"))).select("doc_id", "content_hash")


RECONCILE = """
with o as (select doc_id as id, source || '#' || (doc_id // 2) as k, md5(text) as h from documents),
     i as (select doc_id as id, source || '#' || (doc_id // 2) as k, md5(case when doc_id % 10 = 0 then text || '!' else text end) as h from documents where doc_id % 7 <> 0
           union all select doc_id + 1000000, source || '#+' || doc_id, md5(text || '+') from documents where doc_id % 20 = 1),
     o1 as (select *, row_number() over (partition by h order by k, id) as n from o),
     i1 as (select *, row_number() over (partition by h order by k, id) as n from i),
     s as (select o1.id as old_id, i1.id as new_id from o1 join i1 on o1.h = i1.h and o1.n = i1.n),
     ol as (select *, count(*) over (partition by k) as c from o1 where id not in (select old_id from s)),
     il as (select *, count(*) over (partition by k) as c from i1 where id not in (select new_id from s)),
     e as (select ol.id as old_id, il.id as new_id from ol join il on ol.k = il.k and ol.c = 1 and il.c = 1)
select old_id, new_id, 'kept' as how from s union all select old_id, new_id, 'edited' from e
union all select id, null, 'removed' from ol where id not in (select old_id from e)
union all select null, id, 'added' from il where id not in (select new_id from e)
"""


@query(RECONCILE)
def chapter_reconcile(t):
    """Re-import: old chapters to new ones by content, then by identity (J-17, D-11). The import of the whole table
    changes each tenth text, leaves out each seventh and brings new ones."""
    docs = t("documents")
    key = F.concat("source", F.lit("#"), F.floor(F.col("doc_id") / 2).cast("string"))
    old = docs.select(F.col("doc_id").alias("id"), key.alias("k"), F.md5("text").alias("h"))
    changed = F.md5(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    kept = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), key.alias("k"), changed.alias("h"))
    added = docs.where("doc_id % 20 = 1").select((F.col("doc_id") + 1000000).alias("id"), F.concat("source", F.lit("#+"), F.col("doc_id").cast("string")).alias("k"), F.md5(F.concat("text", F.lit("+"))).alias("h"))
    return M.matched(old, kept.unionByName(added), "id", "k", "h")


#: The new order of a source's documents: by a hash, so it is any; some are taken out, and their places close up.
_SHUFFLED = "substr(md5(doc_id::varchar), 1, case when doc_id % 3 = 0 then 4 else 0 end)"


@query(f"""
with o as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as old_at, row_number() over (partition by source order by {_SHUFFLED}, doc_id) - 1 as new_at from documents where doc_id % 7 <> 0 and source is not null),
     l as (select source, list(old_at order by new_at) as places from o group by source),
     -- the length of the longest run that ends at each place: one more than that of the smaller ones before it
     n as (select source, places, list_reduce(list_prepend([]::bigint[], list_transform(places, lambda x: [x])),
                  lambda a, x: list_append(a, 1 + coalesce(list_max(list_transform(range(1, len(a) + 1), lambda j: case when places[j] < x[1] then a[j] else 0 end)), 0)::bigint)) as lengths from l),
     k as (select source, places, list_reduce(list_prepend([list_max(lengths)], list_transform(range(len(places), 0, -1), lambda i: [i::bigint])),
                  lambda a, i: case when a[1] > 0 and lengths[i[1]] = a[1] then list_append(list_prepend(a[1] - 1, a[2:]), i[1]) else a end)[2:] as stays from n)
select o.source, doc_id, old_at, new_at, not list_contains(stays, new_at + 1) as moved from o join k on o.source = k.source
""")
def chapter_moves(t):
    """Which chapters a re-import moves: as few as can be, the others keep their order (D-11, J-17)."""
    docs = t("documents").where("doc_id % 7 <> 0 and source is not null").select("source", "doc_id")
    new = F.when(F.col("doc_id") % 3 == 0, F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4)).otherwise("")
    place = lambda *order: (F.row_number().over(Window.partitionBy("source").orderBy(*order)) - 1).cast("long")
    placed = docs.withColumn("new", new).withColumns({"old_at": place("doc_id"), "new_at": place("new", "doc_id")}).drop("new")
    return O.moves(placed, ["source"], "old_at", "new_at")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(t):
    """Keys that occur more than once (A-21, V-03)."""
    return M.duplicate_keys(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders anti join (select * from customer where c_nationkey < 20) c on o_custkey = c_custkey")
def dangling_refs(t):
    """References that lead nowhere (V-04, A-22)."""
    return M.dangling(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", t("customer").where("c_nationkey < 20"), "c_custkey").select("o_orderkey", "o_custkey")


@query("""
select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')
union all select o_orderkey, 'R', 0.0 from orders where o_orderstatus = 'P'
union all select -o_orderkey - 1, 'N', 1.0 from orders where o_orderstatus = 'P' and o_orderkey % 2 = 0
""")
def upsert_merge(t):
    """Insert or replace by key (D-05), then insert only what is new (D-06)."""
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    open_ones = rows.where("o_orderstatus = 'P'")
    written = M.upserted(rows, open_ones.select("o_orderkey", F.lit("R").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")), ["o_orderkey"])
    fresh = open_ones.where("o_orderkey % 2 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return M.inserted_if_new(written, fresh, ["o_orderkey"])


@query("""
with c as (select c_custkey from customer where c_nationkey = 3), o as (select o_orderkey from orders where o_custkey in (select c_custkey from c)),
     l as (select * from lineitem where l_orderkey in (select o_orderkey from o))
select 'customer' as name, (select count(*) from c) as deleted, (select count(*) from customer) - (select count(*) from c) as kept
union all select 'orders', (select count(*) from o), (select count(*) from orders) - (select count(*) from o)
union all select 'lineitem', (select count(*) from l), (select count(*) from lineitem) - (select count(*) from l)
""")
def cascade_delete_counts(t):
    """Deleting a book: what goes and what stays, level by level (D-09, J-15, A-24)."""
    parts = M.cascade(t("nation").where("n_nationkey = 3"), [("customer", t("customer"), "c_nationkey", "n_nationkey"), ("orders", t("orders"), "o_custkey", "c_custkey"), ("lineitem", t("lineitem"), "l_orderkey", "o_orderkey")])
    counted = [gone.agg(F.count("*").alias("deleted")).join(kept.agg(F.count("*").alias("kept"))).select(F.lit(name).alias("name"), "deleted", "kept") for name, (gone, kept) in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""
with f as (select o_orderkey, o_custkey, o_orderdate, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as closed from orders)
select o_orderkey, o_custkey, o_orderdate from f where o_orderdate < timestamp '1997-01-01' and (closed is null or closed >= timestamp '1997-01-01')
order by o_orderdate desc, o_orderkey desc limit 20
""")
def interval_close_resolve(t):
    """Threads open as of a chapter, the newest twenty (C-05, O-02)."""
    closed = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    at = F.expr("timestamp_ntz'1997-01-01'")
    threads = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", closed.alias("closed"))
    still = threads.where((F.col("o_orderdate") < at) & (F.col("closed").isNull() | (F.col("closed") >= at)))
    return still.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).drop("closed")


@query("""
select 'state' as room, o_custkey as entity, o_orderstatus as content, o_orderkey as source_id from orders
union all select 'relation', l_partkey, 'supplied by ' || l_suppkey, l_orderkey from lineitem where l_quantity > 49
union all select 'event', user_id, event_type, event_id from events where event_type = 'purchase'
union all select 'thread', c_custkey, c_mktsegment, c_custkey from customer where c_acctbal < 0
""")
def memory_projection(t):
    """Facts of four kinds as memory items (D-01, D-12): a pure function of the facts, so it can be rebuilt."""
    item = lambda df, room, entity, content, source: df.select(F.lit(room).alias("room"), F.col(entity).cast("long").alias("entity"), content.alias("content"), F.col(source).cast("long").alias("source_id"))
    states = item(t("orders"), "state", "o_custkey", F.col("o_orderstatus"), "o_orderkey")
    relations = item(t("lineitem").where("l_quantity > 49"), "relation", "l_partkey", F.concat(F.lit("supplied by "), F.col("l_suppkey").cast("string")), "l_orderkey")
    events = item(t("events").where("event_type = 'purchase'"), "event", "user_id", F.col("event_type"), "event_id")
    threads = item(t("customer").where("c_acctbal < 0"), "thread", "c_custkey", F.col("c_mktsegment"), "c_custkey")
    return states.unionByName(relations).unionByName(events).unionByName(threads)


AUDIT = """
with h as (select o_orderkey, o_custkey, o_orderdate, sha256(o_orderkey || ':' || o_orderstatus) as h from orders),
     e as (select *, lag(h) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from h),
     stored as (select o_orderkey, o_custkey, o_orderdate, h, case o_orderkey % 5 when 0 then case when o_orderkey % 25 = 0 then null else before end when 1 then case when o_orderkey % 11 = 0 then h else before end else before end as parent from e where o_orderkey % 31 <> 7),
     c as (select o_orderkey, parent, lag(h) over (partition by o_custkey order by o_orderdate, o_orderkey) as expected from stored)
"""


@query(AUDIT + "select o_orderkey, parent, expected from c where parent is distinct from expected")
def audit_chain(t):
    """Audit entries whose stored parent is not the hash of the entry before (J-24, X-12): parents that were lost or
    replaced, and entries after one that was taken out."""
    h = F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_orderstatus")), 256)
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", h.alias("h"))
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    own = F.col("o_orderkey")
    lost, replaced = own % 25 == 0, (own % 5 == 1) & (own % 11 == 0)
    parent = F.when(replaced, F.col("h")).when(~lost, F.col("before"))
    stored = rows.withColumn("before", F.lag("h").over(line)).where(own % 31 != 7).withColumn("parent", parent)
    entries = stored.select("o_orderkey", F.col("o_custkey").alias("chain"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("h").alias("hash"), "parent")
    return K.broken_chain(entries).select("o_orderkey", "parent", "expected")


@query("select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 50")
def ordered_listing(t):
    """Several sort keys and a limit: one bounded top-k (O-01, O-02)."""
    return t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("""
select event_id, event_type, value, case when event_type in ('signup', 'view') then 'resolved' when event_type = 'click' then 'surface_only' else 'unknown' end as state,
       coalesce(case when event_id % 3 = 0 then props end, case when event_id % 2 = 0 then 'even' else 'odd' end) as title,
       value between 20 and 60 as in_range
from events where event_type <> 'error' and value is not null
""")
def predicates_and_cases(t):
    """Ranges, lists, cases and defaults in one scan (P-02, P-04, P-05, P-08, P-11, P-12)."""
    rows = t("events").where("event_type <> 'error' and value is not null")
    state = F.when(F.col("event_type").isin("signup", "view"), "resolved").when(F.col("event_type") == "click", "surface_only").otherwise("unknown")
    title = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("props")), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    return rows.select("event_id", "event_type", "value", state.alias("state"), title.alias("title"), F.col("value").between(20, 60).alias("in_range"))


@query("""
select p_partkey, coalesce(case lower(trim(p_brand)) when 'brand#11' then 'character' when 'brand#12' then 'place' when 'brand#13' then 'item' end, 'none') as kind
from part
""")
def enum_normalisation(t):
    """Synonyms to a closed vocabulary, regardless of case (P-20, P-21)."""
    kinds = F.create_map(*[F.lit(x) for x in ("brand#11", "character", "brand#12", "place", "brand#13", "item")])
    return t("part").select("p_partkey", F.coalesce(kinds[F.lower(F.trim("p_brand"))], F.lit("none")).alias("kind"))


@query("select source, min(doc_id) as doc_id, arg_min(n_chars, doc_id) as n_chars from documents group by source")
def keyed_lookups(t):
    """The first chapter of each book (S-24)."""
    return t("documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))


@query("""
with a as (select o_custkey as id, 'order' as kind, o_orderkey as ref from orders where o_orderstatus = 'P' union all select user_id, 'event', event_id from events where event_type = 'signup')
select id, kind, ref from (select *, row_number() over (partition by id order by kind desc, ref desc) as n from a) where n = 1
""")
def keyed_union_later_wins(t):
    """Union by key in which a later part wins (D-02)."""
    events = t("events").where("event_type = 'signup'").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("ref")).withColumn("kind", F.lit("event"))
    orders = t("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("ref")).withColumn("kind", F.lit("order"))
    return M.merged_later_wins([events, orders], ["id"]).select("id", "kind", "ref")


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders where o_custkey not in (select user_id from events where user_id is not null) group by o_custkey")
def distinct_and_except(t):
    """First occurrence of each key, minus keys already present (D-03, D-04)."""
    firsts = M.distinct_in_order(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
    return M.without(firsts, t("events").select(F.col("user_id").alias("o_custkey")), ["o_custkey"])
