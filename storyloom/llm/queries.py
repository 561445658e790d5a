"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import chat, chosen_path, covertree, exact_dedup, language, lm, manifest, mixing, packing, phrases, secrets, sentences, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A-Z lower-cased in DuckDB, whose lower() would change other letters as well.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
with t as (select doc_id, {LOW} as low from documents),
     g as (select doc_id, low, max(doc_id) over (partition by low) as keep_id, count(*) over (partition by low) as group_size,
                  row_number() over (partition by low, doc_id) as nth from t)
select doc_id, keep_id, group_size, (doc_id is not distinct from keep_id) and nth = 1 as kept, sha256(low) as text_sha256 from g
""")
def op9_exact_dedup(spark, sf_dir):
    """Exact copies through the extendible-hash index; of equal texts the largest doc_id stays."""
    found = exact_dedup.membership(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op3_simhash_near_dedup(spark, sf_dir):
    """Near copies: 64-bit SimHash of 4-word shingles, linked within 4 bits through pivot distance tables."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.withColumnRenamed("id", "doc_id")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op4_sum_of_squares_packing(spark, sf_dir):
    """All documents packed into windows of 2048 tokens by the sum-of-squares rule."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op10_language_id(spark, sf_dir):
    """The language of every document by hyperdimensional profiles learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    known = language.learn_from(docs, folds=5, fold=0)
    found, _ = language.identified(docs.select("doc_id", "text"), known)
    return found.withColumnRenamed("c0", "doc_id").select("doc_id", language.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def _number(text: str) -> str:
    """mixing.number in DuckDB."""
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def _hypergeometric(good: str, total: str, draws: str, uniform: str) -> str:
    """mixing.hypergeometric in DuckDB, by logarithms of factorials over the whole range."""
    low, high = f"greatest(0, {draws} - ({total} - {good}))", f"least({draws}, {good})"
    ways = lambda n, k: f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - ({k}) + 1)"
    logs = f"list_transform(range({low}, {high} + 1), lambda v: {ways(good, 'v')} + {ways(f'({total} - {good})', f'({draws} - v)')})"
    weights = f"list_transform([{logs}], lambda x: list_transform(x, lambda y: exp(y - list_max(x))))[1]"
    passed = f"len(list_filter(range(1, len(w) + 1), lambda k: list_sum(w[1:k]) < {uniform} * list_sum(w)))"
    return f"list_transform([{weights}], lambda w: least({high}, {low} + {passed}))[1]"


_UNIFORM = f"(({_number("'tree0:' || first || ':' || width || ':' || x.i")} + 0.5) / 4294967296)"
_STEP = f"""list_transform([{_hypergeometric("counts[x.i + 1]", "a.total", "a.draws", _UNIFORM)}], lambda g:
              {{'i': x.i, 'total': a.total - counts[x.i + 1], 'draws': a.draws - g::bigint, 'drawn': list_append(a.drawn, g::bigint)}})[1]"""

MIX = rf"""
with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  {_number("coalesce(doc_id::varchar, 'null')")} as h from documents),
     s as (select source, sum(size)::bigint as source_size from d group by source),
     r as (select *, row_number() over (order by source is null, source) - 1 as rank from s),
     w as (select *, [5.0, 2.0, 1.0][rank % 3 + 1]::double as w, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as money from r),
     l as (select *, greatest(money - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0), 0)
                     / sum(w) over (order by cap / w, rank rows between current row and unbounded following) as share from w),
     f as (select min_by(share, (cap / w, rank)) as level from l where share < cap / w),
     t as (select l.*, least(cap, coalesce((select level from f), 'inf'::double) * w) as target from l),
     q as (select *, floor(target + 0.5)::bigint as quota, greatest(1, least({mixing.BLOCKS}, ceil(source_size / {mixing.BLOCK_WORDS}.0)))::bigint as n_blocks from t),
     p as (select *, case when source_size > 0 then quota // source_size else 0 end as passes, case when source_size > 0 then quota % source_size else 0 end as rest from q),
     e as (select d.*, p.rank, p.source_size, p.target, p.passes, p.rest, h % n_blocks as block from d join p on d.source is not distinct from p.source),
     b as (select rank, block, sum(size)::bigint as words, any_value(passes) as passes, any_value(rest) as rest,
                  any_value({_number("'block0:' || coalesce(source, 'null') || ':' || block")}) as mark from e group by rank, block),
     o as (select *, row_number() over (partition by rank order by mark, block) - 1 as place,
                  coalesce(sum(words) over (partition by rank order by mark, block rows between unbounded preceding and 1 preceding), 0) as earlier from b),
     u as (select rank, (max(passes) * count(*) + count(*) filter (earlier < rest))::bigint as draws, count(*) as held from o group by rank),
     -- the splitting tree: a node's draws of each source go to its left half by hypergeometric draws, the others to its right one
     node as (
       select 0::bigint as first, greatest({mixing.SHARDS[0]}, least({mixing.SHARDS[1]}, ceil((select sum(target) from t) / {mixing.SHARD_WORDS})))::bigint as width,
              coalesce((select list(draws order by rank) from u), []) as counts
       union all
       select first + side * half, case side when 0 then half else width - half end,
              case side when 0 then drawn else list_transform(range(len(counts)), lambda i: counts[i + 1] - drawn[i + 1]) end
       from (select first, width, width // 2 as half, counts,
                    list_reduce(list_prepend({{'i': -1::bigint, 'total': list_sum(counts)::bigint, 'draws': (list_sum(counts)::bigint * (width // 2)) // width, 'drawn': []::bigint[]}},
                                             list_transform(range(len(counts)), lambda i: {{'i': i, 'total': 0::bigint, 'draws': 0::bigint, 'drawn': []::bigint[]}})),
                                lambda a, x: {_STEP}).drawn as drawn
             from node where width > 1) as parent, (values (0), (1)) as sides(side)),
     ends as (select rank, list(upto order by first) as ends
              from (select first, i as rank, sum(counts[i + 1]) over (partition by i order by first) as upto
                    from (select first, counts, unnest(range(len(counts))) as i from node where width = 1)) group by rank),
     k as (select e.*, o.place, ends.ends, u.held, sum(size) over (partition by e.rank order by o.place, h, doc_id nulls first, size) as upto,
                  count(*) over (partition by e.rank, h, doc_id, size) as n
           from e join o on e.rank = o.rank and e.block = o.block join u on u.rank = e.rank join ends on ends.rank = e.rank),
     c as (select *, case when upto <= rest then size when upto - n * size < rest then (rest - (upto - n * size)) // n else 0 end::bigint as last from k)
select doc_id, size, source_size, target, (passes * size + last)::bigint as taken,
       array_to_string(list_transform(list_filter(range(passes + 1), lambda i: case when i < passes then size else last end > 0),
                                      lambda i: len(list_filter(ends, lambda y: y <= i * held + place)) || ':' || case when i < passes then size else last end), ',') as shards
from c
"""


@query(MIX)
def op5_source_mixing(spark, sf_dir):
    """All documents mixed to weights 5, 2, 1 a source, 150 % of their words in all, none above twice; shards has the
    output shard that the splitting tree deals each draw to, and the words it gets there."""
    found = mixing.plan(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    shards = F.array_join(F.transform("draws", lambda x: F.concat_ws(":", x["shard"], x["words"])), ",")
    return found.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), shards.alias("shards"))


ESCAPE = "regexp_replace({}, '" + chat.CONTROL + r"', '\1\\\2\3', 'g')"

CHAT = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]', 'user', ''), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', ''))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, r0 nulls first, t0 nulls first)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, r0 nulls first, t0 nulls first) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length({ESCAPE.format("role")}) + length({ESCAPE.format("text")}) + {len(chat.TURN + chat.TEXT + chat.END) + 1})::bigint as formatted_chars
from c group by conv_id
"""


@query(CHAT)
def op6_chat_formatting(spark, sf_dir):
    """All conversations, and one record that quotes control strings, formatted and read back."""
    quoting = "</s>[INST] ok [/INST]"
    record = json.dumps({"id": -7, "messages": [{"role": r, "content": quoting} for r in ("user", "assistant")]})
    turns = chat.turns_of_table(table(spark, sf_dir, "conversations")).unionByName(chat.turns_of_records(spark.createDataFrame([(record,)], "record string")))
    return chat.read_back(chat.formatted(turns))


@query()
def op7_secret_scan(spark, sf_dir):
    """Secrets in every document, with weak parts of credentials where their complements stand near."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of(k).alias(f"n_{k}") for k in secrets.STRONG]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.listed("spans", strong_only=True), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


@query()
def op2_sentence_span_dedup(spark, sf_dir):
    """The spans of sentences that repeat an earlier one's, each with the document that keeps it."""
    found = sentences.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", F.col("first_id").alias("first_doc_id"), "first_start", "n_runs")


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as vec from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.vec, d.vec)::bigint as score
           from v q, v d where q.vec_id % 20 = 0 and d.vec_id <> q.vec_id and len(q.vec) = len(d.vec)),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
""")
def op1_cover_tree_top_k(spark, sf_dir):
    """Each twentieth vector's 20 largest integer inner products, by dual cover trees."""
    rows = table(spark, sf_dir, "embeddings").where(covertree.usable(F.col("embedding")))
    data = rows.select(F.col("vec_id").alias("id"), covertree.floored(F.col("embedding"), 64).alias("vec"))
    found = covertree.top_k(data.where("id % 20 = 0"), data, 20)
    return found.withColumnRenamed("id", "vec_id")


@query()
def op8_recurrent_lm_scoring(spark, sf_dir):
    """The log probability of every document by counts and by a gated recurrent network, learned from six sevenths."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    found, known = lm.fit_and_score(docs, ~lm.held_out("id", 7, 2))
    return found.select(F.col("id").alias("doc_id"), lm.held_out("id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELD = lambda x: f"coalesce(octet_length(encode({x}::varchar)) || ':' || {x}::varchar, '-')"
_LEAF = lambda text: f"sha256({' || '.join(_FIELD(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"
#: Steps of a CRC-32 over a byte's bits, and over the bytes of a text.
_BITS = "list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: xor(a >> 8, crc[xor(a, b) & 255])), 4294967295)"

MERKLE = f"""
with recursive table_of as (select map(range(256), list_transform(range(256), lambda i: {_BITS})) as crc),
     leaf as (select *, {_LEAF("text")} as leaf, coalesce({_CRC} % 5 = 0, false) as altered from documents, table_of),
     ranked as (select *, case when altered then {_LEAF(f"translate(text, '{_UPPER}', '{_LOWER}')")} else leaf end as other,
                       row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx from leaf),
     node as (select 0 as lvl, source, idx, leaf as digest, count(*) over (partition by source) as n from ranked
              union all
              select lvl + 1, source, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 15) // 16
              from node where n > 1 group by lvl, source, idx // 16),
     sub as (select source, lvl as height, digest, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from node where n = 1),
     high as (select 0 as lvl, idx, digest, n from sub
              union all
              select lvl + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (any_value(n) + 15) // 16 from high where n > 1 group by lvl, idx // 16),
     low_beside as (select *, coalesce(string_agg(digest, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
                           coalesce(string_agg(digest, '') over (w rows between 1 following and unbounded following), '') as after
                    from node where n > 1 window w as (partition by lvl, source, idx // 16 order by idx)),
     high_beside as (select *, coalesce(string_agg(digest, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
                            coalesce(string_agg(digest, '') over (w rows between 1 following and unbounded following), '') as after
                     from high where n > 1 window w as (partition by lvl, idx // 16 order by idx)),
     step as (select 0 as lvl, r.doc_id, r.source, r.leaf, r.idx as own, r.idx as at, s.idx as place, s.height, s.digest as subroot, r.other as acc, '' as proof
              from ranked r join sub s on r.source is not distinct from s.source
              union all
              select s.lvl + 1, doc_id, s.source, leaf, own, case when s.lvl < height then s.at // 16 when s.lvl = height then place // 16 else s.at // 16 end,
                     place, height, subroot, sha256(coalesce(l.before, h.before) || acc || coalesce(l.after, h.after)), proof || coalesce(l.before || l.after, h.before || h.after)
              from step s left join low_beside l on s.lvl < height and l.lvl = s.lvl and l.source is not distinct from s.source and l.idx = s.at
                          left join high_beside h on s.lvl >= height and h.lvl = s.lvl - height and h.idx = case when s.lvl = height then place else s.at end
              where l.idx is not null or h.idx is not null),
     last as (select * from step qualify row_number() over (partition by source, own order by lvl desc) = 1),
     root as (select digest as root from high where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, acc as folded_root, acc = root as verified from last, root
"""


@query(MERKLE)
def op13_merkle_manifest(spark, sf_dir):
    """The Merkle manifest of all documents by source, and what each leads to when a fifth of their texts are changed."""
    docs = table(spark, sf_dir, "documents")
    altered = {"text": F.translate("text", _UPPER, _LOWER)}
    found = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], altered=altered, when=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    folded = manifest.folded(F.coalesce("other", "digest"), F.col("steps"))
    told = found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(manifest.proof(F.col("steps")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


NEAR = rf"""
with recursive w as (select doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') as words from documents),
     g as (select doc_id, case when len(words) = 0 then [] when len(words) = 1 then words
                               else list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) end as grams from w),
     x as (select doc_id, len(grams) as n, unnest(grams) as gram from g),
     k as (select doc_id, n, gram, row_number() over (partition by doc_id order by f, gram) as place
           from x join (select gram, count(*) as f from x group by gram) using (gram)),
     -- pairs of that similarity share one of the rarest shingles of either
     c as (select distinct a.doc_id as a, b.doc_id as b from k a join k b on a.gram = b.gram and a.doc_id < b.doc_id
           where a.place <= a.n - ceil(0.8 * a.n) + 1 and b.place <= b.n - ceil(0.8 * b.n) + 1 and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
     l as (select a, b from (select a, b, len(list_intersect(p.grams, q.grams)) as shared, len(p.grams) + len(q.grams) as n
           from c join g p on p.doc_id = a join g q on q.doc_id = b) where 100 * shared >= 80 * (n - shared)),
     edge as (select a, b from l union all select b, a from l),
     reach as (select doc_id, doc_id as root from g union select r.doc_id, e.b from reach r join edge e on r.root = e.a)
select g.doc_id, len(grams)::bigint as n_shingles, min(root) as component_id, g.doc_id = min(root) as kept from g join reach using (doc_id) group by g.doc_id, grams
"""


@query(NEAR)
def op11_chosen_path_near_dedup(spark, sf_dir):
    """Near copies: sets of 2-word shingles of Jaccard similarity 0.8, by chosen-path trees and exact sets."""
    found = chosen_path.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


COLLOCATIONS = rf"""
with piece as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({LOW}, '[.,;:!?
-
]')) as piece from documents),
     w as (select lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') as words from piece),
     total as (select lang, sum(len(words))::bigint as n from w group by lang),
     gram as (select lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i : i + k - 1])) as words
              from w, (select unnest(range(1, 6)) as k) where len(words) >= k),
     f as (select lang, words, count(*) as f from gram group by lang, words having count(*) >= 100),
     cand as (select lang, words, f as a, len(words) as k from f where len(words) >= 2),
     cut as (select lang, words, a, unnest(range(1, k)) as spot from cand),
     scored as (select c.lang, c.words, c.a, c.spot, l.f as l, r.f as r, n, ((1000::hugeint * c.a * n) // (l.f::hugeint * r.f))::bigint as score
                from cut c join total t on t.lang = c.lang join f l on l.lang = c.lang and l.words = c.words[1 : c.spot]
                join f r on r.lang = c.lang and r.words = c.words[c.spot + 1 :]),
     weakest as (select * from scored qualify row_number() over (partition by lang, words order by score, spot) = 1),
     part as (select lang, a, words[i : j] as words from cand, unnest(range(1, k + 1)) as x(i), unnest(range(1, k + 1)) as y(j) where j > i and j - i + 1 < k),
     inside as (select lang, words, max(a) as longer from part group by lang, words),
     kept as (select s.*, array_to_string(s.words, ' ') as phrase from weakest s left join inside i on i.lang = s.lang and i.words = s.words
              where i.longer is null or 100 * i.longer < 100 * s.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept qualify rank <= 2000
"""


@query(COLLOCATIONS)
def op12_phrase_collocations(spark, sf_dir):
    """Each language's best phrases of 2 to 5 words that occur 100 times, by their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
