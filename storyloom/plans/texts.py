"""Text and span queries over the documents, with language-neutral parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import retrieval as R
from storyloom.operators import segmentation as G
from storyloom.operators import spans as S
from storyloom.operators.cells import CellIndex
from storyloom.operators.inverted import BlockIndex, words
from storyloom.plans.registry import query
from storyloom.shared import new_path, numbered

PARAGRAPHS = """
with p as (select doc_id, unnest(string_split(text, chr(10))) as paragraph, generate_subscripts(string_split(text, chr(10)), 1) - 1 as index, length(text) as total from documents),
     o as (select *, coalesce(sum(length(paragraph) + 1) over (partition by doc_id order by index rows between unbounded preceding and 1 preceding), 0)::int as char_start from p)
"""


def _paragraphs(t):
    return S.paragraphs(t("documents").select("doc_id", "text"), ["doc_id"])


@query(PARAGRAPHS + "select doc_id, index::int as index, char_start, char_start + length(paragraph)::int as char_end, paragraph from o")
def paragraph_offsets(t):
    """Paragraphs with their offsets (T-08, W-08), row by row without a shuffle."""
    return _paragraphs(t)


@query("""
with x as (select doc_id, string_split(text, 'the') as parts from documents),
     y as (select doc_id, unnest(parts[:-2]) as part, generate_subscripts(parts[:-2], 1) as n from x)
select doc_id, (sum(length(part) + 3) over (partition by doc_id order by n) - 3)::int as char_start from y
""")
def occurrence_offsets(t):
    """Non-overlapping occurrences of a needle (T-11)."""
    return t("documents").select("doc_id", F.explode(X.occurrences(F.col("text"), F.lit("the"))).alias("char_start"))


NEEDLES = ["heinon", "thation", "ofthe", "the"]


def _mentions_sql() -> str:
    """Longest match from the left, as RE2 alternation takes it: the names in order of length."""
    return f"select doc_id, count(*) as n, sum(length(m)) as chars from (select doc_id, unnest(regexp_extract_all(text, '{'|'.join(sorted(NEEDLES, key=len, reverse=True))}')) as m from documents) group by doc_id"


@query(_mentions_sql())
def mentions_longest_match(t):
    """Mentions of a lexicon, the longest name first on overlap (T-12, X-05, O-06), totalled by document."""
    found = S.mentions(t("documents").select("doc_id", "text"), [(n, n) for n in NEEDLES], ["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("surface")).alias("chars"))


@query("""
with q as (select doc_id, unnest(regexp_extract_all(text, '"[^"\\n]*"')) as quote from documents)
select doc_id, count(*) as n, sum(length(quote)) as chars from q group by doc_id
""")
def quotes_closed(t):
    """Closed quotations within a line (T-09's closed part)."""
    found = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('"[^"\\n]*"'), F.lit(0))).alias("quote"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("quote")).alias("chars"))


@query(PARAGRAPHS + """
select doc_id, place as point, index::int as index from o, (values (0), (100), (500), (2000)) v(place)
where char_start <= place and place < char_start + length(paragraph)
""")
def segment_containing_offset(t):
    """The paragraph that holds an offset (J-10, T-16): equality on the document, the range as a residual."""
    points = t("documents").select("doc_id", F.explode(F.array(*[F.lit(x) for x in (0, 100, 500, 2000)])).alias("point"))
    return S.at_offset(_paragraphs(t).drop("paragraph"), points, ["doc_id"], "point").select("doc_id", "point", "index")


@query(PARAGRAPHS + """
, s as (select doc_id, unnest(range(0, greatest(total, 1), 500))::int as s_start, total from (select distinct doc_id, total from o))
select o.doc_id, index::int as index, greatest(char_start, s_start)::int as char_start, least(char_start + length(paragraph), least(s_start + 500, s.total))::int as char_end
from o join s on o.doc_id = s.doc_id where greatest(char_start, s_start) < least(char_start + length(paragraph), least(s_start + 500, s.total))
""")
def span_overlap_split(t):
    """Paragraphs cut at the bounds of scenes (J-11, T-17)."""
    length = F.length("text")
    scenes = t("documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(500))).alias("s_start"), length.alias("n"))
    scenes = scenes.select("doc_id", "s_start", F.least(F.col("s_start") + 500, F.col("n")).alias("s_end"))
    return S.overlaps(_paragraphs(t).drop("paragraph"), scenes, ["doc_id"])


@query("""
select doc_id, length(text)::bigint as covered, len(regexp_extract_all(text, '"[^"\\n]*"'))::bigint as dialogues from documents where length(text) > 0
""")
def segments_full_cover(t):
    """Quotes and the narration between them cover every document exactly (T-19, V-02), in the row: no shuffle."""
    spoken = X.matches(F.col("text"), '"[^"\\n]*"')
    held = t("documents").where("length(text) > 0").select("doc_id", S.cover(spoken, F.length("text")).alias("cover"))
    covered = F.aggregate("cover", F.lit(0).cast("long"), lambda a, x: a + x["char_end"] - x["char_start"])
    return held.select("doc_id", covered.alias("covered"), F.size(F.filter("cover", lambda x: x["kind"] == "dialogue")).cast("long").alias("dialogues"))


@query(PARAGRAPHS + """
select doc_id, 'IR-SEG-COVER' as code, index::int as index, 'gap or overlap' as message from (
  select *, lag(case when index % 37 = 36 then char_start + length(paragraph) else char_start + length(paragraph) + 1 end, 1, 0) over (partition by doc_id order by index) as expected from o) x
where expected <> char_start and length(paragraph) >= 0
""")
def ir_contiguity(t):
    """Where spans fail to tile a document (V-02, W-09); every 37th is made one too short."""
    spans = _paragraphs(t).select("doc_id", "index", "char_start", F.when(F.col("index") % 37 == 36, F.col("char_end")).otherwise(F.col("char_end") + 1).alias("char_end"))
    ends = spans.groupBy("doc_id").agg(F.max("char_end").alias("total"))
    return S.partition_errors(spans.join(ends, "doc_id"), ["doc_id"], F.col("total"), "IR-SEG-COVER")


@query("""
select b.item_id, d.doc_id, (instr(d.text, b.text) - 1)::int as char_start from benchmark b, documents d
where instr(d.text, b.text) > 0 and length(b.text) > 0 and instr(substr(d.text, instr(d.text, b.text) + 1), b.text) = 0
""")
def evidence_unique_locate(t):
    """Quotes, whole, that stand in a chapter exactly once (T-13, T-14, J-23)."""
    return S.quote_places(t("benchmark").select("item_id", F.col("text").alias("quote")), t("documents").select("doc_id", "text"), "item_id", "doc_id")


@query("select doc_id, (2 * length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))::int as tokens from documents")
def token_estimate(t):
    """An upper bound of tokens by character (T-24)."""
    return t("documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("select doc_id, sha256(text) as h, substr(text, greatest(200 - 180, 0) + 1, 20 + 180 + (200 - greatest(200 - 180, 0))) as excerpt from documents")
def hash_and_excerpt(t):
    """Content hashes and excerpts around a span (T-21, T-22)."""
    return t("documents").select("doc_id", X.content_hash(F.col("text")).alias("h"), X.excerpt(F.col("text"), F.lit(200), F.lit(220), 180).alias("excerpt"))


@query("""
select vec_id, label, round(similarity, 6) as similarity from (
  select e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as similarity
  from embeddings e, (select embedding from embeddings where vec_id = 7) q where e.label in (1, 2, 3)) order by similarity desc, vec_id limit 10
""")
def vector_topk(t):
    """The ten scenes closest to a query vector within some books (O-03, C-06, P-19)."""
    scenes = t("embeddings").select("vec_id", "label", "embedding")
    asked = scenes.where("vec_id = 7 and embedding is not null").select("embedding").first()
    found = R.vector_top_k(scenes.where(F.col("label").isin(1, 2, 3)), list(asked[0]) if asked else [], 10, ["vec_id"])
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""
select doc_id, (contains(lower(text), 'than')::int + contains(lower(text), 'para')::int + contains(lower(text), 'und')::int + contains(lower(text), 'mentent')::int) as score
from documents where score > 0 order by score desc, doc_id limit 25
""")
def keyword_recall(t):
    """Items by how many of the terms they hold (O-04, C-04)."""
    return R.keyword_top_k(t("documents").select("doc_id", "text"), ["than", "para", "und", "mentent"], 25, "doc_id", "text").select("doc_id", "score")


TERMS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"


@query(f"""
with d as (select doc_id, unnest({TERMS.format("text")}) as term from documents),
     w as (select term, length(bin((select count(*) from documents) // count(*))) as weight from d group by term),
     q as (select item_id, unnest({TERMS.format("text")}) as term from benchmark),
     s as (select item_id, doc_id, sum(weight)::bigint as score from q join d using (term) join w using (term) group by item_id, doc_id)
select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s qualify rank <= 5
""")
def indexed_recall(t):
    """The five documents that share most with each quote, rare words counting more: many queries at once through an
    inverted index with block maxima (O-04, C-02, C-04). Half of the documents are appended to the index later."""
    docs = t("documents").select("doc_id", "text")
    held = BlockIndex(docs.sparkSession, new_path(docs.sparkSession, "index"))
    half = docs.agg(F.expr("max(doc_id) div 2")).first()[0] or 0
    held.append(docs.where(F.col("doc_id") <= half), "doc_id", "text")
    held.append(docs.where(F.col("doc_id") > half), "doc_id", "text")
    hits, _ = held.search(t("benchmark").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("terms")), 5, weighted=True)
    return hits.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("doc_id"), "score", "rank")


@query("""
with s as (select q.vec_id as query_id, e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as similarity from embeddings q, embeddings e)
select query_id, row_number() over (partition by query_id order by similarity desc, vec_id)::int as rank, vec_id, label, round(similarity, 6) as similarity from s qualify rank <= 5
""")
def cell_search(t):
    """The five scenes closest to each scene, all in one job through vector cells with exact bounds (O-03, C-06, J-20)."""
    scenes = t("embeddings").select("vec_id", "label", "embedding")
    size = scenes.agg(F.max(F.size("embedding"))).first()[0]
    held = CellIndex(scenes.sparkSession, new_path(scenes.sparkSession, "cells"), size)
    held.build(scenes)
    hits, _ = held.search(scenes.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5, ["vec_id"])
    return hits.select("query_id", "rank", "vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(r"""
with r as (select unnest(regexp_extract_all(lower(text), '[\p{L}]+')) as run from documents),
     p as (select run, unnest(range(1, 4)) as n from r),
     g as (select n, run, unnest(range(1, len(run) - n + 2)) as i from p where len(run) >= n),
     x as (select n, substr(run, i, n) as gram, case when i > 1 then substr(run, i - 1, 1) end as before, case when i + n <= len(run) then substr(run, i + n, 1) end as after from g),
     c as (select n, gram, count(*) as f from x group by n, gram),
     k as (select gram, f, n from c where n > 1 and f >= 500),
     cut as (select gram, f, unnest(range(1, n)) as j from k),
     s as (select cut.gram, min(ln(cut.f * (select sum(f) from c where n = 1)::double / (a.f * b.f))) as cohesion from cut
           join c a on a.gram = substr(cut.gram, 1, j) and a.f >= 500 join c b on b.gram = substr(cut.gram, j + 1) and b.f >= 500 group by cut.gram),
     e as (select gram, side, sum(m) as n, sum(case when ch is null then 0 else m * ln(m) end) as t
           from (select gram, side, ch, count(*) as m from (select gram, 'before' as side, before as ch from x union all select gram, 'after', after from x) group by gram, side, ch) group by gram, side)
select k.gram, k.f as n, round(cohesion, 6) + 0.0 as cohesion, round(ln(b.n) - b.t / b.n, 6) + 0.0 as free_before, round(ln(a.n) - a.t / a.n, 6) + 0.0 as free_after
from k join s using (gram) join e b on b.gram = k.gram and b.side = 'before' join e a on a.gram = k.gram and a.side = 'after'
""")
def ngram_statistics(t):
    """How well letters hold together and how free their neighbours are: what a lexicon is learned from (T-25)."""
    found = G.statistics(t("documents").select("text"), pattern=r"\p{L}+", longest=3, least=500)
    return found.select("gram", "n", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("cohesion", "free_before", "free_after")])


@query("""
with recursive p as (select source, doc_id, n_chars as cost, row_number() over (partition by source order by doc_id) as n from documents),
     f as (select source, 0::bigint as n, 0::bigint as used, -1::bigint as kept from (select distinct source from documents)
           union all select f.source, p.n, case when f.used + p.cost <= 9000 then f.used + p.cost else f.used end, case when f.used + p.cost <= 9000 then p.doc_id else -1 end
           from f join p on p.source = f.source and p.n = f.n + 1)
select source, kept as doc_id from f where kept >= 0
""")
def context_budget_pack(t):
    """Items kept in order while they fit a budget; too large ones are skipped, later ones tried (W-11, C-01)."""
    items = t("documents").select("source", "doc_id", "n_chars")
    return S.fitted(items, ["source"], ["doc_id"], "n_chars", 9000).select("source", "doc_id")


@query("""
with c as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as rn, count(*) over (partition by source) as n from documents)
select source, doc_id from c where rn in (select floor((i + 0.5) * c.n / 5) from range(5) r(i))
""")
def gold_sample(t):
    """A fixed number of rows from each stratum, evenly spread (T-26): numbered by range, whatever the strata's sizes."""
    rows = t("documents").select("source", "doc_id", F.struct("source", "doc_id").alias("place"))
    placed = numbered(rows, "place", "rn")
    strata = placed.groupBy(F.col("source").alias("stratum")).agg(F.min("rn").alias("first"), F.count("*").alias("n"))
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor((i + 0.5) * F.col("n") / 5) + F.col("first"))
    return placed.join(strata, F.col("source").eqNullSafe(F.col("stratum"))).where(F.array_contains(picks, F.col("rn").cast("long"))).select("source", "doc_id")


@query("select doc_id, length(text)::int as n_chars, strlen(text) as n_bytes, lower(substr(text, 1, 5)) as head, length(trim(text))::int as trimmed from documents")
def text_scalars(t):
    """Lengths, slices and trims (2.9)."""
    c = F.col("text")
    return t("documents").select("doc_id", F.length(c).alias("n_chars"), F.octet_length(c).cast("long").alias("n_bytes"), F.lower(F.substring(c, 1, 5)).alias("head"), F.length(X.trimmed(c)).alias("trimmed"))
