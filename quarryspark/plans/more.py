"""More registered queries: lookups, upkeep, policies, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..operators import answer as A
from ..operators import evaluate as E
from ..operators import judge as J
from ..operators import retrieval as R
from ..operators import store as S
from ..operators.index import Index
from ..sources import robots
from . import oracle as O
from . import search as P
from .catalog import _GOLD, _ID, _LIMIT, _PAGE_HOST, _PATH, _TEXTS, _VERDICT, _chunks, _document_chunks, query

# Lookups and upkeep.


@query("select doc_id, lang, source, n_chars from documents where doc_id in (select item_id from benchmark)")
def get_docs(t):
    return S.get(t.documents.select("doc_id", "lang", "source", "n_chars"), t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id")


@query(f"with {_TEXTS} select {_ID} as id, doc_id::varchar as url, ord from cc where doc_id in (select item_id from benchmark)")
def chunks_of(t):
    return S.chunks_of(_document_chunks(t).select("id", "url", "ord"), t.benchmark.select(F.col("item_id").cast("string").alias("url")))


@query("select doc_id as id, case when vec_id is not null then [label] else [-1] end[1]::int as first from documents left join embeddings on vec_id = doc_id")
def set_vectors(t):
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.array(F.lit(-1)).alias("vector"))
    return S.set_vectors(chunks, t.embeddings.select(F.col("vec_id").alias("id"), F.array(F.col("label").cast("int")).alias("vector"))).select("id", F.col("vector")[0].alias("first"))


@query("select count(*) as chunks, count(vec_id) as vectors, count(vec_id) > 0 as has_vectors from documents left join embeddings on vec_id = doc_id")
def vector_counts(t):
    return S.vector_counts(t.documents.select("doc_id").join(t.vectors, "doc_id", "left"))


@query("with m as (select doc_id, row_number() over (order by doc_id) r from labels where toxic = 1) select d.doc_id as id, case when r <= 20 then length(source) + 1 + length(text) when l.toxic = 1 then null else -1 end::int as first from documents d left join labels l using (doc_id) left join m using (doc_id)")
def embed_missing(t):
    chunks = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.array("source").alias("heading_path"), "text", F.when(F.coalesce(F.col("toxic"), F.lit(0)) != 1, F.array(F.lit(-1))).alias("vector"))
    return S.embed_missing(chunks, lambda rows: rows.select("id", F.array(F.length("text")).alias("vector")), 20).select("id", F.col("vector")[0].alias("first"))


@query("select doc_id as url, case when l.doc_id is null then 1 else 2 end as fetched_at, case when l.doc_id is null then 0 else 1 end as stale from documents d left join (select distinct doc_id from labels) l using (doc_id)")
def touch_docs(t):
    docs = t.documents.select(F.col("doc_id").alias("url"), F.lit(1).alias("fetched_at"), F.lit(0).alias("stale"))
    return S.touched(docs, t.labels.select(F.col("doc_id").alias("url")), F.lit(2))


@query("select doc_id from labels where toxic = 0 or quality = 1")
def stale_guard(t):
    return S.fresh_enough(t.labels.select("doc_id", F.col("toxic").alias("stale"), F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"))).select("doc_id")


@query("select 'p' || page_id as from_url, 'p' || (case when page_id in (select doc_id from labels) then page_id + 7 when page_id > 1 then page_id // 2 else 1 - page_id end) as to_url from pages")
def alias_upsert(t):
    known = t.aliases.withColumn("seen_at", F.lit(1))
    ids = t.labels.join(t.pages.select(F.col("page_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id").distinct()
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    seen = ids.select(name(F.col("doc_id")).alias("from_url"), F.explode(F.array(F.struct(name(F.col("doc_id") + 3).alias("to"), F.lit(2).alias("at")), F.struct(name(F.col("doc_id") + 7).alias("to"), F.lit(3).alias("at")), F.struct(name(F.col("doc_id")).alias("to"), F.lit(4).alias("at")))).alias("x"))
    return S.upsert_aliases(known, seen.select("from_url", F.col("x.to").alias("to_url"), F.col("x.at").alias("seen_at"))).select("from_url", "to_url")


@query("select page_id, left(html, 500) as head from pages")
def capped_bodies(t):
    return t.pages.select("page_id", S.capped(F.col("html"), 500).alias("head"))


@query(f"with l as ({_LIMIT.replace('select key, id, used <= 3 as allowed', 'select key, id, n, start, used <= 3 as allowed')}), z as (select key, arg_max(start, n) s, max(n) m, arg_max(used, n) u from l group by 1) select key, u < 3 as allowed, greatest(0, 3 - u)::int as remaining, greatest(1, ceil(greatest(0, s + 21600000 - 1706659200000) / 1e3))::bigint as reset_seconds from z")
def limiter_peek(t):
    rows = t.events.select(F.col("user_id").alias("key"), S.millis(F.col("ts")).alias("t_ms"), F.col("event_id").alias("id"))
    taken = S.rate_limit(rows, 3, 6 * 3600 * 1000).join(rows, ["key", "id"])
    last = taken.groupBy("key").agg(F.max(F.struct("t_ms", "id", "used")).alias("x"))
    first = taken.where("used = 1").groupBy("key").agg(F.max("t_ms").alias("start_ms"))  # the last window's first request
    state = last.select("key", F.col("x.used").alias("used")).join(first, "key")
    return S.limiter_state(state, 3, 6 * 3600 * 1000, 1706659200000)


# Scope, sitemaps, robots.


@query(f"select page_id, regexp_matches(url, '(?i)^https?://[^/?#]') and ends_with({_PAGE_HOST}, 'example.org') and {_PAGE_HOST} = 'example.org' and starts_with(case when {_PATH} = '' then '/' else {_PATH} end, '/en/') as inside, regexp_matches(url, '(?i)^https?://[^/?#]') and {_PAGE_HOST} = (select max({_PAGE_HOST}) from pages) as same_host from pages")
def in_scope(t):
    top = t.pages.agg(F.max(U.host(F.col("url"))).alias("h"))
    rows = t.pages.crossJoin(F.broadcast(top))  # one row
    return rows.select("page_id", U.in_scope(F.col("url"), F.lit("https://example.org/x"), F.lit("/en/")).alias("inside"), U.in_scope(F.col("url"), F.concat(F.lit("https://"), "h"), F.lit(None).cast("string")).alias("same_host"))


@query("with p as (select page_id, 'https://m.org/' || page_id u from pages), c as (select page_id r, unnest(range(page_id + 1, page_id + 13)) c, generate_subscripts(range(page_id + 1, page_id + 13), 1) i from p where page_id % 10 = 0), k as (select r, c from c where i <= 10), a as (select r, c from k union all select k.r, e.c from k join k e on e.r = k.c), b as (select r, c from a where c % 10 <> 0 union all select page_id, page_id from p where page_id % 10 <> 0), n as (select r, c from k where c % 10 = 0), d2 as (select k.r, e.c from k join k e on e.r = k.c where e.c % 10 <> 0), f as (select r, c from k where c % 10 <> 0 union all select * from d2 union all select page_id, page_id from p where page_id % 10 <> 0) select 'https://m.org/' || r as root, 'https://m.org/' || c || '/a' as loc from f where c in (select page_id from pages)")
def read_sitemaps(t):
    name = lambda x: F.concat(F.lit("https://m.org/"), x.cast("string"))
    locs = F.concat_ws("", F.transform(F.sequence(F.col("page_id") + 1, F.col("page_id") + 12), lambda i: F.concat(F.lit("<loc>"), name(i), F.lit("</loc>"))))
    body = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("<sitemapindex>"), locs)).otherwise(F.concat(F.lit("<urlset><loc> "), name(F.col("page_id")), F.lit("/a</loc><loc>ftp://x</loc>")))
    bodies = t.pages.select(name(F.col("page_id")).alias("url"), body.alias("body"))
    return robots.read_sitemaps(bodies.select("url"), bodies)


@query("select user_id as host, max(case when event_type = 'error' then 500 else 200 end)::int as status, case when max(case when event_type = 'error' then 500 else 200 end) = 200 or user_id in (select item_id from benchmark) then 'old' else '' end as body from (select user_id, event_type from events where user_id in (select item_id from benchmark) union all select user_id, event_type from events) group by 1".replace("max(case when event_type = 'error' then 500 else 200 end)::int as status", "case when user_id in (select item_id from benchmark) then 200 else max(case when event_type = 'error' then 500 else 200 end) end::int as status"))
def robots_cache(t):
    known = t.benchmark.select(F.col("item_id").alias("host")).join(t.events.select(F.col("user_id").alias("host")).distinct(), "host", "left_semi").select("host", F.lit(200).alias("status"), F.lit("old").alias("body"), F.lit(50).alias("fetched_ms"))
    got = t.events.groupBy(F.col("user_id").alias("host")).agg(F.max(F.when(F.col("event_type") == "error", 500).otherwise(200)).alias("status")).select("host", "status", F.lit("old").alias("body"), F.lit(60).alias("fetched_ms"))
    return robots.policies(known, got, 100, 60).select("host", "status", "body")


# Queries and terms.


@query(r"select item_id, array_to_string(case when lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(left(text, 300), '\s+', ' ', 'g'))) then [trim(text)] else [trim(text), trim(left(text, 300))] end || ['variant ' || item_id], '|') as asked from benchmark")
def query_variants(t):
    x = F.col("text")
    given = F.array(F.lit("no"), F.substring(x, 1, 300), F.upper(x), F.concat(F.lit("  variant "), "item_id", F.lit(" ")), F.concat(F.lit("Variant "), "item_id"))
    short = F.filter(given, lambda v: F.length(v) <= 300)
    return t.benchmark.select("item_id", F.concat_ws("|", T.query_variants(x, F.filter(short, lambda v: v != F.upper(x)), 4)).alias("asked"))


_TERMS = f"list_distinct(list_filter(list_transform(regexp_extract_all(text, '(\\p{{L}}[\\p{{L}}\\p{{M}}\\p{{N}}''’-]*|\\p{{N}}+)', 1), lambda w: {O.fold('w')}), lambda w: length(w) > 3 and w not in {O.STOP}))"


@query(f"select doc_id, unnest({_TERMS}) as term from documents")
def content_terms(t):
    return t.documents.select("doc_id", F.explode(T.content_terms(F.col("text"))).alias("term"))


_SHARED = f"q as (select item_id, unnest({_TERMS}) term from benchmark), d as (select doc_id, unnest({_TERMS}) term from documents)"


@query(f"with {_SHARED}, s as (select item_id, doc_id, count(*) shared from q join d using (term) group by 1, 2), r as (select *, row_number() over (partition by item_id order by shared desc, doc_id)::int rank from s) select item_id, doc_id, shared, rank from r where rank <= 3")
def locate_answers(t):
    return E.locate(t.benchmark, t.documents)


@query(f"with {_SHARED}, s as (select item_id, count(distinct doc_id) n from q join d using (term) group by 1) select item_id, coalesce(n, 0) as n from benchmark left join s using (item_id)")
def fact_prefilter(t):
    return E.may_state(t.benchmark, t.documents)


# An index of titles, headings and text; scores of all documents; dense search among candidates.

_TITLED = O.BM25.replace(O.KEPT, O.KEPT.replace("string_split_regex(text,", "string_split_regex(source || chr(10) || source || ' > ' || lang || chr(10) || text,"))


@query(f"with {_TITLED} select item_id, doc_id, score, rank::int as rank from lex where rank <= 10")
def bm25_titled(t):
    docs = t.documents.select("doc_id", F.col("source").alias("title"), F.array("source", "lang").alias("heading_path"), "text")
    return Index.build(docs, simhash=False, queries=t.benchmark).bm25(t.benchmark, 10)


@query(f"with {_TEXTS}, documents as (select ord * 10000000 + doc_id as doc_id, source || chr(10) || source || chr(10) || chunk as text from cc join documents using (doc_id)), {O.BM25} select item_id, doc_id, score, rank::int as rank from lex where rank <= 10".replace("with s as", "with s as", 1))
def bm25_chunks(t):
    chunks = _document_chunks(t).join(t.documents.select(F.col("doc_id").cast("string").alias("url"), F.col("source").alias("title")), "url")
    return Index.build(chunks.select((F.col("ord") * 10_000_000 + F.col("url").cast("long")).alias("doc_id"), "title", "heading_path", "text"), simhash=False, queries=t.benchmark).bm25(t.benchmark, 10)


@query(f"with {O.BM25} select item_id, count(*) as n, max(score) as best, {O.half_up('sum(score)', 2)} as total from bm group by 1")
def score_all(t):
    return t.asked.totals(t.benchmark).withColumn("total", T.round_half_up(F.col("total"), 2))


@query(f"with {O.DENSE.replace('embeddings e)', '(select * from embeddings where vec_id in (select doc_id from labels)) e)')} select item_id, doc_id, score, rank::int as rank from den where rank <= 10")
def dense_candidates(t):
    asked = t.benchmark.select("item_id").join(t.vectors.select(F.col("doc_id").alias("item_id"), "vector"), "item_id")
    return R.dense(asked, t.vectors.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi"), 10)


# Judgement under both policies.


@query(f"with {O.RERANK} select item_id, doc_id, row_number() over (partition by item_id order by composite desc, channels desc, fused desc, doc_id)::int as place from rr join (select item_id, doc_id, fused from fr) using (item_id, doc_id)")
def rerank_order(t):
    return t.judged.select("item_id", "doc_id", F.row_number().over(Window.partitionBy("item_id").orderBy(*J.rerank_order())).alias("place"))


@query(f"with {O.RERANK} select item_id, doc_id, array_to_string(list_filter([case when relevance < 0.4e0 then 'relevance' end, case when authority < 0.3e0 then 'authority' end, case when quality < 0.35e0 then 'quality' end, case when \"constraint\" < 0.4e0 then 'constraint' end, case when channels > 1 then 'both_channels' end], lambda x: x is not null), ',') as reasons from rr")
def rerank_reasons(t):
    return J.reasons(t.judged).select("item_id", "doc_id", F.concat_ws(",", "reasons").alias("reasons"))


_CALIBRATED = (
    O.GATE.replace("relevance * 0.56e0 + authority * 0.1e0 + quality * 0.1e0 + directness * 0.06e0 + recency * 0.02e0", "relevance * 0.5e0 + authority * 0.14e0 + quality * 0.12e0 + directness * 0.08e0 + recency * 0.025e0")
    .replace('"constraint" * 0.1e0 -', '"constraint" * 0.06e0 -').replace("raw >= 0.4e0 keep", "raw >= 0.34e0 keep")
    .replace("g_injection > 0.5e0", "g_injection > 0.7e0").replace("g_advertisement > 0.7e0", "g_advertisement > 0.85e0").replace("g_contradicts > 0.7e0", "g_contradicts > 0.75e0").replace("g_relevant < 0.45e0", "g_relevant < 0.35e0").replace("g_evidence < 0.55e0", "g_evidence < 0.45e0")
)


@query(f"with {_CALIBRATED} select item_id, doc_id, composite, keep, route from ga")
def calibrated_gate(t):
    return P.judged(t.benchmark, t.pool, t.candidates, J.CALIBRATED).select("item_id", "doc_id", "composite", "keep", "route")


@query(f"with {O.GATE}, p as (select item_id, doc_id, route, row_number() over (partition by item_id, route order by composite desc, doc_id) r from ga) select item_id, doc_id, route from p where route <> 'include' or r <= 2")
def include_limit(t):
    return J.include_limit(t.judged, 2).select("item_id", "doc_id", "route")


@query(f"with {O.GATE} select item_id, doc_id from ga where route <> 'exclude' and channels > 1")
def route_check(t):
    flawed = t.judged.withColumn("route", F.when(F.col("channels") > 1, "exclude").otherwise(F.col("route")))
    return J.inconsistent(flawed).select("item_id", "doc_id")


@query(f"with {O.PAGE}, n as (select item_id, count(*) n from pg where position <= 10 group by 1) select item_id, coalesce(n, 0) as n_results, n is null as abstained, case when n is null then 'no_candidates' end as reason from benchmark left join n using (item_id)")
def empty_outcome(t):
    return P.outcomes(t.benchmark, P.page(t.judged))


@query(f"{_VERDICT.replace('select item_id, n, domains, sufficient', 'select item_id, cov, n, domains, sufficient', 1)}".replace("select item_id, cov, n, domains", "select item_id, n, domains") .replace("case when n = 0 then 'no_evidence'", "case when item_id in (select doc_id from labels where toxic = 1) then 'cancelled' when item_id in (select doc_id from labels) then 'decision_engine_unavailable' when n = 0 then 'no_evidence'"))
def abstain_order(t):
    marks = t.labels.select(F.col("doc_id").alias("item_id"), "toxic")
    return J.verdicts(P.page(t.judged, 10**6), t.benchmark, degraded=marks, cancelled=marks.where("toxic = 1"))


# Claims with sources, repaired.

_SAID = "c as (select conv_id, turn, text claim, lag(text) over w source, lag(turn) over w before, role from conversations window w as (partition by conv_id order by turn, role, text)), a as (select * from c where role = 'assistant' and source is not null)"
_CHECKED = f"{_SAID}, k as (select conv_id, turn, before, source, claim, {O.content_words('claim')} q, {O.content_words('source')} d from a), v as (select conv_id, turn, before, claim, case when turn % 4 = 3 then 0e0 else {O.half_up('0.12e0 + 0.85e0 * ' + O.affinity('q', 'd', 'source'))} end support from k)"


def _verified(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = t.conversations.withColumns({"source": F.lag("text").over(w), "before": F.lag("turn").over(w)}).where("role = 'assistant' and source is not null")
    rows = rows.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("n"), F.col("text").alias("claim"), F.col("source").alias("text"), F.col("before").cast("long").alias("doc_id"))
    evidence = rows.select("item_id", "doc_id", "text").distinct()
    claims = rows.select("item_id", "n", "claim", F.when(F.col("n") % 4 == 3, F.array(F.lit(-1).cast("long"), "doc_id")).otherwise(F.array("doc_id")).alias("sources"))
    return A.verified(claims, evidence, 0.3), evidence


@query(f"with {_CHECKED} select conv_id as item_id, turn as n, support, support >= 0.3e0 and turn % 4 <> 3 as kept from v")
def claims_verified(t):
    return _verified(t)[0].select("item_id", "n", "support", "kept")


@query(f"with {_CHECKED}, g as (select conv_id, count(*) filter (where support >= 0.3e0 and turn % 4 <> 3) k, count(*) n from v group by 1) select conv_id as item_id, k as n_kept, n - k as n_dropped, n > k and k > 0 as rewritten, case when n = k then 'said' when k > 0 then 'again ' || (select count(distinct before) from v where v.conv_id = g.conv_id and support >= 0.3e0 and turn % 4 <> 3) else 'said' || chr(10) || chr(10) || '(' || (n - k) || ' of its claims had no support in their source and were left out.)' end as answer from g")
def claims_repaired(t):
    found, evidence = _verified(t)
    written = found.select("item_id", F.lit("said").alias("answer")).distinct()
    writer = lambda rows: rows.groupBy("item_id").agg(F.concat(F.lit("again "), F.countDistinct("doc_id").cast("string")).alias("answer"))
    return A.repaired(written, found, evidence, writer)


@query(f"with {_CHECKED} select conv_id as item_id, turn as n, before::bigint as doc_id, support, 1e0 as confidence, true as verified from v where support >= 0.3e0 and turn % 4 <> 3")
def citations(t):
    return A.citations(_verified(t)[0]).drop("quote")


# Evaluation.


@query("select event_type, sum(event_id)::bigint as input_tokens, sum(user_id)::bigint as output_tokens, count(*) as requests, round(sum(value) filter (where event_type <> 'view'), 2) as cost_usd from events group by 1")
def usage_rollup(t):
    rows = t.events.select("event_type", F.col("event_id").alias("input_tokens"), F.col("user_id").cast("long").alias("output_tokens"), F.lit(1).alias("requests"), F.when(F.col("event_type") != "view", F.col("value")).alias("cost_usd"))
    return E.usage(rows, "event_type").withColumn("cost_usd", F.round("cost_usd", 2))


@query("select min(value) as min_value, max(value) as max_value, min(user_id) as min_user_id, max(user_id) as max_user_id from events")
def pass_spread(t):
    return E.spread_of_passes(t.events, "value", "user_id")


@query("select o_orderpriority as reason, count(*) as n from orders where o_orderpriority is not null group by 1 order by n desc, reason limit 8")
def outcome_reasons(t):
    return E.reasons(t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reason")))


@query(f"with {O.PAGE}, f as (select item_id, count(*) fused, count(*) filter (where keep) kept, count(*) filter (where keep and route <> 'exclude') gated from ga group by 1), r as (select item_id, count(*) n from pg where position <= 10 group by 1), x as (select f.*, coalesce(n, 0) results from f left join r using (item_id)) select count(*) as queries, {O.half_up('avg(fused)')} as mean_fused, {O.half_up('avg(kept)')} as mean_kept, {O.half_up('avg(gated)')} as mean_gated, {O.half_up('avg(results)')} as mean_results, min(results) as least, max(results) as most from x")
def funnel_means(t):
    judged = t.judged
    rows = judged.groupBy("item_id").agg(F.count(F.lit(1)).alias("fused"), F.count_if("keep").alias("kept"), F.count_if(F.col("keep") & (F.col("route") != "exclude")).alias("gated"))
    n = P.page(judged).groupBy("item_id").agg(F.count(F.lit(1)).alias("results"))
    return E.funnel(rows.join(n, "item_id", "left").fillna({"results": 0}))


@query(f"with {_GOLD}, l as (select item_id, item_id not in (select item_id from gold) refuse from benchmark), v as ({_VERDICT.replace('with ', 'with ', 1)}) select count(*) filter (where refuse) as should_decline, count(*) filter (where refuse and reason is not null) as declined, count(*) filter (where not refuse) as should_answer, count(*) filter (where not refuse and reason is null) as answered, count(*) filter (where not refuse and sufficient >= 0.6e0) as carried from l join v using (item_id)")
def score_board(t):
    gold = R.containing(t.documents, t.benchmark).select("item_id", F.lit("answer").alias("expect")).distinct()
    rows = J.verdicts(P.page(t.judged, 10**6), t.benchmark).join(gold, "item_id", "left").fillna({"expect": "refuse"})
    return E.score_board(rows.select("expect", F.col("reason").isNull().alias("answered"), F.col("sufficient").alias("substance")))


@query(f"with {O.PAGE}, {_GOLD}, b as (select item_id, min(rank) before from gold join lex using (item_id, doc_id) where rank <= 10 group by 1), a as (select item_id, min(position) after from gold join pg using (item_id, doc_id) where position <= 10 group by 1) select count(*) as items, count(*) filter (where after <= 1) as at_1, count(*) filter (where after <= 3) as at_3, count(*) filter (where after <= 5) as at_5, count(*) filter (where after < before) as moved_up, count(*) filter (where after > before) as moved_down, count(*) filter (where before is not null and after is null) as dropped from benchmark left join b using (item_id) left join a using (item_id)")
def rank_moves(t):
    gold = R.containing(t.documents, t.benchmark)
    best = lambda rows, rank, name: gold.join(rows, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min(rank).alias(name))
    rows = t.benchmark.select("item_id").join(best(t.asked.bm25(t.benchmark, 10), "rank", "before"), "item_id", "left").join(best(P.page(t.judged), "position", "after"), "item_id", "left")
    return E.rank_moves(rows)
