"""DuckDB SQL for the queries of the catalog."""

from __future__ import annotations

import re

from ..functions import text as T
from ..operators import judge as J
from ..operators import understand as Q


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "(" + ", ".join(map(quote, T.STOPWORDS)) + ")"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def stem(x: str) -> str:
    n, cut = f"length({x})", lambda k: f"left({x}, length({x}) - {k})"
    return (
        f"(case when {n} < 5 then {x} when {x} like '%coes' and {n} > 6 then {cut(4)} || 'cao' when {x} like '%mente' and {n} > 7 then {cut(5)} when {x} like '%ies' and {n} > 5 then {cut(3)} || 'y' "
        f"when {x} like '%ing' and {n} > 5 then {cut(3)} when {x} like '%ed' and {n} > 5 then {cut(2)} when regexp_matches({x}, '(x|z|s|ch|sh)es$') then {cut(2)} "
        f"when {x} like '%s' and not {x} like '%ss' and not regexp_matches({x}, '[aeiou]s$') then {cut(1)} else {x} end)"
    )


def half_up(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits})"


def clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def raw_terms(x: str) -> str:
    folded = fold("t")
    return rf"list_filter(list_transform(string_split_regex({x}, '[^\p{{L}}\p{{N}}+#._-]+'), lambda t: regexp_replace({folded}, '^[._-]+|[._-]+$', '', 'g')), lambda t: t <> '' and length(t) <= 40)"


KEPT = f"list_filter({raw_terms('text')}, lambda t: length(t) <= 1 or t not in {STOP})"
QUOTED = """list_filter(list_transform(regexp_extract_all(text, '"([^"]{2,120})"', 1), lambda x: trim(x)), lambda x: x <> '')"""
QUERY_TEXT = f"""array_to_string({QUOTED}, ' ') || ' ' || regexp_replace(text, '"[^"]*"', ' ', 'g')"""
QUERY_TERMS = f"list_distinct(list_filter({raw_terms('(' + QUERY_TEXT + ')')}, lambda t: t not in {STOP}))"
TOKENS = f"k as (select doc_id, unnest({KEPT}) t from documents), tok as (select doc_id, t as term from k union all select doc_id, {stem('t')} from k)"
BM25 = f"""{TOKENS}, post as (select doc_id, term, count(*) tf from tok group by all),
asked as (select item_id, unnest({QUERY_TERMS}) term from benchmark), df as (select term, count(*) df from post group by 1),
dl as (select doc_id, 2 * len({KEPT}) dl from documents), st as (select count(*)::double n, avg(dl) avgdl from dl),
part as (select item_id, doc_id, greatest(0.01e0, ln(1 + (n - df + 0.5e0) / (df + 0.5e0))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * (case when dl = 0 then 1 else dl end) / (case when avgdl = 0 then 1 else avgdl end))) s
 from asked join post using (term) join df using (term) join dl using (doc_id), st),
bm as (select item_id, doc_id, {half_up('sum(s)', 6)} score from part group by 1, 2),
lex as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from bm)"""
COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"
DENSE = f"""cs as (select b.item_id, e.vec_id doc_id, {half_up(f"{COS.format(a='q.embedding', b='e.embedding')} / (sqrt({COS.format(a='q.embedding', b='q.embedding')}) * sqrt({COS.format(a='e.embedding', b='e.embedding')}))", 6)} score
 from benchmark b join embeddings q on q.vec_id = b.item_id, embeddings e), den as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from cs)"""
FUSED = f"""{BM25}, {DENSE}, ch as (select item_id, doc_id, 'lexical' channel, score, 1e0 / (60 + rank) p from lex where rank <= 72 union all select item_id, doc_id, 'dense', score, 0.8e0 / (60 + rank) from den where rank <= 72),
fu as (select item_id, doc_id, {half_up('sum(p)', 8)} fused, count(distinct channel)::int channels, max(score) filter (where channel = 'lexical') lexical, max(score) filter (where channel = 'dense') dense from ch group by 1, 2),
fr as (select *, row_number() over (partition by item_id order by fused desc, doc_id) rank from fu)"""

GRAMS = f"""sk as (select doc_id, flatten(list_transform({KEPT}, lambda t: [t, {stem('t')}])) ts from documents),
sg as (select doc_id, unnest(list_concat(ts, [array_to_string(ts[i : i + 2], ' ') for i in range(1, len(ts) - 1)])) g from sk),
sh as (select doc_id, ('0x' || substr(sha1(g), 1, 8))::bigint hi, ('0x' || substr(sha1(g), 9, 8))::bigint lo from sg),
sv as (select doc_id, {', '.join(f'(sum(case when ({"hi" if b < 32 else "lo"} >> {31 - b % 32}) & 1 = 1 then 1 else -1 end) > 0)::int b{b}' for b in range(64))} from sh group by 1),
hx as (select d.doc_id, coalesce({' || '.join(f"lower(to_hex(b{4 * i} * 8 + b{4 * i + 1} * 4 + b{4 * i + 2} * 2 + b{4 * i + 3}))" for i in range(16))}, repeat('0', 16)) simhash from documents d left join sv using (doc_id))"""


def hamming(a: str, b: str) -> str:
    return "(" + " + ".join(f"bit_count(xor(('0x' || substr({a}, {s}, 8))::bigint, ('0x' || substr({b}, {s}, 8))::bigint))" for s in (1, 9)) + ")"


def content_words(x: str) -> str:
    return rf"list_transform(list_filter(string_split_regex({fold(x)}, '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2 and w not in {STOP}), lambda w: {stem('w')})"


def coverage(q: str, d: str) -> str:
    return f"(case when len({q}) = 0 then 0e0 else len(list_filter({q}, lambda w: list_contains({d}, w)))::double / len({q}) end)"


def affinity(q: str, d: str, text: str) -> str:
    return f"(case when len({q}) = 0 or length({text}) < 20 or len({d}) = 0 then 0e0 else {clamp(f'{coverage(q, d)} * least(1e0, 220e0 / greatest(60, len({d}))) / 0.5e0')} end)"


def hits(x: str, phrases) -> str:
    return "(" + " + ".join(f"contains({fold(x)}, {quote(p)})::int" for p in phrases) + ")"


def injection(x: str) -> str:
    return f"(case when {hits(x, J.INJECTION)} = 0 then 0.05e0 else {clamp(f'0.55e0 + 0.2e0 * {hits(x, J.INJECTION)}')} end)"


def advertisement(x: str) -> str:
    return clamp(f"0.05e0 + 0.2e0 * {hits(x, J.ADVERTISEMENT)}")


def quality(x: str) -> str:
    chars, n = rf"length(regexp_replace({x}, '^\s+|\s+$', '', 'g'))", rf"len(string_split_regex({x}, '\s+'))"
    parts = rf"len(list_filter(string_split_regex({x}, '[.!?]\s+'), lambda p: not regexp_full_match(p, '\s*')))"
    mean = f"({n}::double / greatest(1, {parts}))"
    b = lambda c, v: f"(case when {c} then {v}e0 else 0e0 end)"
    return f"(case when {chars} < 120 then 0.2e0 else {clamp(f'0.35e0 + {b(f"{chars} > 400", 0.25)} + {b(f"{mean} > 12 and {mean} < 45", 0.2)} + {b(f"regexp_matches({x}, {quote(J.DETAIL)})", 0.2)} - {b(f"regexp_matches({x}, {quote(J.FILLER)})", 0.3)}')} end)"


def authority(h: str) -> str:
    return f"(case when {h} = '' then 0.5e0 when regexp_matches({h}, {quote(J.AUTHORITATIVE)}) then 0.92e0 when regexp_matches({h}, {quote(J.LOW_QUALITY)}) then 0.15e0 when regexp_matches({h}, {quote(J.PUBLIC_SUFFIX)}) then 0.75e0 else 0.5e0 end)"


def noul(base: str, name: str) -> str:
    jitter = f"((('0x' || substr(sha256(item_id::varchar || '|' || doc_id::varchar || '|{name}'), 1, 2))::int / 255e0 - 0.5e0) * 0.12e0)"
    return half_up(clamp(f"{base} + {jitter}"))


HOST = "source || '.example.org'"
SIGNALS = f"""{FUSED}, {GRAMS}, pool as (select fr.*, simhash from fr join hx using (doc_id) where rank <= 72),
ord as (select item_id, list({{'r': rank, 'd': doc_id, 'h': simhash}} order by rank) xs, count(*) n from pool group by 1),
walk as (with recursive w as (select item_id, xs, n, 0::bigint i, []::struct(r bigint, d bigint, h varchar)[] kept from ord union all
 select item_id, xs, n, i + 1, case when len(list_filter(kept, lambda y: {hamming('y.h', 'xs[i + 1].h')} <= 5)) > 0 then kept else list_append(kept, xs[i + 1]) end from w where i < n) select * from w where i = n),
near as (select item_id, unnest(kept).d doc_id from walk),
short as (select fr.* from fr join near using (item_id, doc_id) where rank <= 24),
dw as (select doc_id, {HOST} host, text, {content_words('text')} d, {quality('text')} qual, {injection('text')} inj, {advertisement('text')} adv from documents where doc_id in (select doc_id from short)),
qw as (select item_id, {content_words('text')} q from benchmark),
sig as (select s.item_id, s.doc_id, s.rank, s.channels, s.lexical, host, {coverage('q', 'd')} cov, {affinity('q', 'd', 'text')} aff, {authority('host')} auth, qual, inj, adv from short s join dw using (doc_id) join qw using (item_id))"""
RERANK = f"""{SIGNALS}, rs as (select *, {noul('0.15e0 + 0.7e0 * aff + 0.15e0 * cov', 'relevance')} relevance, {noul('0.15e0 + 0.8e0 * auth', 'authority')} authority, {noul('0.15e0 + 0.8e0 * qual', 'quality')} quality,
 {noul('0.3e0 + 0.5e0 * qual', 'directness')} directness, {noul('0.15e0 + 0.7e0 * aff + 0.15e0 * cov', 'recency')} recency, {noul('0.2e0 + 0.7e0 * cov', 'constraint')} "constraint" from sig),
rc as (select *, {clamp('relevance * 0.56e0 + authority * 0.1e0 + quality * 0.1e0 + directness * 0.06e0 + recency * 0.02e0 + "constraint" * 0.1e0 - (case when coalesce(lexical, 0) = 0 then 0.08e0 else 0e0 end)')} raw from rs),
rr as (select *, {half_up('raw')} composite, raw >= 0.4e0 keep from rc)"""
GATE = f"""{RERANK}, gs as (select *, {noul('0.15e0 + 0.8e0 * aff', 'g_relevant')} g_relevant, {noul('0.15e0 + 0.7e0 * aff + 0.15e0 * cov', 'g_evidence')} g_evidence, {noul('0.1e0 + 0.3e0 * (1 - cov)', 'g_contradicts')} g_contradicts,
 {noul('0.12e0 + 0.8e0 * inj', 'g_injection')} g_injection, {noul('0.12e0 + 0.8e0 * adv', 'g_advertisement')} g_advertisement from rr),
ga as (select *, case when g_injection > 0.5e0 then 'exclude' when g_advertisement > 0.7e0 then 'exclude' when g_contradicts > 0.7e0 then 'conflicting' when g_relevant < 0.45e0 then 'exclude' when g_evidence < 0.55e0 then 'exclude' else 'include' end route from gs)"""
PAGE = f"""{GATE}, cp as (select *, row_number() over (partition by item_id, host order by (route <> 'include')::int, composite desc, doc_id) in_domain from ga where keep and route <> 'exclude'),
pg as (select *, row_number() over (partition by item_id order by (route <> 'include')::int, composite desc, doc_id) position from cp where in_domain <= 2)"""


def truncate(x: str, most: int) -> str:
    return rf"(case when length({x}) > {most} then regexp_replace(left({x}, {most - 1}), '\s+$', '') || '…' else {x} end)"


def judged(name: str) -> str:
    return half_up(clamp(f"{Q.BASES[name]}e0 + (('0x' || substr(sha256(item_id::varchar || '|{name}'), 1, 2))::int / 255e0 - 0.5e0) * 0.12e0"))


def spread_list(n: int, peak: str) -> str:
    raw = f"list_transform(range(0, {n}), lambda i: greatest(0.02e0, (1 - abs(i / {n - 1}e0 - {peak})) * (1 - abs(i / {n - 1}e0 - {peak}))))"
    return f"list_transform({raw}, lambda w: w / list_sum({raw}))"


def expected(n: int, peak: str) -> str:
    w = [f"greatest(0.02e0, (1 - abs({i / (n - 1)!r}::double - {peak})) * (1 - abs({i / (n - 1)!r}::double - {peak})))" for i in range(n)]
    return half_up(f"({' + '.join(f'{x} * {i}e0' for i, x in enumerate(w))}) / ({' + '.join(w)})")


UNDERSTAND = f"""us as (select item_id, text, {", ".join(f"{judged(k)} {k}" for k in Q.BASES)} from benchmark),
ul as (select *, {expected(Q.COMPLEXITY, 'complexity')} level, {expected(Q.HORIZON, 'time_horizon')} fresh, {spread_list(len(Q.STRATEGIES), 'strategy')} ps from us),
ud as (select *, [{', '.join(map(quote, Q.STRATEGIES))}][list_position(ps, list_max(ps))] chosen, greatest(1, floor(level + 0.5e0)::int) lv from ul),
un as (select item_id, floor(level + 0.5e0)::int complexity, floor(fresh + 0.5e0)::int horizon, ambiguity, chosen strategy, exact_phrase > 0.5e0 or len({QUOTED}) > 0 exact_phrase, "constraint" > 0.5e0 constrained,
 [{', '.join(map(quote, Q.DEPTHS))}][lv + 1] depth, floor([{', '.join(map(str, Q.POOLS.values()))}][lv + 1] * (case when ambiguity > 0.6e0 then 1.4e0 else 1e0 end) + 0.5e0)::int pool,
 case when multi_round > 0.55e0 or chosen = 'decomposition' or fresh >= 2.5e0 then 2 else 1 end rounds from ud)""".replace(" constraint from", ' "constraint" from').replace(" constraint,", ' "constraint",')


def follow_ups(query: str, titles: str) -> str:
    cut = rf"list_transform({titles}, lambda x: trim(regexp_replace(x, '\s*[|—–-]\s*[^|—–-]{{0,40}}$', '')))"
    return f"list_filter({cut}, lambda x: length(x) between 8 and 120 and lower(x) <> lower({query}))[1:2]"


def second_round(title: str, first: int, pool: int) -> str:
    tail = re.sub(r"\b(part|bm|lex|asked)\b", r"\g<1>2", BM25[BM25.index("part as (") :])
    return f"""with {BM25}, fst as (select item_id, doc_id, rank from lex where rank <= {first}), tt as (select item_id, list({title} order by rank) ts from fst join documents using (doc_id) where rank <= 6 group by 1),
fu as (select item_id item, unnest(list_distinct({follow_ups('b.text', 'ts')})) as text from tt join benchmark b using (item_id)), asked2 as (select item || '|' || text item_id, unnest({QUERY_TERMS}) term from fu), {tail},
fx as (select item item_id, doc_id, {half_up(f'sum(1e0 / ({60} + rank))', 8)} f from lex2 join fu on lex2.item_id = item || '|' || text where rank <= {pool} group by 1, 2),
sr as (select *, row_number() over (partition by item_id order by f desc, doc_id) r from fx),
bo as (select item_id, doc_id, 1 as round, rank r from fst union all select item_id, doc_id, 2, r from sr where r <= {pool} and (item_id, doc_id) not in (select item_id, doc_id from fst)),
rk as (select item_id, doc_id, round, row_number() over (partition by item_id order by round, r, doc_id)::int rank from bo) select item_id, doc_id, round, rank from rk where rank <= {pool}"""
