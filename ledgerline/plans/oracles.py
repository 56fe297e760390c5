"""DuckDB SQL with the same rows as the registered queries, written from the rules and not from the plans."""

from __future__ import annotations

import re

from ..config import ACRONYMS, PLACES, SECOND_LEVELS, TIERS, TITLE_NOISE, TRACKING_KEYS, WATCHLIST
from ..functions.text import fold
from .queries import DEAL_TYPES, DEMO, SUFFIXES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "(" + ", ".join(map(_q, items)) + ")"


def _esc(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _has(column: str, terms) -> str:
    """Any of the terms as whole words; RE2's \\b knows ASCII only, so word characters are spelled out."""
    return f"regexp_matches({column}, {_q('(?i)(^|[^\\p{L}\\p{N}\\p{M}_])(?:' + '|'.join(_esc(t) for t in terms) + ')($|[^\\p{L}\\p{N}\\p{M}_])')})"


_TITLE = "split_part(text, chr(10), 1)"
_SQUEEZED = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _normal(title: str) -> str:
    low = f"lower({title})"
    cut = r"(?s)^(.*)( - | \| )(.*)$"
    body = f"case when regexp_matches({low}, '{cut}') and length(regexp_extract({low}, '{cut}', 3)) < 35 then regexp_extract({low}, '{cut}', 1) else {low} end"
    words = rf"string_split(trim(regexp_replace(regexp_replace({body}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w not in {_list(TITLE_NOISE)}), ' ')"


_URL = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_CANONICAL = f"""
select page_id, case when u = '' then '' else
  (case when p1 <> '' then lower(p1) || ':' else '' end) || (case when host <> '' then '//' || host else '' end) || regexp_replace(p3, '/+$', '') ||
  (case when len(kept) > 0 then '?' || array_to_string(list_transform(list_sort(kept), lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') else '' end)
end as canonical_url from (
  select *, regexp_replace(lower(p2), '^www\\.', '') as host,
    list_filter(list_transform(list_filter(string_split(p4, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '(?s)^[^=]*=(.*)$', 1), '+', ' '))}}),
      lambda y: lower(y.k) not in {_list(TRACKING_KEYS)} and not starts_with(lower(y.k), 'utm_')) as kept
  from (select page_id, u, regexp_extract(u, '{_URL}', 1) p1, regexp_extract(u, '{_URL}', 2) p2, regexp_extract(u, '{_URL}', 3) p3, regexp_extract(u, '{_URL}', 4) p4
        from (select page_id, trim(coalesce(url, '')) u from pages)))"""

_DOUBLE = "|".join(f"{k}\\.(?:{'|'.join(v.split())})" for k, v in SECOND_LEVELS.items())
_HOST = "regexp_extract(lower(trim(url)), '^(?:[^:/?#]+://|//)?(?:[^/?#@]*@)?([^/?#:]*)', 1)"
_DOMAIN = f"select page_id, case when regexp_matches(h, '^[\\d.]+$') then h when regexp_extract(h, '([^.]+\\.(?:{_DOUBLE}|[^.]+))\\.?$', 1) <> '' then regexp_extract(h, '([^.]+\\.(?:{_DOUBLE}|[^.]+))\\.?$', 1) else h end as domain from (select page_id, {_HOST} h from pages)"

_ARTICLES = f"""articles as (select d.doc_id, cast(d.doc_id as varchar) article_id, {_TITLE} title, d.text snippet, coalesce(p.url, '') url, d.source source_name, e.ts published_at,
  (select max(ts) from events) retrieved_at, d.lang query from documents d left join pages p on p.page_id = d.doc_id left join events e on e.event_id = d.doc_id)"""


def _flagged(rows: str, key: str, reason: str, window: bool) -> str:
    near = "and abs(epoch_us(published_at) - epoch_us(best_at)) <= 1209600000000" if window else ""
    return f"""{rows}, best as (select *, first_value(article_id) over w best_id, first_value(published_at) over w best_at from keyed
  window w as (partition by {key} order by -length(snippet), published_at desc nulls last, row_idx)),
 flagged as (select *, {key} <> '' and best_id <> article_id {near} is true as hit from best)"""


_CLEAN_DOC = "substr(" + _SQUEEZED.format("snippet") + ", 1, 500)"
_BY_TITLE = _flagged(f"with {_ARTICLES}, keyed as (select article_id, doc_id row_idx, published_at, {_CLEAN_DOC} snippet, {_normal('title')} k from articles)", "k", "", True)
_STATUS = "article_id, case when hit then 'duplicate' else 'canonical' end as dedupe_status, case when hit then '{0}' else '' end as dedupe_reason, case when hit then best_id else '' end as duplicate_of from flagged"
_CLEAN_PAGE = "substr(" + _SQUEEZED.format("html") + ", 1, 500)"
_BY_URL = _flagged(
    f"with urls as ({_CANONICAL}), keyed as (select cast(p.page_id as varchar) article_id, p.page_id row_idx, e.ts published_at, {_CLEAN_PAGE} snippet, u.canonical_url k from pages p join urls u using (page_id) left join events e on e.event_id = p.page_id)",
    "k", "", False,
)


def _relevance(snippet: str = "snippet", title: str = "title") -> str:
    c, t = DEMO, "t"
    soft = f"({_has(t, [x for x in c.soft if x != 'raises'])} or ({_has(t, ['raises'])} and ({_has(t, c.funding_context)} or value)))"
    flags = {
        "strong": _has(t, c.strong), "soft": soft, "fmcg": _has(t, c.fmcg), "category": _has(t, [x for x, _ in c.categories]), "watch": _has(t, c.watchlist), "earnings": _has(t, c.earnings),
        "launch": _has(t, c.launch), "market": _has(t, c.market), "transaction": _has(t, c.transaction), "off_topic": _has("source_name", c.off_topic), "service": _has(t, c.service),
    }
    week, month = 7 * 86_400_000_000, 30 * 86_400_000_000
    rules = [
        ("strong_deal_term", 30, "strong"), ("soft_deal_term", 20, "soft and not strong"), ("fmcg_term", 25, "fmcg"), ("category_term", 15, "category and not fmcg"), ("watchlist_company", 15, "watch"),
        ("recent_7d", 10, f"coalesce(age <= {week}, false)"), ("recent_30d", 5, f"coalesce(age > {week} and age <= {month}, false)"), ("deal_value_visible", 10, "value"),
        ("source_query_context", 15, "query in ('en', 'fr') and (fmcg or category or watch)"), ("earnings_noise", -25, "earnings and not strong"), ("launch_noise", -10, "launch and not strong and not soft"),
        ("market_noise", -35, "market and not transaction"), ("off_topic_source", -40, "off_topic"), ("service_noise", -40, "service"),
    ]
    total = " + ".join(f"(case when {w} then {p} else 0 end)" for _, p, w in rules)
    why = ", ".join(f"case when {w} then '{n}' end" for n, _, w in rules)
    value = r"(regexp_matches(t, '[$€£₹]\s?\d') or regexp_matches(t, '(?i)\b\d+\s?(?:million|billion|crore|mn|bn)\b') or regexp_matches(t, '\b(?:USD|INR|EUR)\b'))"
    return f"""with {_ARTICLES}, texts as (select article_id, source_name, query, {title} || ' ' || {snippet} t, epoch_us(retrieved_at) - epoch_us(published_at) age from articles),
 valued as (select *, {value} as "value" from texts), flags as (select *, {', '.join(f'{v} as {k}' for k, v in flags.items())} from valued),
 scored as (select article_id, {total} total, not strong and not soft as none, array_to_string(list_filter([{why}, case when not strong and not soft then 'no_deal_term' end], lambda x: x is not null), ',') reasons from flags),
 clamped as (select article_id, cast(greatest(0, least(100, case when none then least(total, 30) else total end)) as integer) relevance_score, reasons from scored)
 select article_id, relevance_score, reasons, case when relevance_score >= 70 then 'include' when relevance_score >= 55 then 'watchlist' else 'reject' end as status from clamped"""


def _tier(column: str, i: int) -> str:
    pairs = {(x.lower() if i else x): t for t in sorted(TIERS, reverse=True) for x in TIERS[t][i]}
    return f"case {column} " + " ".join(f"when {_q(k)} then {v}" for k, v in pairs.items()) + " end"


_CREDIBILITY = f"""with {_ARTICLES}, named as (select article_id, published_at, case source_name when 'src0' then 'Reuters' when 'src1' then '  food dive ' when 'src2' then 'GlobeNewswire' else source_name end n,
  case when doc_id % 7 = 0 then 'bbc.com' when doc_id % 7 = 1 then 'businesswire.com' else '' end d from articles),
 tiered as (select *, coalesce({_tier('d', 0)}, {_tier('lower(trim(n))', 1)}, 4) tier from named), based as (select *, case tier when 1 then 90 when 2 then 75 when 3 then 60 else 45 end base from tiered)
 select article_id, cast(least(100, greatest(0, base + case when published_at is not null and n <> '' then 5 when published_at is null then -10 else 0 end)) as integer) credibility_score, 'tier_' || tier credibility_tier,
  'tier_' || tier || '_base_' || base || case when published_at is not null and n <> '' then ',metadata_complete' when published_at is null then ',no_published_date' else '' end reasons from based"""

_GROUP = """with m as (select o_custkey, cast(o_orderkey % 61 + 35 as double) s, o_orderkey % 4 k from orders),
 r as (select *, row_number() over (partition by o_custkey order by s desc) n from m),
 g as (select o_custkey, max(s) top, avg(s) filter (where n <= 3) three, count(distinct k) c, bool_or(k = 0) t1, bool_or(k = 2) t3 from r group by 1)
 select o_custkey, cast(least(100, round_even(0.60 * top + 0.25 * three + case when c >= 3 then 15 when c >= 2 then 10 else 0 end + case when t1 and t3 then 15 else 0 end, 0)) as integer) credibility from g"""


def _first(column: str, cases, default: str) -> str:
    return "case " + " ".join(f"when {_has(column, terms)} then {_q(name)}" for terms, name in cases) + f" else {_q(default)} end"


_PLACES = ["in the US.", "the U.S. said", "us only", "Latin America", "South Korea and EU", "nowhere"]
_SHORT = " ".join(f"when regexp_matches(t, {_q('(^|[^\\w])' + _esc(a) + '($|[^\\w.])')}) then {_q(p)}" for a, p in ACRONYMS)
_GEO = f"select o_orderkey, case {_SHORT} else {_first('t', [((n,), p) for n, p in PLACES], 'Not specified')} end as geography from (select o_orderkey, list_extract({'[' + ', '.join(map(_q, _PLACES)) + ']'}, cast(o_orderkey % 6 + 1 as int)) t from orders)"

_KNOWN = "|".join(_esc(fold(n)) for n in WATCHLIST)
_PAIRS = """with v as (select vec_id, label, cast(embedding as double[]) e from embeddings)
 select a.vec_id i, b.vec_id j, round(list_cosine_similarity(a.e, b.e), 6) cosine from v a join v b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.3"""

_EVENTS = """o as (select o_custkey, list({'title': 't' || o_orderkey, 'url': 'http://x/' || o_orderkey, 'source_name': o_orderpriority} order by 't' || o_orderkey) sources from orders group by 1),
 ev as (select printf('C%06d', o_custkey) cluster_id, 'h' || o_custkey canonical_headline, o_custkey % 3 > 0 named, sources from o)"""


_AT = "left join (select event_id, date_trunc('second', ts) published_at from events) e on e.event_id = d.doc_id"
_JSON_SOURCES = f"""select source_api, 'https://e.com/' || doc_id url, md5({_TITLE}) title_md5, md5(case when source_api = 'gdelt' then '' else text end) snippet_md5, source source_name, published_at
 from documents d {_AT}, (select unnest(['gdelt', 'alpha_vantage', 'marketaux', 'newsdata', 'newsapi']) source_api) where not (source_api = 'newsdata' and doc_id % 7 = 0)"""

_RSS_SOURCES = f"""with d as (select *, row_number() over (partition by doc_id // 60 order by doc_id) n from documents),
 feeds as (select d.*, published_at, api from d {_AT}, (select unnest(['google_news_rss', 'pr_wire_rss']) api))
 select api source_api, case when api = 'pr_wire_rss' then 'feed:' else '' end || 'general_fmcg' as query, 'Deal ' || doc_id || ' & more' title, 'https://e.com/' || doc_id url, lang || ' note' snippet,
  case when api = 'pr_wire_rss' then 'general_fmcg' when doc_id % 2 = 0 then source else 'Google News' end source_name, published_at from feeds where api = 'pr_wire_rss' or n <= 50"""

_PREFERRED = f"""with {_ARTICLES} select source_name, article_id from (select *, row_number() over (partition by source_name order by
  case doc_id % 7 when 0 then 1 when 1 then 2 when 2 then 3 else 4 end, length(snippet) desc, published_at desc nulls last, doc_id) n from articles) where n = 1"""

_SHOWN = """with e as (select doc_id k from documents where doc_id * 7 % 101 >= 40 and (doc_id * 11 % 101 >= 50 or doc_id * 13 % 101 >= 50))
 select cast(doc_id as varchar) article_id, case when k is not null then printf('C%03d', k) else '' end cluster_id from documents left join e on k = doc_id // 3"""

#: The walk itself, row by row, over the near pairs.
_SEEDS = """with recursive rank as (select event_id, event_type, user_id, ts, row_number() over (order by ts desc nulls last, event_id) r from events),
 near as (select least(a.r, b.r) lo, greatest(a.r, b.r) hi, a.event_type = b.event_type same, (least(a.event_id, b.event_id) * 7 + greatest(a.event_id, b.event_id) * 13) % 100 cos
  from rank a join rank b on a.user_id = b.user_id and a.event_id < b.event_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000),
 edges as (select lo, hi from near where cos >= 60 or (cos >= 40 and same)), nodes as (select hi, list(lo order by lo) l, row_number() over (order by hi) k from edges group by 1),
 walk(k, gone) as (select 0::bigint, []::bigint[] union all
   select nodes.k, case when len(list_filter(nodes.l, lambda q: not list_contains(walk.gone, q))) > 0 then list_append(walk.gone, nodes.hi) else walk.gone end from walk join nodes on nodes.k = walk.k + 1),
 final as (select gone from walk order by k desc limit 1), led as (select hi, min(lo) lo from edges, final where not list_contains(gone, lo) and list_contains(gone, hi) group by 1)
 select a.event_id row_idx, coalesce(b.event_id, a.event_id) seed from rank a left join led on led.hi = a.r left join rank b on b.r = led.lo"""

_RECORDS = f"""with cred as ({_GROUP}), m as (select o_custkey c, o_orderkey n, o_orderdate, row_number() over (partition by o_custkey order by o_orderkey % 61 desc, o_orderkey * 7 % 101 desc, o_orderkey) p from orders),
 named as (select c, 2 * p pl, 'Maker' || n % 7 who from m union all select c, 2 * p + 1, 'Trader' || n % 5 from m), firsts as (select c, who, min(pl) pl from named group by 1, 2),
 who as (select c, (list(who order by pl))[1:5] w from firsts group by 1),
 g as (select c, arg_min('t' || n, p) canonical_headline, max(n * 7 % 101) relevance_score, max(n % 61 + 35) max_article_credibility, count(*) article_count, count(distinct n % 4) source_count, bool_and(n % 3 > 0) is_sample,
  string_agg('t' || n, '|' order by p) titles, strftime(min(o_orderdate), '%Y-%m-%d') earliest, strftime(max(o_orderdate), '%Y-%m-%d') latest, bool_or(n % 4 = 0) first_tier from m group by 1)
 select c as cluster, printf('C%03d', row_number() over (order by c)) cluster_id, canonical_headline, 'acquisition' deal_type, relevance_score, max_article_credibility, credibility credibility_score,
  case when relevance_score >= 75 and credibility >= 75 and (source_count >= 2 or first_tier) then 'High' when relevance_score >= 60 and credibility >= 55 then 'Medium' else 'Low' end confidence,
  article_count, source_count, is_sample, 'Signals acquisition activity in Other, involving ' || array_to_string(w, ', ') || '. ' || source_count || ' source(s) reporting.' why_it_matters,
  array_to_string(w, '|') companies, titles, earliest, latest from g join who using (c) join cred on o_custkey = c"""

_BRIEF = """r as (select c_custkey n, c_mktsegment, printf('C%06d', c_custkey) cluster_id, ['High', 'Medium', 'Low'][cast(c_custkey % 3 + 1 as int)] confidence, case when c_custkey % 5 > 0 then c_custkey % 13 end latest from customer),
 ranked as (select *, row_number() over (order by case confidence when 'High' then 0 when 'Medium' then 1 else 2 end, n % 11 desc, n % 7 desc, latest desc nulls last, cluster_id) brief_rank from r)"""


def _suffix_domains() -> str:
    """Each rule as a pattern; the longest that fits, or the exception."""
    host = _HOST.replace("url", "u")
    kinds = {"url": "url", "deep": "'http://a.p' || page_id || '.co.uk/x'", "any": "'b.c.z' || page_id || '.test'", "first": "'x.first.test'"}
    rows = " union all ".join(f"select page_id, '{k}' k, {v} u from pages" for k, v in kinds.items())
    return rf"""with rules as (select starts_with(rule, '!') ex, len(string_split(rule, '.')) n, '(^|\.)' || replace(replace(ltrim(rule, '!'), '.', '\.'), '*', '[^.]+') || '$' pattern from (select unnest([{", ".join(map(_q, SUFFIXES))}]) rule)),
      hosts as (select page_id, k, {host} h from ({rows})),
      met as (select page_id, k, h, coalesce(max(n - 1) filter (where ex), greatest(1, max(n) filter (where not ex))) s from hosts left join rules on regexp_matches(h, pattern) group by all),
      named as (select page_id, k, array_to_string(list_slice(string_split(h, '.'), greatest(1, len(string_split(h, '.')) - coalesce(s, 1)), len(string_split(h, '.'))), '.') d from met)
      select page_id, {", ".join(f"max(d) filter (where k = '{k}') as {_k(k)}" for k in kinds)} from named group by page_id"""


def _k(name: str) -> str:
    return f'"{name}"'


_KEPT_UP = r"""with kept as (select row_number() over () i, text from documents where source is distinct from 'src3'),
  tok as (select distinct i, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_][\p{L}\p{N}\p{M}_]+')) term from kept)
  select term, count(*) df, round(ln((1 + (select count(*) from kept)) / (1 + count(*))) + 1, 6) idf from tok group by term"""


def _text_pairs() -> str:
    stops = _list(sorted(DEMO.stop_words))
    return rf"""with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_][\p{{L}}\p{{N}}\p{{M}}_]+')) t from documents),
 tf as (select doc_id, t, count(*) tf from tok where t not in {stops} group by 1, 2), df as (select t, count(*) df from tf group by 1), n as (select count(*) n from documents),
 w as (select doc_id, t, tf * (ln((1 + n) / (1 + df)) + 1) w from tf join df using (t), n), l as (select doc_id, sqrt(sum(w * w)) l from w group by 1), u as (select doc_id, t, w / l w from w join l using (doc_id))
 select a.doc_id i, b.doc_id j, round(sum(a.w * b.w), 6) cosine from u a join u b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2 having sum(a.w * b.w) >= 0.82"""


def _similar_text() -> str:
    """The greedy walk itself, row by row, over the pairs."""
    stops = _list(sorted(DEMO.stop_words))
    return rf"""with recursive {_ARTICLES}, rows as (select article_id, doc_id, published_at, {_CLEAN_DOC} s, {_normal('title')} || ' ' || {_CLEAN_DOC} x from articles),
 tok as (select doc_id, unnest(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}\p{{M}}_][\p{{L}}\p{{N}}\p{{M}}_]+')) t from rows),
 tf as (select doc_id, t, count(*) tf from tok where t not in {stops} group by 1, 2), df as (select t, count(*) df from tf group by 1), n as (select count(*) n from rows),
 w as (select doc_id, t, tf * (ln((1 + n) / (1 + df)) + 1) w from tf join df using (t), n), l as (select doc_id, sqrt(sum(w * w)) l from w group by 1), u as (select doc_id, t, w / l w from w join l using (doc_id)),
 rank as (select doc_id, article_id, published_at, row_number() over (order by -length(s), published_at desc nulls last, doc_id) - 1 r from rows),
 pairs as (select a.doc_id i, b.doc_id j from u a join u b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2 having sum(a.w * b.w) >= 0.82),
 edges as (select least(x.r, y.r) lo, greatest(x.r, y.r) hi from pairs p join rank x on x.doc_id = p.i join rank y on y.doc_id = p.j where abs(epoch_us(x.published_at) - epoch_us(y.published_at)) <= 1209600000000),
 nodes as (select hi, list(lo order by lo) l, row_number() over (order by hi) k from edges group by 1),
 walk(k, gone) as (select 0::bigint, []::bigint[] union all
   select nodes.k, case when len(list_filter(nodes.l, lambda q: not list_contains(walk.gone, q))) > 0 then list_append(walk.gone, nodes.hi) else walk.gone end from walk join nodes on nodes.k = walk.k + 1),
 final as (select gone from walk order by k desc limit 1),
 led as (select hi, min(lo) lo from edges, final where not list_contains(gone, lo) and list_contains(gone, hi) group by 1)
 select a.article_id, case when led.hi is not null then 'duplicate' else 'canonical' end dedupe_status, case when led.hi is not null then 'tfidf_similarity_82' else '' end dedupe_reason, coalesce(b.article_id, '') duplicate_of
 from rank a left join led on led.hi = a.r left join rank b on b.r = led.lo"""


def oracle_sql() -> dict[str, str]:
    value = r"(?i)(?:[$€£₹]\s?\d[\d,.]*\s?(?:million|billion|trillion|crore|lakh|mn|bn|[mb]\b)?|\b\d[\d,.]*\s?(?:million|billion|crore|mn|bn)\b|\b(?:USD|INR|EUR)\s?\d[\d,.]*)"
    return {
        "url_canonical": _CANONICAL,
        "url_domain": _DOMAIN,
        "title_normalize": f"select doc_id, {_normal(_TITLE)} as normalized_title from documents",
        "title_display": r"select doc_id, trim(regexp_replace(text || ' | ' || source, '\s+(?:-|\|)\s+.{1,45}$', '')) as display_title from documents",
        "snippet_clean": f"select page_id, {_CLEAN_PAGE} as snippet from pages",
        "accent_fold": r"select doc_id, md5(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) as folded_md5 from documents",
        "word_counts": r"select doc_id, cast(len(regexp_extract_all(regexp_replace(text, '[\p{L}\p{N}\p{M}_]', 'a', 'g'), '\b[\w$€£₹.-]+\b')) as integer) as n_words from documents",
        "lookback_filter": "select event_id, event_type from events, (select max(ts) m from events) where ts >= m - interval 7 day and ts <= m + interval 1 day",
        "dedupe_repeated": f"select canonical_url, 3 * count(*) as n, 1 as n_canonical, 3 * count(*) as n_ids from ({_CANONICAL}) where canonical_url <> '' group by 1",
        "dedupe_exact_url": f"{_BY_URL} select {_STATUS.format('exact_url')}",
        "dedupe_exact_title": f"{_BY_TITLE} select {_STATUS.format('exact_title_14d')}",
        "dedupe_similar_text": _similar_text(),
        "relevance": _relevance(title="(title || case when doc_id % 5 = 0 then ' at $' || doc_id || ' million' else '' end)"),
        "credibility": _CREDIBILITY,
        "group_credibility": _GROUP,
        "confidence_labels": "select o_orderkey, case when o_orderkey % 101 >= 75 and o_orderkey * 7 % 101 >= 75 and (o_orderkey % 3 + 1 >= 2 or o_orderkey % 5 = 0) then 'High' when o_orderkey % 101 >= 60 and o_orderkey * 7 % 101 >= 55 then 'Medium' else 'Low' end as confidence from orders",
        "detect_deal_type": f"select doc_id, {_first('lower(text)', [(terms, n) for n, terms in DEAL_TYPES], 'unknown')} as deal_type from documents",
        "detect_category": f"select doc_id, {_first('lower(text)', [((t,), n) for t, n in DEMO.categories], 'Other')} as category from documents",
        "detect_geography": _GEO,
        "extract_value": f"select o_orderkey, coalesce(nullif(trim(regexp_extract(list_extract(['worth $' || o_orderkey || ' million today', 'about ' || o_orderkey || ' crore', 'USD ' || o_orderkey || ' paid', 'no figure'], cast(o_orderkey % 4 + 1 as int)), {_q(value)}, 0)), ''), 'undisclosed') as deal_value from orders",
        "best_turn": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by -length(text), turn, role) n from conversations) where n = 1",
        "ordered_roles": "select conv_id, string_agg(role, ',' order by turn, role) as roles from conversations group by 1",
        "source_counts": "select source, count(*) n, count(*) filter (where lang = 'en') n_en, bool_and(n_chars > 10) all_long from documents group by 1",
        "top_three": "select source as category, count(*) n from documents group by 1 order by n desc, min(doc_id) limit 3",
        "latest_span": "select user_id, min(ts) earliest, max(ts) latest, count(*) n from events group by 1",
        "embedding_cosines": _PAIRS,
        "interval_pairs": "select a.event_id i, b.event_id j from events a join events b on a.user_id = b.user_id and a.event_id < b.event_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000",
        "text_pairs": _text_pairs(),
        "url_suffix_domain": _suffix_domains(),
        "kept_up_frequencies": _KEPT_UP,
        "evidence_rows": f"with {_EVENTS} select cluster_id, canonical_headline, s.title, s.url, s.source_name from (select cluster_id, canonical_headline, unnest(sources) s from ev)",
        "flat_events": f"with {_EVENTS} select cluster_id, canonical_headline, case when named then 'A, B' else 'Not clearly identified' end companies, array_to_string(list_transform(sources, lambda s: s.title), '; ') source_titles from ev",
        "sheet_cells": "select cast(doc_id as varchar) doc_id, '[\"' || lang || '\",\"' || source || '\"]' tags, case when doc_id % 2 = 0 then lang else '' end maybe, '' absent from documents",
        "rejected_rows": f"with s as ({_relevance(_CLEAN_DOC)}), d as ({_BY_TITLE} select {_STATUS.format('exact_title_14d')}) select article_id, status, dedupe_status from s join d using (article_id) where status = 'reject' or dedupe_status = 'duplicate'",
        "table_search": "select c_custkey from customer where contains(lower(concat_ws(' ', c_custkey, c_name, c_mktsegment)), 'build')",
        "present_rows": "select cast(doc_id as varchar) article_id from documents where doc_id % 3 <> 0 and doc_id % 4 <> 0 and trim(split_part(text, chr(10), 1)) <> ''",
        "json_sources": _JSON_SOURCES,
        "rss_sources": _RSS_SOURCES,
        "sample_dates": "select o_orderkey row_idx, printf('sample-%03d', o_orderkey + 1) article_id, true is_sample, timestamp '2024-06-12' - to_days(cast(o_orderkey % 30 as int)) - to_hours(o_orderkey % 12) published_at from orders",
        "preferred_rows": _PREFERRED,
        "shown_clusters": _SHOWN,
        "seed_groups": _SEEDS,
        "company_groups": "select o_orderkey seed, min(o_orderkey) over (partition by o_custkey // 3) component from orders",
        "event_records": _RECORDS,
        "brief_ranks": f"with {_BRIEF} select cluster_id, brief_rank from ranked",
        "brief_appendix": f"with {_BRIEF} select 'u' || n % 50 url, arg_min(cluster_id, brief_rank) cluster_id, arg_min(c_mktsegment, brief_rank) label, arg_min('t' || n, brief_rank) title from ranked group by 1",
        "brief_tables": f"with {_BRIEF} select cluster_id, 'h' || n canonical_headline, 'A' companies, confidence, confidence = 'Low' watch from ranked",
        "source_rows": "select 'api_' || lang source_api, count(*) n from documents group by 1",
        "run_counts": f"with s as ({_relevance(_CLEAN_DOC)}), d as ({_BY_TITLE} select {_STATUS.format('exact_title_14d')}) select count(*) all_rows, count(*) filter (where dedupe_status = 'duplicate') duplicates, count(*) filter (where dedupe_status = 'canonical' and status = 'include') included from s join d using (article_id)",
        "event_candidates": "select o_orderkey from orders where o_orderkey % 5 <> 0 and o_orderkey % 3 < 2 and o_orderkey % 101 >= 55 and o_orderkey * 7 % 101 >= 50",
        "confidence_levels": "select ['High', 'Medium', 'Low'][cast(c_custkey % 3 + 1 as int)] confidence, count(*) n, min(printf('C%06d', c_custkey)) seen from customer group by 1",
        "gathered_articles": f"select source_api, 'https://e.com/' || doc_id url from documents d {_AT}, (select unnest(['gdelt', 'newsapi', 'pr_wire_rss']) source_api), (select max(ts) m from events) where published_at >= m - interval 30 day and (source_api = 'pr_wire_rss' or trim({_TITLE}) <> '')",
        "merged_groups": "select c_custkey, min(c_custkey) over (partition by c_custkey // 4) as cluster, cast(row_number() over (partition by c_custkey // 4 order by c_custkey) - 1 as int) as ord from customer",
        "counts_by_window": "select date_trunc('day', ts) as start, event_type as source_api, count(*) n from events group by 1, 2",
    }
