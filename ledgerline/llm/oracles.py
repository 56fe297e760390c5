"""DuckDB SQL of the corpus queries that SQL can express: all pairs, without an index or signatures."""

from __future__ import annotations

_REACH = """reach(n, m) as (select id, id from nodes union select reach.n, links.b from reach join links on links.a = reach.m),
 low as (select n, min(m) c from reach group by 1)"""

EMBEDDINGS = f"""with recursive v as (select vec_id id, label, cast(embedding as double[]) e from embeddings),
 nodes as (select id from v),
 links as (select x.id a, y.id b from v x join v y on x.label = y.label and x.id <> y.id where list_cosine_similarity(x.e, y.e) >= 0.93),
 {_REACH}, n as (select a, count(*) k from links group by 1)
 select id as vec_id, coalesce(k, 0) as n_links, c as component_id, id = c as kept from nodes join low on n = id left join n on a = id"""

NEAR_DUPLICATES = rf"""with recursive w as (select doc_id id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
 nodes as (select id from w),
 s as (select distinct id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end g from (select id, w, unnest(range(1, greatest(2, len(w)))) i from w where len(w) > 0)),
 n as (select id, count(*) n from s group by 1),
 links as (select x.id a, y.id b from s x join s y on x.g = y.g and x.id <> y.id join n p on p.id = x.id join n q on q.id = y.id
   group by x.id, y.id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
 {_REACH}
 select nodes.id as doc_id, coalesce(n.n, 0) as n_shingles, c as component_id, nodes.id = c as kept from nodes join low on low.n = nodes.id left join n on n.id = nodes.id"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = rf"""with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
 q as (select item_id, t, count(*) c from (select item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark) group by 1, 2),
 s as (select count(*) n, sum(len(w))::bigint l from d where len(w) > 0),
 m as (select doc_id, 75 + (25 * len(w) * n) // l m from d, s where len(w) > 0),
 tf as (select doc_id, t, count(*) tf from (select doc_id, unnest(w) t from d) group by 1, 2),
 wt as (select t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::bigint w from tf, s group by t, n),
 score as (select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
   from q join wt using (t) join tf using (t) join m using (doc_id) group by 1, 2),
 r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from score where score > 0)
 select item_id, rank, doc_id, score from r where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quantised_embeddings": EMBEDDINGS, "op5_bayesian_minhash": NEAR_DUPLICATES, "op12_block_max_search": SEARCH}
