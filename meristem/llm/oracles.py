"""DuckDB SQL for the registered queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

TOPK = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10
"""

NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from v a join v r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id)::int as rank
  from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

LEXICAL = f"""
with d as (
  select doc_id, {_TERMS.format("text")} as terms from documents where text is not null
), whole as (
  select count(*)::bigint as n_docs, sum(len(terms))::bigint as n_terms from d where len(terms) > 0
), q as (
  select item_id, term, count(*)::bigint as q from (select item_id, unnest({_TERMS.format("text")}) as term from benchmark) group by all
), p as (
  select doc_id, n, term, count(*)::bigint as tf
  from (select doc_id, len(terms)::bigint as n, unnest(terms) as term from d) where term in (select term from q) group by all
), w as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, whole group by term, n_docs
), s as (
  select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::bigint as score
  from q join p using (term) join w using (term), whole group by item_id, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from s where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""

RULES = rf"""
with w as (
  select doc_id, coalesce(text, '') as t, {WORDS} as w from documents
), g as (
  select doc_id, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5
), k as (
  select doc_id, i, w[i:i+4] as win from g
), r as (
  select doc_id, i from k qualify count(*) over (partition by doc_id, win) > 1
), p as (
  select doc_id, count(distinct i + o) as n_repeat_words from r, (select unnest(range(0, 5)) as o) group by doc_id
), l as (
  select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w
), m as (
  select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) > 3 * len(lines)
    or 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) > 9 * len(lines) as bad_lines
  from w join l using (doc_id) left join p using (doc_id)
)
select * exclude (bad_lines), (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
  and not (word_chars < 2 * n_words or word_chars > 15 * n_words)
  and not (2 * n_symbols > n_words)
  and not (n_dup_lines >= 3 and 10 * n_dup_lines > n_words)
  and not bad_lines as kept
from m
"""

DEDUP = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 2 then [w] else list_transform(range(1, len(w)), lambda i: w[i:i+1]) end) as s from w
), n as (
  select doc_id, len(s)::bigint as n_shingles, s from s
), ranked as (
  select doc_id, n_shingles, g, count(*) over (partition by g) as df
  from (select doc_id, n_shingles, unnest(s) as g from n)
), prefixed as (
  select *, row_number() over (partition by doc_id order by df, g) as place from ranked
), candidates as (
  select distinct a.doc_id as a, b.doc_id as b
  from prefixed a join prefixed b on a.g = b.g and a.doc_id < b.doc_id
  where a.place <= a.n_shingles - ceil(0.8 * a.n_shingles) + 1 and b.place <= b.n_shingles - ceil(0.8 * b.n_shingles) + 1
), links as (
  select a, b from candidates join n x on a = x.doc_id join n y on b = y.doc_id
  where 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n_shingles + y.n_shingles - len(list_intersect(x.s, y.s)))
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as id, doc_id as other from n
  union
  select r.id, e.b from reach r join both_ways e on r.other = e.a
), c as (select id, min(other) as component_id from reach group by id)
select n.doc_id, n_shingles, component_id, n.doc_id = component_id as kept from n join c on c.id = n.doc_id
"""

_LEVEL = """
 n{k} as (
  select {path}, sum(capacity) as capacity, any_value(weight{k}) as weight from leaf group by {path} having sum(capacity) > 0
 ), p{k} as (
  select n.*, {budget} as parent_budget from n{k} n {join}
 ), l{k} as (
  select *, (parent_budget - coalesce(sum(capacity) over (partition by {parent} order by capacity / weight, {name} nulls first rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (partition by {parent} order by capacity / weight, {name} nulls first rows between current row and unbounded following) as level
  from p{k}
 ), m{k} as (
  select *, max(case when level * weight <= capacity then level end) over (partition by {parent}) as fill from l{k}
 ), b{k} as (
  select {path}, least(capacity::double, coalesce(fill * weight, capacity::double)) as budget from m{k}
 )"""


def _mixing(share: float = 0.5, epochs: int = 2, seed: int = 42) -> str:
    levels = [
        _LEVEL.format(k=1, path="domain", parent="1", name="domain", budget="(select total from whole)", join=""),
        _LEVEL.format(k=2, path="domain, lang", parent="domain", name="lang", budget="b.budget", join="join b1 b on n.domain is not distinct from b.domain"),
        _LEVEL.format(k=3, path="domain, lang, source", parent="domain, lang", name="source", budget="b.budget", join="join b2 b on n.domain is not distinct from b.domain and n.lang is not distinct from b.lang"),
    ]
    return rf"""
with d as (
  select doc_id, 'domain' || (crc32_of_source % 4) as domain, lang, source, len({WORDS})::bigint as n_tokens
  from documents join ({{crc}}) using (source)
), leaf0 as (
  select domain, lang, source, count(*) as n_docs, sum(n_tokens)::bigint as tokens from d group by all
), leaf as (
  select *, tokens * {epochs} as capacity, case domain when 'domain0' then 4.0::double when 'domain1' then 3.0 when 'domain2' then 2.0 else 1.0 end as weight1,
    case when lang = 'en' then 2.0::double else 1.0 end as weight2, 1.0::double as weight3 from leaf0
), whole as (select floor(sum(tokens) * {epochs} * {share})::double as total from leaf),
{", ".join(levels)}, plan as (
  select f.*, least(floor(b.budget + 1e-6)::bigint, tokens * {epochs}) as budget
  from leaf f join b3 b on f.domain is not distinct from b.domain and f.lang is not distinct from b.lang and f.source is not distinct from b.source
), placed as (
  select d.*, coalesce(budget // tokens, 0)::bigint as full_epochs, coalesce(budget % tokens, 0)::bigint as last_budget,
    md5('{seed}|' || coalesce(budget // tokens, 0)::bigint || '|' || doc_id) as place
  from d left join plan p on d.domain is not distinct from p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source
), summed as (
  select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place rows between unbounded preceding and 1 preceding), 0)::bigint as upto from placed
)
select doc_id, domain, lang, source, n_tokens, full_epochs, greatest(0, least(n_tokens, last_budget - upto))::bigint as last_tokens,
  (full_epochs * n_tokens + greatest(0, least(n_tokens, last_budget - upto)))::bigint as taken
from summed
"""


def _sources_crc() -> str:
    """DuckDB has no crc32: the checksum of each source, bit by bit, by recursion."""
    return """
    with recursive c(source, i, crc) as (
      select distinct source, 0, 4294967295::bigint from documents where source is not null
      union all
      select source, i + 1,
        list_reduce(list_prepend(xor(crc, (case when i % 1 = 0 then ascii(source[i + 1]) end)::bigint), range(0, 8)),
          lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)
      from c where i < length(source)
    ) select source, xor(crc, 4294967295) as crc32_of_source from c where i = length(source)"""


MIXING = _mixing().replace("{crc}", _sources_crc())
