"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from papyrion.llm import mixing, quality, secret_scan, sharding

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(text, '{_WORD}')"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP1 = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from q where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when first_id <> page_id then 'revisit' else 'response' end as record_type, case when first_id <> page_id then first_id end as refers_to
from q left join f using (payload_digest)
"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches and the pieces between them alternate, so their lengths give the offsets."""
    start = "(list_sum(list_transform(list_slice(p, 1, k), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, k - 1), lambda x: length(x))), 0))"
    return f"""
select doc_id, '{kind}' as kind, {rank} as rank, {start}::bigint as s, ({start} + length(m[k]))::bigint as e from (
  select doc_id, m, p, g, unnest(range(1, len(m) + 1)) as k from (
    select doc_id, regexp_extract_all(text, {_lit(pattern)}) as m, regexp_split_to_array(text, {_lit(pattern)}) as p, regexp_extract_all(text, {_lit(pattern)}, {group}) as g from documents where regexp_matches(text, {_lit(pattern)})))
where length(g[k]) >= {least}"""


def _op5() -> str:
    parts = " union all ".join(_spans(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secret_scan.RULES))
    n = len(secret_scan.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.BASE)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in secret_scan.BASE)
    text = "string_agg(kind || ':' || s || ':' || e, ',' order by s, rank)"
    return f"""
with f as ({parts}),
g as (select doc_id, {counts}, coalesce({text} filter (rank < {n}), '') as base, {text} as spans from f group by doc_id)
select doc_id, {zeros}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join g using (doc_id)
"""


def _pour(source: str, parents: str, name: str, weight: str, out: str) -> str:
    """Budgets of one level by filling up: what a node cannot use goes to its siblings."""
    part = f"partition by {parents}" if parents else ""
    return f"""
{out}_w as (select *, {weight}::bigint as weight from {source}),
{out}_o as (select *, cap::double / weight as r,
  pool - coalesce(sum(cap) over ({part} order by cap::double / weight, {name} rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over ({part} order by cap::double / weight, {name} rows between current row and unbounded following) as mass from {out}_w),
{out}_k as (select *, min(case when cap * mass > weight * rest then (r, {name}, rest, mass) end) over ({part}) as rate from {out}_o),
{out} as (select *, (case when rate is null or (r, {name}) < (rate[1], rate[2]) then cap else weight * rate[3] // rate[4] end)::bigint as budget from {out}_k)"""


def _weight(level: int, p: mixing.Params) -> str:
    known = sorted(p.weights[level].items())
    return f"(case {mixing.LEVELS[level]} " + " ".join(f"when {_lit(k)} then {v}" for k, v in known) + f" else {p.other} end)" if known else str(p.other)


def _op6(p: mixing.Params = mixing.Params()) -> str:
    return f"""
with d as (select doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint), 0) % 4) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source, len({_WORDS})::bigint as n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {p.max_epochs})::bigint as cap from d group by all),
total as (select (sum(tokens) * {p.share} // 1000)::bigint as pool from leaf),
n1 as (select domain, sum(cap)::bigint as cap, any_value(pool) as pool from leaf, total group by domain),{_pour('n1', '', 'domain', _weight(0, p), 'b1')},
n2 as (select l.domain, l.lang, sum(l.cap)::bigint as cap, any_value(b1.budget) as pool from leaf l join b1 using (domain) group by all),{_pour('n2', 'domain', 'lang', _weight(1, p), 'b2')},
n3 as (select l.*, b2.budget as pool from leaf l join b2 using (domain, lang)),{_pour('n3', 'domain, lang', 'source', _weight(2, p), 'b3')},
e as (select domain, lang, source, coalesce(budget // nullif(tokens, 0), 0) as epochs, budget - tokens * coalesce(budget // nullif(tokens, 0), 0) as rest from b3),
o as (select d.*, epochs, rest, md5('{p.seed}|' || epochs || '|' || coalesce(doc_id::varchar, '')) as place from d join e using (domain, lang, source)),
c as (select *, sum(n_tokens) over (partition by domain, lang, source order by place range between unbounded preceding and current row) as upto from o)
select doc_id, domain, lang, source, n_tokens, (epochs + (upto <= rest)::int)::int as copies from c
"""


def _op7(n_shards: int = 64) -> str:
    table = ",".join(map(str, sharding.fill(sharding.names(n_shards))))
    return f"select doc_id, (string_split(t, ',')[(('0x' || substring(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint % {sharding.SLOTS}) + 1])::int as shard from documents, (select '{table}' as t)"


def _op8(p: quality.Params = quality.Params()) -> str:
    blank = r"[^\x20\x09-\x0D]"
    plain = lambda x: x.replace("1L", "1").replace(" div ", " // ")
    values = {m: plain(r.value) for m, r in quality.METRICS.items()}
    long = " union all ".join(f"select lang, source, '{m}' as metric, ({sql})::bigint as v from s where n_words > 0" for m, sql in (values | quality.SIZES).items())
    at = ", ".join(f"min(bin) filter (upto * 1000 >= total * {k}) as q{k}" for k in quality.LEVELS)
    quart = lambda name, keys: f"""
{name}_m as (select {keys + ',' if keys else ''} metric, bin, sum(n) as n from k group by all),
{name}_c as (select *, sum(n) over (partition by {keys + ',' if keys else ''} metric) as total, sum(n) over (partition by {keys + ',' if keys else ''} metric order by bin) as upto from {name}_m),
{name} as (select {keys + ',' if keys else ''} metric, max(total) as total, {at} from {name}_c group by all)"""  # noqa: E731
    pick = ", ".join(f"case when o.total >= {p.min_group} then o.q{k} when l.total >= {p.min_group} then l.q{k} else a.q{k} end as q{k}" for k in quality.LEVELS)
    wide = ", ".join(f"max(q{k}) filter (metric = '{m}') as {m}_{k}" for m in [*values, *quality.SIZES] for k in quality.LEVELS)
    side = lambda m, r, far, sign, spread: f"{m}_{far} {sign} {r.reach} * greatest({spread}, {plain(r.unit)})"
    high = ", ".join(side(m, r, r.tail, "+", f"{m}_{r.tail} - {m}_500") + f" as {m}_hi" for m, r in quality.METRICS.items())
    low = ", ".join((side(m, r, 1000 - r.tail, "-", f"{m}_500 - {m}_{1000 - r.tail}") if r.low else "-1") + f" as {m}_lo" for m, r in quality.METRICS.items())
    inside = " and ".join(f"({values[m]}) between {m}_lo and {m}_hi" for m in values)
    return f"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, {_WORDS} as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{blank}')) as ls from t),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 4),
h as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c from g),
r as (select doc_id, count(distinct i + j) as n from h, (values (0), (1), (2)) as v(j) where c > 1 group by doc_id),
s as (select doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(ls)::bigint as n_lines,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from w left join r using (doc_id)),
x as ({long}),
k as (select lang, source, metric, case when v < 128 then v else (v >> (length(bin(v)) - 7)) << (length(bin(v)) - 7) end as bin, count(*) as n from x group by all),
{quart('ql', 'lang, source')},{quart('qg', 'lang')},{quart('qa', '')},
f as (select o.lang, o.source, o.metric, {pick} from ql o join qg l on o.lang is not distinct from l.lang and o.metric = l.metric join qa a on o.metric = a.metric),
e as (select lang, source, {wide} from f group by all),
z as (select lang, source, {high}, {low} from e),
y as (select s.*, n_words < {p.min_words} or 100 * n_repeat_words > {p.max_repeat_percent} * n_words as base_failed, ({inside}) as fine from s left join z on s.lang is not distinct from z.lang and s.source is not distinct from z.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(fine, true) as kept from y
"""


ORACLE_SQL: dict[str, str] = {"op1_warc": OP1, "op5_secret_scan": _op5(), "op6_mixing": _op6(), "op7_sharding": _op7(), "op8_quality": _op8()}
