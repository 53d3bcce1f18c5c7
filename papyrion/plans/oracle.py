"""DuckDB SQL that says what the longer queries of the catalog compute."""

from __future__ import annotations

import re

from papyrion.functions import classify, lang, pii
from papyrion.operators import general, letters, money, ocr


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, '{flags}')"


def trimmed(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def hit(x: str, pattern: str, flags: str = "") -> str:
    flags = flags.replace("m", "m")
    return f"regexp_matches({x}, {lit((f'(?{flags})' if flags else '') + pattern)})"


def cleaned(x: str) -> str:
    return sub(sub(x, r"""["'`)\]}>;:,.!?“”‘’]+$"""), r"""^["'`(<\[{;:,.!?“”‘’]+""")


def distinct(x: str) -> str:
    """A list without the empty text and later copies, in order."""
    return f"list_transform(list_filter(list_transform({x}, lambda v, i: {{'v': v, 'i': i}}), lambda s: s.v <> '' and list_position({x}, s.v) = s.i), lambda s: s.v)"


def spans(x: str, pattern: str) -> str:
    return distinct(f"list_transform(regexp_extract_all({x}, {lit(pattern)}), lambda q: {cleaned('q')})")


WORDS = count("text", r"\b[\w'-]+\b")
WHITE_SPACE = trimmed(sub("array_to_string(list_transform(string_split(text, chr(10)), lambda x: " + sub(sub("x", "[ \\t]+", " "), r"\s+$") + "), chr(10))", r"\n{3,}", "\n\n"))

PARAGRAPHS = f"""
with w as (select doc_id, {WHITE_SPACE} as t from (select doc_id, regexp_replace(text, '([a-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g') as text from documents)),
l as (select doc_id, unnest(list_transform(string_split(t, chr(10)), lambda x, i: {{'i': i, 'x': {trimmed('x')}}})) as r from w),
s as (select doc_id, r.i as i, r.x as x, coalesce(lag(r.x) over (partition by doc_id order by r.i), '') as p from l),
g as (select *, case when x = '' then '' else (case when p = '' or regexp_matches(p, '[.!?:,;]\\s*$') or length(p) <= 40 or not (regexp_matches(x, '^[a-z]') or regexp_matches(x, '(?i)^(and|or|but|the|a|an|in|on|with|for|to)\\s')) then chr(10) || chr(10) else ' ' end) || x end as o from s)
select doc_id, length(t)::bigint as n_chars, md5(t) as digest from (select doc_id, regexp_replace(string_agg(o, '' order by i), '^\\n\\n', '') as t from g group by doc_id)
"""

_STEM = sub("w", "(?:[^laeiouy]es|ed|[^laeiouy]e)$", flags="")
READABILITY = f"""
with a as (select doc_id, {sub('text', r'\s+', ' ')} as f, regexp_extract_all(text, {lit(r"\b[\w'-]+\b")}) as ws from documents),
b as (select doc_id, greatest(1, case when {trimmed('f')} = '' then 0 else 1 + {count('f', r'[.!?]\s+[A-Z0-9]')} end)::double as s, greatest(1, len(ws))::double as n,
  greatest(1, coalesce(list_sum(list_transform(list_transform(ws, lambda v: {sub('lower(v)', '[^a-z]')}), lambda w: case when w = '' then 0 when length(w) <= 3 then 1 else greatest(1, {count(_STEM, '[aeiouy]{1,2}')}) end)), 0))::double as y from a)
select doc_id, greatest(0.0::double, least(100.0::double, floor((206.835::double - 1.015::double * (n / s) - 84.6::double * (y / n)) * 10 + 0.5) / 10)) as score,
  greatest(0.0::double, floor((0.39::double * (n / s) + 11.8::double * (y / n) - 15.59::double) * 10 + 0.5) / 10) as grade from b
"""
SPANS = f"select doc_id, len(s)::bigint as n_spans, md5(array_to_string(s, '|')) as digest from (select doc_id, {spans('text', r'\S+[.,;:!?)]+')} as s from documents)"


def language(select: str) -> str:
    def score(words: list[str]) -> str:
        return " + ".join(f"least(10, {count('t', rf'\b{w}\b')})" for w in words)

    rows = [(i, c, n, w) for i, (c, n, w) in enumerate(lang.latin_words()) if w]
    scores = ", ".join(f"{score(w)} as s{i}" for i, _, _, w in rows)
    best = f"greatest({', '.join(f's{i}' for i, *_ in rows)})"
    code = "case " + " ".join(f"when s{i} = {best} then '{c}'" for i, c, _, _ in rows) + " end"
    tokens = f"lower(array_to_string(regexp_extract_all(substring(text, 1, {lang.SAMPLE}), {lit(lang.TOKEN)}), ' '))"
    return f"with a as (select doc_id, lang, {tokens} as t from documents), b as (select doc_id, lang, {scores} from a), found as (select doc_id, lang, case when {best} >= 8 then {code} else 'en' end as code, case when {best} >= 15 then 'high' when {best} >= 8 then 'medium' else 'low' end as confidence from b) {select}"


def pii_counts(table: str, keys: str) -> str:
    cols = ", ".join(f"{count('text', ('(?i)' if 'i' in f else '') + p)}::bigint as n_{k}" for k, p, f, _ in pii.PATTERNS if k != "national_id")
    return f"select {keys}, {cols} from {table}"


SIGNALS = ["contact_block", "line_items", "numbered_clauses", "whereas", "abstract", "references", "grade_table", "reference_ranges", "financial_table", "salutation"]


def _signals() -> dict[str, str]:
    h = "lower(substring(text, 1, 500))"
    t = "text"
    return {
        "contact_block": f"{hit(h, '[a-z]+ [a-z]+')} and ({hit(h, r'[\w.+-]+@[\w-]+\.[\w.]+')} or {hit(h, r'\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})')} or {hit(h, r'\+?\d[\d\s-]{7,}')})",
        "line_items": f"{hit(t, r'\d+\s*(?:x|@|×)\s*\$?[\d,.]+|\$[\d,.]+\s*(?:each|per|/)', 'i')} or {hit(t, r'(?:qty|quantity)\s*[:.]\s*\d', 'i')}",
        "numbered_clauses": f"{hit(t, r'^\s*(?:section|article|clause)\s+\d+', 'im')} or {hit(t, r'^\s*\d+\.\s+[A-Z]', 'm')}",
        "whereas": hit(t, r"\bWHEREAS\b", "i"),
        "abstract": f"{hit(t, r'(?:^|\n)\s*(?:abstract|summary)\s*[:\n]', 'i')} and {hit(t, r'(?:^|\n)\s*(?:abstract|summary)\s*[:\n]?\s*(?:[\s\S]{50,500}?)(?:\n\s*(?:introduction|keywords|1\.|1[.\s]introduction))', 'i')}",
        "references": f"{hit(t, r'(?:^|\n)\s*(?:references|bibliography|works cited)\s*[:\n]', 'i')} or {hit(t, r'\[\d+\]')}",
        "grade_table": f"{hit(t, r'(?:[A-Z]{2,4}\s+\d{3}|[A-Z]{2,4}\s+\d{2}[A-Z]?)\s+.*?\s+(?:A|B\+?|C\+?|D|F|P|NP|W)\b', 'i')} or ({hit(t, '(?:GPA|grade point)', 'i')} and {hit(t, '(?:semester|term|quarter)', 'i')})",
        "reference_ranges": f"{hit(t, r'\d+\.?\d*\s*[-–—]\s*\d+\.?\d*\s*(?:mg|g|ml|l|mmol|iu|u/l|%)', 'i')} or {hit(t, r'(?:normal|abnormal|critical|high|low)\s*(?:range|value|result)', 'i')}",
        "financial_table": f"{hit(t, r'(?:total assets|total liabilities|shareholders?.*equity)', 'i')} or ({hit(t, r'(?:revenue|net income|gross profit).*?\$[\d,]+', 'im')} and {hit(t, r'(?:operating expenses|cost of goods|ebitda)', 'i')})",
        "salutation": hit(t, r"(?:^|\n)\s*(?:Dear|To|Respected)\s+(?:Mr|Mrs|Ms|Dr|Prof|Sir|Madam)", "im"),
    }


_HEADERS = (
    f"list_transform(list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 80), lambda x: {trimmed('x')}), lambda x: {hit('x', r'''^(?:#{1,4}\s+)?[A-Z][A-Z\s&/'-]{2,30}$''')} or ({hit('x', r'^(?:#{1,4}\s+)?[A-Z][a-z]+(?: [A-Z][a-z]+){1,5}$')} and length(x) < 40)), lambda x: {sub('x', r'^#+\s*', flags='')})"
)


def signals() -> str:
    return "select doc_id, " + ", ".join(f'({q}) as "{n}"' for n, q in _signals().items()) + f", len({_HEADERS})::bigint as n_headers from documents"


def classification(select: str) -> str:
    signs = ", ".join(f'({q}) as "{n}"' for n, q in _signals().items())
    raw = f"len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
    scores = []
    for k in classify.TYPES:
        kws = classify.KEYWORDS[k].split("|")
        hits = " + ".join(f"{hit('low', rf'\b{re.escape(w)}\b'.replace('\\ ', ' ').replace('\\-', '-').replace('\\#', '#'))}::int" for w in kws)
        points, pattern, each, most = classify.BONUS[k]
        bonus = " + ".join([f'(case when "{n}" then {p} else 0 end)' for n, p in points.items()] + ([f"least({most}, {each} * len(list_filter(headers, lambda h: {hit('h', pattern, 'i')})))"] if pattern else []))
        scores.append(f"(({hits})::double / {len(kws)} * 100) * lf + least({classify.MAX_BONUS}, {bonus}) as s_{k}")
    best = f"greatest({', '.join(f's_{k}' for k in classify.TYPES)})"
    top = "case " + " ".join(f"when s_{k} = {best} then '{k}'" for k in classify.TYPES) + " end"
    rules = " ".join(f"when top = '{k}' and {' and '.join([*[f'"{n}"' for n in yes], *[f'not "{n}"' for n in no]])} then {p}" for k, yes, no, p in classify.PENALTIES)
    return f"""
with a as (select doc_id, text, lower(text) as low, {raw} as n, {_HEADERS} as headers, {signs} from documents),
b as (select *, (case when n < 15 then 0.3 when n < 30 then 0.6 when n < 80 then 0.85 else 1.0 end)::double as lf from a),
c as (select *, {', '.join(scores)} from b),
d as (select *, {top} as top, {best} as best from c),
e as (select doc_id, n, top, greatest(0, least(100, floor((best - (case {rules} else 0 end)) / {classify.SCALE} * 100 + 0.5)))::bigint as raw from d),
f as (select doc_id, top, case when n < 50 then least(raw, 30) else raw end as confidence from e),
verdict as (select doc_id, case when confidence < {classify.THRESHOLD} then 'general' else top end as kind, confidence from f) {select}"""


def filenames() -> str:
    rules = " ".join(f"when {hit('lower(name)', p)} then '{k}'" for p, k, _, _ in classify.FILENAME_RULES)
    return f"select case {rules} else 'none' end as kind, count(*) as n from (select p_name as name from part union all select url from pages) group by 1"


ENTITIES = f"""
with a as (select doc_id, {spans('text', money.DATE)} as d, {spans('text', money.EMAIL)} as e, {spans('text', general.URL)} as u, {spans('text', general.PRICE)} as m,
  list_filter(regexp_extract_all(text, {lit(letters.PHONE)}), lambda p: length({sub('p', r'\D')}) >= 10) as q from documents),
b as (select *, {distinct(f"list_transform(q, lambda v: {cleaned('v')})")} as p from a)
select doc_id, len(d)::bigint as n_dates, len(e)::bigint as n_emails, len(u)::bigint as n_urls, len(m)::bigint as n_money, len(p)::bigint as n_phones, array_to_string(list_concat(list_concat(list_concat(list_concat(d, e), u), m), p), '|') as entities from b
"""

_MD = hit("x", r"^#{1,6}\s+.+$")
_CAPS = f"(length(x) between 4 and 79 and {hit('x', general.CAPS)} and not ends_with(x, '.') and len(regexp_split_to_array(x, '\\s+')) <= 8)"
OUTLINE = f"""
with a as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {trimmed('x')}), lambda x: {_MD} or {_CAPS}) as r from documents),
b as (select doc_id, list_transform(r, lambda x: case when {_MD} then {{'l': length(regexp_extract(x, '^(#{{1,6}})\\s+(.+)$', 1)), 'h': {trimmed("regexp_extract(x, '^(#{1,6})\\s+(.+)$', 2)")}}} else {{'l': 1, 'h': x}} end) as o from a),
c as (select doc_id, o, list_transform(o, lambda s: s.h) as hs from b),
d as (select doc_id, list_slice(list_transform(list_filter(list_transform(o, lambda s, i: {{'s': s, 'i': i}}), lambda z: list_position(hs, z.s.h) = z.i), lambda z: z.s.l || ':' || z.s.h), 1, 100) as k from c)
select doc_id, len(k)::bigint as n_headings, md5(array_to_string(k, '|')) as digest from d
"""
ORDERS = "select o_orderkey::varchar as o_orderkey, o_orderstatus, printf('%.2f', o_totalprice) as o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, case when o_orderkey % 3 = 0 then o_orderpriority end as o_orderpriority from orders"


def profile(source: str, columns: list[str]) -> str:
    from papyrion.operators.spreadsheet import TYPE_RULES

    def kind(c: str) -> str:
        rules = " ".join(f"when count({c}) > 0 and bool_and({hit(c, p.replace(chr(92) + 'z', '$'))}) filter ({c} is not null) then '{t}'" for t, p in TYPE_RULES)
        return f"case {rules} else 'text' end"

    return " union all ".join(f"select {i}::bigint as pos, '{c}' as column, {kind(c)} as type, count(*)::bigint as n_rows, (count(*) - count({c}))::bigint as n_null from ({source})" for i, c in enumerate(columns))


_ASKS = hit("s", "|".join(letters.REQUESTS), "i")
_REQ = f"list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {trimmed('s')}), lambda s: length(s) between 10 and 300 and {_ASKS}), lambda s: {trimmed(sub('s', r'\s+', ' '))}), lambda s: length(s) >= 10)"
REQUESTS = f"select conv_id, turn, len(k)::bigint as n_requests, md5(array_to_string(k, '|')) as digest from (select conv_id, turn, list_slice({distinct('q')}, 1, 5) as k from (select conv_id, turn, {_REQ} as q from conversations))"


def letter_types() -> str:
    rules = " ".join(f"when {hit('lower(text)', p)} then '{k}'" for k, _, p in letters.LETTER_TYPES)
    return f"select case {rules} else 'general' end as kind, count(*) as n from conversations group by 1"


_LINE = f"array_to_string(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''), ' ')"
LAYOUT = f"""
with a as (select doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')), lambda x: {_LINE}) as l from documents),
b as (select doc_id, unnest(list_transform(l, lambda x, i: {{'i': i, 'x': x}})) as r from a),
c as (select doc_id, (r.i - 1) // 40 as page, string_agg(r.x, chr(10) order by r.i) as t from b group by all),
d as (select doc_id, string_agg(t, chr(10) || chr(10) order by page) as t from c group by doc_id)
select doc_id, length(t)::bigint as n_chars, md5(t) as digest, 0::bigint as n_headings, 12.0::double as body_size from d
"""


def ocr_score() -> str:
    known = "[" + ", ".join(f"'{w}'" for w in ocr.COMMON_WORDS) + "]"
    rate = lambda test: f"(len(list_filter(bare, lambda x: {test}))::double / nullif(len(bare), 0))"
    solid = f"length({sub('x', '[aeiouy]')})"
    return f"""
a as (select *, {trimmed('text')} as t from src),
b as (select *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') as tokens from a),
c as (select *, list_filter(list_transform(tokens, lambda x: lower({sub('x', '[^a-zA-Z]')})), lambda x: x <> '') as bare from b),
d as (select *, {rate(f'list_contains({known}, x)')} as hits, {rate('length(x) <= 2')} as short, {rate(f'length(x) >= 3 and (length(x) - {solid})::double / length(x) < 0.15 and {solid} >= 3')} as cluster from c),
e as (select *, case when len(tokens) = 0 then 1.0 when len(tokens) = 1 and length(tokens[1]) <= 3 then 0.3 when len(tokens) = 1 and {count('tokens[1]', r'\d')} >= 4 then 0.0 when len(tokens) = 1 and length(tokens[1]) > 5 and not {hit('tokens[1]', '[aeiouy]', 'i')} then 0.8 when len(bare) = 0 then 1.0
  else greatest(0.0, least(1.0, (case when hits < 0.1 then 0.5 when hits < 0.25 then 0.3 when hits < 0.4 then 0.1 else 0.0 end) + (case when hits >= 0.5 then -0.3 else 0.0 end) + (case when short > 0.7 then 0.3 when short > 0.5 then 0.15 else 0.0 end) + (case when cluster > 0.5 then 0.3 when cluster > 0.3 then 0.15 else 0.0 end) + (case when {hit('t', r'^[A-Z\s]+$')} and hits < 0.3 then 0.2 else 0.0 end))) end as g from d)"""


def ocr_lines() -> str:
    return f"with src as (select conv_id as doc_id, turn as line_no, text, ((conv_id * 7 + turn * 17) % 101)::double as confidence from conversations), {ocr_score()}, f as (select *, confidence < 30 or g > 0.5 or (confidence < 50 and g > 0.3) as noise from e)"


def ocr_query() -> str:
    return f"{ocr_lines()} select doc_id, count(*) as n_lines, count(*) filter (noise) as n_noise, md5(coalesce(string_agg(text, chr(10) order by line_no) filter (not noise), '')) as high, md5(coalesce(string_agg(text, chr(10) order by line_no) filter (noise), '')) as low, floor((case when sum(length(text)) > 0 then coalesce(sum(length(text)) filter (not noise), 0)::double / sum(length(text)) else 1.0 end) * 1e6 + 0.5) / 1e6 as high_ratio, floor(coalesce(avg(confidence) filter (not noise), 0) * 1e6 + 0.5) / 1e6 as mean_confidence from f group by doc_id"
