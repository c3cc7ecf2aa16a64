"""What ``op1_pii`` returns, as DuckDB SQL.

Its regular expressions have no look-around, so candidates are matched more widely and narrowed afterwards: maximal
runs of digits to card lengths, maximal runs of digits and dashes to the form of a social security number.
"""

from palimpsest.llm.pii import BASE, CONTEXT, KINDS

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"[0-9-]+",
}
_RAW = " union all ".join(
    f"select row, doc_id, text, '{k.name}' as kind, {i} as ord, {k.prior} as prior, {k.lift} as lift, {k.least} as least, '(^|[^a-z])({k.context})([^a-z]|$)' as words, "
    f"string_split_regex(text, '{_PATTERNS[k.name]}') as pieces, regexp_extract_all(text, '{_PATTERNS[k.name]}') as ms from t"
    for i, k in enumerate(KINDS)
)
_COUNTS = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)
_LIST = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord){}, '')"
SQL = rf"""
with t as (select doc_id, coalesce(text, '') as text, row_number() over () as row from documents),
raw as ({_RAW}),
found as (select row, text, kind, ord, prior, lift, least, words, i, pieces[i] as piece, ms[i] as m from raw, unnest(range(1, len(ms) + 1)) as u(i)),
placed as (select *, cast(sum(length(piece)) over w + sum(length(m)) over w - length(m) as bigint) as start, regexp_replace(m, '[^0-9]', '', 'g') as digits, replace(m, ' ', '') as bare
           from found window w as (partition by row, ord order by i rows unbounded preceding)),
narrowed as (select *, start + length(m) as stop from placed
             where (kind <> 'card' or length(digits) between 12 and 19) and (kind <> 'ssn' or regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}'))),
beside as (select *, greatest(coalesce(lag(stop) over w, 0), start - {CONTEXT}) as lo, least(coalesce(lead(start) over w, length(text)), stop + {CONTEXT}) as hi
           from narrowed window w as (partition by row, ord order by start)),
valid as (select *, round(prior + case when regexp_matches(lower(substr(text, lo + 1, start - lo)), words) or regexp_matches(lower(substr(text, stop + 1, hi - stop)), words) then lift else 0 end, 3) as score
  from beside where case kind
    when 'ip' then list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast(nullif(ltrim(x, '0'), '') as int), 0) <= 255))
    when 'card' then list_sum(list_transform(range(1, length(digits) + 1), lambda j: (1 + (j - 1) % 2) * cast(substr(digits, length(digits) - j + 1, 1) as int)
                                                 - case when j % 2 = 0 and substr(digits, length(digits) - j + 1, 1) > '4' then 9 else 0 end)) % 10 = 0
    when 'phone' then length(digits) between 9 and 15
    when 'iban' then list_reduce(list_transform(string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: case when c >= 'A' then ascii(c) - 55 else ascii(c) - 48 end),
                                 lambda a, x: (a * case when x > 9 then 100 else 10 end + x) % 97, 0) = 1
    else true end),
kept as (select * from valid where score >= least),
per as (select row, {_COUNTS}, sha256({_LIST.format(f" filter (ord < {len(BASE)})")}) as base_sha256, {_LIST.format("")} as spans,
               coalesce(string_agg(cast(cast(score as double) as varchar), ',' order by start, ord), '') as scores from kept group by row)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)}, coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores
from t left join per using (row)
"""
