"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op5_exact_dedup"] = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from d join g using (text_sha256)
"""

#: Links are confirmed by joining on shared shingles; only pairs that share a shingle can link.
SQL["op2_hyperminhash"] = r"""
with recursive w as (
  select doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 1 then case when ws[1] = '' then [] else [ws[1]] end
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as sh from w
), n as (select doc_id, count(*) as n_shingles from s group by 1
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)
), both_ways as (select a, b from e union all select b, a from e
), reach as (
  select doc_id, doc_id as r from documents union select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.r
), c as (select doc_id, min(r) as component_id from reach group by 1)
select d.doc_id, coalesce(n.n_shingles, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join c using (doc_id)
"""


#: The rules, written out for DuckDB's expressions: kind, expression, what a match (hit, at pos in t) must fulfil, the text that is searched.
SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(hit, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6""", "t"),
    ("access", r"AKIA[A-Z0-9]+", "length(hit) >= 20", "t"),
    ("hex", r"[0-9a-f]+", "length(hit) >= 24", "t"),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "true", "t"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "true", "t"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "true", "t"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true", "t"),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", "true", "t"),
)

_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when i % 2 = 1 then ascii(reverse({_DIGITS})[i]) - 48 when ascii(reverse({_DIGITS})[i]) >= 53 then 2 * (ascii(reverse({_DIGITS})[i]) - 48) - 9 else 2 * (ascii(reverse({_DIGITS})[i]) - 48) end)) % 10 = 0"
#: The number that stands for an IBAN, as text: letters are two digits.
_IBAN = "array_to_string(list_transform(string_split(substr(replace(hit, ' ', ''), 5) || left(replace(hit, ' ', ''), 4), ''), lambda c: case when c between '0' and '9' then c else cast(ascii(c) - 55 as varchar) end), '')"
_MOD97 = f"list_reduce(list_prepend(0::bigint, list_transform(string_split({_IBAN}, ''), lambda c: cast(c as bigint))), lambda a, c: (a * 10 + c) % 97) = 1"


def _near(*words: str) -> str:
    """Whether a word begins in the 40 characters before the match."""
    return f"regexp_matches(lower(substr(t, greatest(pos - 40, 0) + 1, pos - greatest(pos - 40, 0))), '(^|[^a-z])({'|'.join(words)})')"


_AGAINST = _near("version", "example", "order", "isbn")
#: Kinds of the contract, then the two that the method adds: what it asks of the words nearby follows from the scores. Where
#: the search looks at the characters around a match, others stand in for those that a word's boundary must tell apart.
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "t"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0", "t"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 14 and 19 and {_LUHN}", "t"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 10 and 15", "t"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", f"{_MOD97} and ({_near('iban', 'account', 'bank')} or not {_AGAINST})", "translate(t, '_', '~')"),
    (
        "ssn",
        r"\b[0-9]{3}A[0-9]{2}A[0-9]{4}\b",
        f"hit[1:3] not in ('000', '666') and hit[1] <> '9' and hit[5:6] <> '00' and hit[8:11] <> '0000' and {_near('ssn', 'social', 'security')} and not {_AGAINST}",
        "translate(regexp_replace(t, '[^0-9-]', ' ', 'g'), '-', 'A')",
    ),
)


def _spans_sql(rules: tuple, base: int) -> str:
    """Spans from the pieces between matches and the matches' lengths."""
    parts = []
    for rank, (kind, pattern, keep, text) in enumerate(rules):
        parts.append(f"""
  select doc_id, {rank} as rank, '{kind}' as kind, pos as start, pos + length(hit) as "end" from (
    select doc_id, t, hits[i] as hit, list_sum(list_transform(pieces[:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0)::bigint as pos
    from (select doc_id, t, hits, pieces, unnest(range(1, len(hits) + 1)) as i from (
      select doc_id, t, regexp_extract_all({text}, '{pattern}') as hits, string_split_regex({text}, '{pattern}') as pieces from d))) where {keep}""")
    names = [r[0] for r in rules[:base]]
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in names)
    joined = "string_agg(kind || ':' || start || ':' || \"end\", ',' order by start, rank)"
    of_base = ", ".join(f"'{k}'" for k in names)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), s as (select doc_id, rank, kind, cast(start as bigint) as start, cast("end" as bigint) as "end" from ({" union all ".join(parts)})),
g as (select doc_id, {counts}, coalesce({joined} filter (where kind in ({of_base})), '') as b, {joined} as spans from s group by 1)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in names)}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""


SQL["op3_secrets"] = _spans_sql(SECRETS, 3)
SQL["op6_pii"] = _spans_sql(PERSONAL, 4)


def _mix_sql() -> str:
    """The same schedule, with ranks and running sums over whole sources, and each source settled to its rounded target."""
    from weftline.llm.mixing import GOLDEN, LEAST_BLOCK, MAX_REPEATS, MOST_SLOTS, SPAN, WEIGHTS

    return f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, md5('mix-1:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as ord from documents
), t as (select sum(size)::bigint as total, greatest({LEAST_BLOCK}, ceil(sum(size) / {MOST_SLOTS}.0))::bigint as block from d
), p0 as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, encode(source)) as rk from d group by 1
), p1 as (select *, (list_value({", ".join(map(str, WEIGHTS))})[(rk - 1) % {len(WEIGHTS)} + 1])::bigint as w, source_size * {MAX_REPEATS} as cap from p0
), p2 as (select *, cap / w as fills, total from p1, t
), p3 as (
  select *, (total - coalesce(sum(cap) over f, 0)) / (sum(w) over () - coalesce(sum(w) over f, 0)) as level from p2 window f as (order by fills, rk rows between unbounded preceding and 1 preceding)
), p4 as (select *, (select arg_min(level, (fills, rk)) from p3 where level <= fills) as water from p3
), p5 as (select *, least(cap::double, water * w) as target from p4
), p6 as (select *, coalesce(floor(sum(target) over (order by rk rows unbounded preceding) / nullif(sum(target) over (), 0) * {SPAN}), 0)::bigint as high from p5
), p7 as (select *, coalesce(lag(high) over (order by rk), 0) as low from p6
), u as (select i, ((i + 1) * {GOLDEN}) % {SPAN} as u from (select unnest(range(0, ceil(total / block::double)::bigint)) as i from t)
), n as (select rk, i as slot, row_number() over (partition by rk order by i) - 1 as no from p7 join u on u >= low and u < high
), p8 as (select *, round(sum(coalesce(target, 0)) over (order by rk rows unbounded preceding))::bigint as upto from p7
), e as (select *, least(upto - coalesce(lag(upto) over (order by rk), 0), cap) as tape_end from p8
), b as (
  select d.doc_id, d.size, e.rk, e.source_size, e.target, e.tape_end, sum(d.size) over (partition by e.rk order by d.ord, d.size, d.doc_id rows unbounded preceding) - d.size as start
  from d join e on d.source is not distinct from e.source
)
select doc_id, size, source_size, target,
  ({" + ".join(f"greatest(0, least(start + {k} * source_size + size, tape_end) - (start + {k} * source_size))" for k in range(MAX_REPEATS))})::bigint as taken,
  case when size > 0 and start < tape_end then coalesce(slot, start // block + (select count(*) from u)) end as first_slot
from b, t left join n on n.rk = b.rk and n.no = b.start // t.block"""


SQL["op10_mix_sources"] = _mix_sql()

#: Words of one document that are equal give the places of each period; islands of them are the runs.
SQL["op11_periodic_runs"] = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, coalesce(text, '') as text,
    xor(list_reduce(list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::bigint), 4294967295::bigint) as h
  from documents
), s as (
  select *, len(ws) as n, h // 10 as g, h % 10 = 0 and len(ws) > 0 as planted from d
), t as (
  select *, case when planted then g % n end as a, case when planted then 1 + (n - g % n) // (3 + g % 8) end as p from s
), w as (
  select doc_id, n, i, case when planted and i >= a then ws[a + (i - a) % p + 1] else ws[i + 1] end as word from (select *, unnest(range(n)) as i from t)
), m as (
  select x.doc_id, y.i - x.i as p, x.i from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), islands as (
  select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) as island from m
), stretches as (
  select doc_id, p, min(i) as start, count(*) + p as length from islands group by doc_id, p, island having count(*) + p >= greatest(6, 4 * p)
), runs as (select doc_id, start, length, min(p) as period from stretches group by all
), best as (
  select doc_id, count(*) as n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as runs_sha256,
    first({'start': start, 'length': length, 'period': period} order by length * 1.0::double / period desc, start, period) as b from runs group by doc_id
), kept as (
  select w.doc_id, string_agg(word, ' ' order by i) as collapsed from w
  where not exists (select 1 from runs r where r.doc_id = w.doc_id and w.i >= r.start + r.period and w.i < r.start + r.length) group by w.doc_id
)
select doc_id, coalesce(n_runs, 0) as n_runs, b.start as start, b.length as length, b.period as period, 1000 * b.length // b.period as exponent_milli,
  coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from d left join best using (doc_id) left join kept using (doc_id)
"""

SQL["op13_fill_middle"] = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens, sha256('1:' || doc_id) as digest from documents
), h as (
  select *, len(tokens) as n, list_transform(range(4), lambda i: ('0x' || substr(digest, 8 * i + 1, 8))::bigint) as h from d
), c as (
  select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form,
    least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b from h
), p as (
  select *, array_to_string(tokens[:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from p
"""
