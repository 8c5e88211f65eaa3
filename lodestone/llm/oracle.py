"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _spans(kind: str, order: int, rx: str, group: int = 0) -> str:
    """doc rows -> (rid, start, k, stop, kind, value), from the texts between matches."""
    rx = rx.replace("'", "''")
    return f"""
    select rid, cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) as bigint) as start,
           {order} as k, length(hits[i]) as len, '{kind}' as kind, vals[i] as value, hits[i] as hit
    from (select rid, hits, vals, gaps, unnest(range(1, len(hits) + 1)) as i
          from (select rid, regexp_extract_all(text, '{rx}') as hits, regexp_extract_all(text, '{rx}', {group}) as vals,
                       regexp_split_to_array(text, '{rx}') as gaps
                from d where regexp_matches(text, '{rx}')))"""


_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ROWS = "d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(source, '') as source from documents)"

OP4 = f"""
with {_ROWS},
s as (select * from (
  {_spans("assign", 0, _ASSIGN, 2)} union all {_spans("access", 1, "AKIA[A-Z0-9]+")} union all {_spans("hex", 2, "[0-9a-f]{24,}")}
  union all {_spans("forge", 3, "gh[opsu]_[A-Za-z0-9]{20,}")} union all {_spans("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}")}
  union all {_spans("pem", 5, "-----BEGIN [A-Z ]*PRIVATE KEY-----")})
  where length(value) >= case kind when 'assign' then 6 when 'access' then 20 when 'hex' then 24 when 'forge' then 24 else 20 end),
o as (select s.value, count(distinct split_part(d.source, '/', 1)) as owners, count(distinct d.source) as repos from s join d using (rid) group by s.value),
j as (select s.*, kind || ':' || start || ':' || (start + len) as span,
        case when owners >= 3 or owners > 1 and repos >= 5 then 'example'
             when owners = 1 and length(s.value) >= 16 and regexp_matches(s.value, '[0-9]') and regexp_matches(s.value, '[A-Za-z]')
                  and len(list_distinct(string_split(s.value, ''))) >= 8 then 'live' else 'unclear' end as verdict
      from s join o on s.value = o.value),
g as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        coalesce(string_agg(span, ',' order by start, k) filter (k < 3), '') as base, string_agg(span, ',' order by start, k) as spans,
        count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example, count(*) filter (verdict = 'unclear') as n_unclear
      from j group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example, coalesce(n_unclear, 0) as n_unclear
from d left join g using (rid)
"""

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD = r"[0-9]([\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
_D = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, length(dig) + 1), lambda i: case when i % 2 = 1 then cast(substr(reverse(dig), i, 1) as integer)
  else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(substr(reverse(dig), i, 1) as integer) + 1] end)) % 10 = 0"""
_MOD97 = """list_reduce(list_concat([0], list_transform(string_split(substr(replace(value, ' ', ''), 5) || substr(value, 1, 4), ''), lambda c: case when c between '0' and '9' then ascii(c) - 48 else ascii(c) + 45 end)),
  lambda a, x: case when x < 10 then (a * 10 + x) % 97 else (a * 100 + x - 100) % 97 end) = 1"""


def _score() -> str:
    from .pii import SCORES, WORD

    return " ".join(
        f"when '{kind}' then case when regexp_matches(nearby, '{WORD.format(words)}') then {prior + check + gain} else {prior + check} end" for kind, (prior, check, gain, words) in SCORES.items()
    )


OP6 = f"""
with {_ROWS},
c as (select *, {_D} as dig from (
  {_spans("email", 0, _EMAIL)} union all {_spans("ip", 1, _IP)} union all {_spans("card", 2, _CARD)} union all {_spans("phone", 3, _PHONE)}
  union all {_spans("iban", 4, _IBAN)})),
s as (select c.rid, start, k, len, kind, kind || ':' || start || ':' || (start + len) as span,
        lower(case when start <= 41 then ' ' else '' end || substr(d.text, cast(greatest(start - 41, 0) + 1 as bigint), cast(least(start, 41) as bigint))
          || ' ' || substr(d.text, cast(start + len + 1 as bigint), 41) || case when length(d.text) - start - len <= 41 then ' ' else '' end) as nearby
      from c join d using (rid)
      where case kind when 'email' then true
        when 'ip' then len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast(right(p, 9) as integer) > 255)) = 0
        when 'card' then case when length(dig) between 12 and 19 then {_LUHN} else false end
        when 'phone' then length(dig) between 9 and 15
        else {_MOD97} end),
g as (select rid, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card,
        count(*) filter (kind = 'phone') as n_phone, count(*) filter (kind = 'iban') as n_iban,
        coalesce(string_agg(span, ',' order by start, k) filter (k < 4), '') as base, string_agg(span, ',' order by start, k) as spans,
        string_agg(score, ',' order by start, k) as span_scores, cast(sum(score) as double) / 100 as score_sum
      from (select *, case kind {_score()} end as score from s) group by rid)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_iban, 0) as n_iban,
  coalesce(span_scores, '') as span_scores, coalesce(score_sum, cast(0 as double)) as score_sum
from d left join g using (rid)
"""

_NIBBLES = "translate(left(md5(cast(doc_id as varchar)), 16), '0123456789abcdef', 'ghijklmnopqrstuv')"
for _n, _c in enumerate("ghijklmnopqrstuv"):
    _NIBBLES = f"replace({_NIBBLES}, '{_c}', '{_n:04b}')"

OP5 = f"""
with r as (select doc_id, coalesce(strlen(text), 0) as n_bytes, {_NIBBLES} as h from documents),
t as (select d, left(h, d) as p, sum(n_bytes) as b, count(*) as n from r, (select unnest(range(0, 65)) as d) group by all),
leaf as (select t.* from t left join t u on u.d = t.d - 1 and u.p = left(t.p, t.d - 1)
         where (t.d = 0 or u.b > {1 << 20} and u.n > 1) and (t.b <= {1 << 20} or t.n = 1 or t.d = 64))
select r.doc_id, r.n_bytes, leaf.p as shard, cast(leaf.d as integer) as depth, cast(leaf.b as bigint) as shard_bytes, leaf.n as shard_rows, leaf.b > {1 << 20} as oversized
from r join leaf on left(r.h, leaf.d) = leaf.p
"""

ORACLE_SQL = {"op4_secret_scan": OP4, "op5_extendible_shards": OP5, "op6_personal_data": OP6}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_sql(docs: str, width: int) -> str:
    """CTEs that end in ``near(doc_id, n_shingles, component_id)`` over ``docs``."""
    return f"""
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') as w from {docs}),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as i from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from pair join n p on p.doc_id = x join n q on q.doc_id = y where 100 * i >= 80 * (p.n + q.n - i)),
step as (select x, y from link union all select y, x from link),
reach(id, node) as (select doc_id, doc_id from w union select reach.id, step.y from reach join step on reach.node = step.x),
near as (select w.doc_id, coalesce(n, 0) as n_shingles, c as component_id from w left join n using (doc_id) join (select id, min(node) as c from reach group by id) r on r.id = w.doc_id)"""


ORACLE_SQL["op2_near_duplicates"] = f"with recursive {near_sql('documents', 4)} select *, doc_id = component_id as kept from near"
