"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from framelake.llm import mixing as M
from framelake.llm import secrets as S


def _spans(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    """CTEs: the pattern's matches in every text with their start and end in code points."""
    quoted = pattern.replace("'", "''")
    return f"""{kind}_p as (
  select doc_id, string_split_regex(text, '{quoted}') as pieces, regexp_extract_all(text, '{quoted}') as found from d where regexp_matches(text, '{quoted}')), {kind}_u as (
  select doc_id, generate_subscripts(pieces, 1) as i, unnest(pieces) as piece, unnest(found) as m from {kind}_p), {kind}_w as (
  select doc_id, m, sum(length(piece)) over w + coalesce(sum(length(m)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as a from {kind}_u window w as (partition by doc_id order by i)), {kind}_s as (
  select doc_id, a::bigint as a, (a + length(m))::bigint as b, {rank} as rank, m from {kind}_w where m is not null and {keep})"""


def scanned_documents() -> str:
    """op1: base spans, then the battery over the other long tokens, with step-up control within length classes."""
    listed = lambda source: f"string_agg(k || ':' || a || ':' || b, ',' order by a, rank) from (select *, ['assign', 'access', 'hex', 'random'][rank + 1] as k from {source})"
    assign = S.ASSIGN.replace("'", "''")
    limits = " + ".join(f"(b - a >= {n})::int" for n in S.LENGTHS)
    alphabet = "case " + " ".join(f"when regexp_full_match(t, '{pattern}') then '{signs}'" for pattern, signs in S.ENCODINGS) + f" else '{S.BASE64}' end"
    classes = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[+/]', '', 'g'), '[A-Z][a-z]', 'aa', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g')"
    p, q, w = S.ORDINARY_CASES, S.ORDINARY_DIGITS, S.WEIGHTS
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents), {_spans("assign", 0, S.ASSIGN, f"length(regexp_extract(m, '{assign}', 2)) >= 12")},
{_spans("access", 1, S.ACCESS)}, {_spans("hex", 2, S.HEX)}, {_spans("token", 3, S.TOKEN)}, base as (
  select * from assign_s union all select * from access_s union all select * from hex_s), cand as (
  select *, {limits} as class, translate(rtrim(m, '='), '-_', '+/') as t, row_number() over () as id from token_s t
  where not exists (select 1 from base b where b.doc_id = t.doc_id and b.a < t.b and t.a < b.b)), coded as (
  select *, {alphabet} as alphabet, {classes} as classes from cand), sign as (
  select id, i, length(alphabet) as size, instr(alphabet, substr(t, i::int, 1)) - 1 as v from coded, unnest(generate_series(1, length(t))) u(i)), pair as (
  select *, lead(v) over (partition by id order by i) as nv from sign), sums as (
  select id, any_value(size) as size, count(*)::double as n, sum((v * 2 >= size)::int)::double as high,
         sum((nv is not null and (v * 2 >= size) <> (nv * 2 >= size))::int)::double as turns, sum((v - (size - 1) / 2.0::double) * (nv - (size - 1) / 2.0::double)) as product from pair group by id), square as (
  select id, sum(c * c)::double as squares from (select id, v, count(*) as c from sign group by all) group by id), step as (
  select id, substr(classes, i::int, 2) as two from coded, unnest(generate_series(1, length(classes) - 1)) u(i)), runs as (
  select id, sum(case when two in ('aA', 'Aa') then 1 when two in ('a0', 'A0', '0a', '0A') then 2 else 0 end)::double as changes, max(contains(two, '0')::int)::double as digits, count(*)::double as m from step group by id), stat as (
  select id, n, size, squares * size / n - n as chi, (size - 1)::double as df, 2 * high * (n - high) as two, turns, product / (n - 1) / ((size * size - 1) / 12.0::double) * sqrt(n - 1) as zs,
         coalesce(changes, 0) as changes, coalesce(digits, 0) as digits, coalesce(m, 1) as m, greatest(size * {S.ORDINARY_COINCIDENCE}::double - 1, {S.LEAST_EXCESS}::double) * n as excess from sums join square using (id) left join runs using (id)), deviate as (
  select *, ((df + excess - chi) / sqrt(2 * (df + 2 * excess)) / {S.SPREAD}::double * {w[0]}::double + (changes - 0.5 - m * ({p}::double + 2 * {q}::double * digits)) / sqrt(m * ({p}::double * {1 - p}::double + 4 * {q}::double * {1 - q}::double * digits)) * {w[1]}::double
         + ({S.ORDINARY_CORRELATION}::double * sqrt(n - 1) - zs) * {w[2]}::double) / {sum(x * x for x in w) ** 0.5}::double as z from stat), test as (
  select id, case when changes > 0 and z > 0 then (z * z / 2 + ln(2)) / ln(10) else 0.0 end as surprise,
         power(greatest(0.0, (power(chi / df, 1.0::double / 3) - (1 - 2.0 / (9.0 * df))) / sqrt(2.0 / (9.0 * df))), 2)
         + power(case when two * (two - n) > 0 then (turns - two / n) / sqrt(two * (two - n) / (n * n * (n - 1))) else 10.0 end, 2) + zs * zs as deviance from deviate), bins as (
  select class, least(floor(surprise * {S._BIN}), {40 * S._BIN})::int as bin, count(*) as n from coded join test using (id) group by all), ranked as (
  select class, bin, sum(n) over (partition by class) as every, sum(n) over (partition by class order by bin desc) as passed from bins), least_v as (
  select class, min(bin) / {S._BIN}.0::double as least from ranked where power(10.0::double, -bin / {S._BIN}.0::double) <= {S.DISCOVERY_RATE} * passed / every group by class), more as (
  select doc_id, a, b, 3 as rank, m from coded join test using (id) join least_v using (class) where surprise >= least and deviance <= {S.BATTERY_LIMIT}), every as (select * from base union all select * from more)
select doc_id, (select count(*) from base s where s.doc_id = d.doc_id and rank = 0) as n_assign, (select count(*) from base s where s.doc_id = d.doc_id and rank = 1) as n_access,
       (select count(*) from base s where s.doc_id = d.doc_id and rank = 2) as n_hex, sha256(coalesce((select {listed("base")} s where s.doc_id = d.doc_id), '')) as base_sha256,
       coalesce((select {listed("every")} s where s.doc_id = d.doc_id), '') as spans, (select count(*) from more s where s.doc_id = d.doc_id) as n_random from d"""


def mixed_documents(repeats: float = 2.0, seed: int = 7, steps: int = 5) -> str:
    """op6: the exponent by a search in PARTS at once, weights, whole passes, and blocks as far as tokens last."""
    number = lambda *parts: "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 15))::bigint"
    search = ", ".join(
        f"""e{k + 1} as (select greatest(low, first - (high - low) / {M.PARTS}) as low, first as high from (
  select low, high, coalesce(min(a) filter ((a - 1) * down + (1 - a) * up <= ln({repeats}::double) + 1e-12), 1.0::double) as first
  from (select low, high, low + (high - low) * i / {M.PARTS} as a from e{k}, unnest(generate_series(0, {M.PARTS})) u(i)), bound group by low, high))"""
        for k in range(steps)
    )
    return f"""with t as (
  select doc_id, source, coalesce(source, chr(0)) as src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens, {number(str(seed), "doc_id::varchar", "text")} as draw from documents), d as (
  select *, draw % {M.BLOCKS} as block from t), b as (select src, block, sum(tokens)::bigint as tokens from d group by all), s as (
  select src, sum(tokens)::bigint as tokens from b group by src), total as (select sum(tokens)::double as t, count(*) as n from s where tokens > 0), bound as (
  select min(ln(tokens / t)) as down, max(ln(tokens / t)) as up from s, total where tokens > 0), e0 as (select 0.0::double as low, 1.0::double as high), {search}, ex as (
  select case when n < 2 then 1.0 else high end as exponent from e{steps}, total), p as (
  select src, tokens, power(tokens / t, exponent) as pw, exponent from s, total, ex), norm as (
  select sum(pw) filter (tokens > 0) as z, max(tokens / pw) filter (tokens > 0) as least from p), plan as (
  select src, exponent, tokens, case when tokens > 0 then pw / z else 0.0 end as weight, round(least * z * (case when tokens > 0 then pw / z else 0.0 end))::bigint as quota from p, norm), plan2 as (
  select *, greatest(1, case when tokens > 0 then quota // tokens else 1 end) as passes from plan), run as (
  select b.src, b.block, b.tokens as bt, row_number() over w - 1 as place, weight, exponent, passes, greatest(0, quota - passes * plan2.tokens) - (sum(b.tokens) over w - b.tokens) as rest
  from b join plan2 on plan2.src = b.src window w as (partition by b.src order by {number(str(seed), "b.src", "b.block::varchar")}, b.block)), inside as (
  select d.src, d.block, d.draw, rest, sum(tokens) as n from d join run on run.src = d.src and run.block = d.block where rest > 0 and rest < bt group by all), last as (
  select src, block, max(draw) as last from (select *, sum(n) over (partition by src, block order by draw) as upto from inside) where upto <= rest group by all)
select doc_id, source, tokens, round(weight, 9) as weight, round(exponent, 9) as exponent, (passes + ((rest >= bt and rest > 0) or coalesce(draw <= last, false))::int)::bigint as n_copies, place as first_block
from d join run on run.src = d.src and run.block = d.block left join last on last.src = d.src and last.block = d.block"""


def rearranged_documents(seed: int = 7, rate: int = 100, spm_rate: int = 50) -> str:
    """op11: lines as a list, parts by slices of it."""
    group = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::ubigint"
    return f"""with t as (
  select doc_id, coalesce(text, '') as x, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as h from documents), l as (
  select *, string_split(x, chr(10)) as s from t), u as (
  select doc_id, x, h, list_concat(list_transform(s[1:len(s) - 1], lambda y: y || chr(10)), case when s[len(s)] <> '' then [s[len(s)]] else [] end) as lines from l), c as (
  select *, len(lines)::bigint as n, ({group(0)} % (len(lines) + 1)::ubigint)::bigint as one, ({group(1)} % (len(lines) + 1)::ubigint)::bigint as two,
    case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or {group(2)} % 100 >= {rate} then 'plain'
      when {group(3)} % 100 < {spm_rate} then 'spm' else 'psm' end as form from u), p as (
  select *, coalesce(list_aggregate(lines[1:least(one, two)], 'string_agg', ''), '') as prefix, coalesce(list_aggregate(lines[least(one, two) + 1:greatest(one, two)], 'string_agg', ''), '') as middle,
    coalesce(list_aggregate(lines[greatest(one, two) + 1:n], 'string_agg', ''), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(x) as restored_sha256
from p"""


def converted_pages(least: int = 100) -> str:
    """op12: what the records say, without the files."""
    return f"""with d as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages), f as (
  select *, case when payload_bytes >= {least} then min(page_id) over (partition by payload_digest) end as first from d)
select page_id, payload_bytes, payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to from f"""


ORACLE_SQL: dict[str, str] = {"op1_scanned_documents": scanned_documents(), "op6_mixed_documents": mixed_documents(), "op11_rearranged_documents": rearranged_documents(), "op12_converted_pages": converted_pages()}
