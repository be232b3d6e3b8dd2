"""The registered queries in SQL, for checks against another engine."""

from __future__ import annotations

from framelake.functions.vocabulary import COLOR_WORDS, COLORS, LABEL_WORDS, SIZE_WORDS, SUPPORTED_LABELS

_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_values = lambda words: ", ".join(f"('{a}', '{b}')" for a, b in words.items())
SHIFT = 26 * 31_557_600

FRAMES = """frames_v as (
  select 'f' || o_orderkey as id, o_orderkey as seq, (o_orderkey % 60)::double as timestamp, 'clip_' || (o_custkey % 200) as source_clip,
         'cam' || (o_custkey % 8) as camera, case when o_orderstatus <> 'P' then round(epoch(o_orderdate)) + o_orderkey % 86400 end::double as wall_time
  from orders)"""

DETECTIONS = f"""det as (
  select 'f' || l_orderkey as frame_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as det_idx,
         {_list(SUPPORTED_LABELS)}[(l_partkey % 9 + 1)::int] as label, 0.4::double + l_discount * 5 as confidence, l_quantity * 20 * (l_quantity * 10) as area,
         {_list(COLORS)}[(l_suppkey % 11 + 1)::int] as color
  from lineitem), sized as (
  select *, case when area / 921600.0::double >= 0.40 then 'huge' when area / 921600.0::double >= 0.20 then 'large' when area / 921600.0::double >= 0.08 then 'medium'
                 when area / 921600.0::double >= 0.02 then 'small' else 'tiny' end as size from det), kept as (
  select * from sized where confidence >= 0.5 and area / 921600.0::double >= 0.005), tags_v as (
  select distinct frame_id, tag from (
    select frame_id, label as tag from kept union all
    select frame_id, color || ' ' || label from kept where color <> 'unknown' union all
    select frame_id, size || ' ' || label from kept where size in ('large', 'huge')))"""

INDEX = f"""{FRAMES}, {DETECTIONS}, agg as (
  select frame_id, list(label order by det_idx) as labels, list(color order by det_idx) as colors, count(*) as n_objects, round(round(avg(confidence), 9), 4) as conf
  from kept group by frame_id), tag_agg as (select frame_id, string_agg(tag, '|' order by tag) as tags, string_agg(tag, ' ' order by tag) as words from tags_v group by frame_id), ix as (
  select f.*, coalesce(a.n_objects, 0) as n_objects, coalesce(a.conf, 0.0) as conf, coalesce(a.labels, []::varchar[]) as labels, coalesce(a.colors, []::varchar[]) as colors,
         coalesce(t.tags, '') as tags, coalesce(t.words, f.id) as words
  from frames_v f left join agg a on a.frame_id = f.id left join tag_agg t on t.frame_id = f.id)"""

QUERIES = f"""q as (
  select query_id, case when length(query_id) % 2 = 0 then query_id || ' ' || {_list(SUPPORTED_LABELS)}[(length(query_id) % 9 + 1)::int] else query_id end as text
  from (select distinct p_name as query_id from part)), words_v as (
  select distinct query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from q), parsed as (
  select w.query_id, c.b as color, case when c.b is null then l.b end as label, case when c.b is null and l.b is null then s.b end as size
  from words_v w left join (values {_values(COLOR_WORDS)}) c(a, b) on c.a = w.word
  left join (values {_values(LABEL_WORDS)}) l(a, b) on l.a = w.word left join (values {_values(SIZE_WORDS)}) s(a, b) on s.a = w.word), asked as (
  select query_id, coalesce(list(distinct label) filter (label is not null), []) as labels, coalesce(list(distinct color) filter (color is not null), []) as colors,
         coalesce(list(distinct size) filter (size is not null), []) as sizes from parsed group by query_id), typed as (
  select *, (len(labels) > 0)::int + (len(colors) > 0)::int + (len(sizes) > 0)::int as types from asked)"""


def _features(source: str, key: str, text: str, out: str) -> str:
    """CTEs: distinct keys' features with their counts and buckets, and squared lengths."""
    return f"""{out}_w as (select {key} as k, unnest(regexp_extract_all(lower({text}), '[a-z]+')) as w from {source}), {out}_f as (
  select k, '$' || w as f from {out}_w union all
  select k, substr(w, i, 2) from {out}_w, unnest(generate_series(1, length(w) - 1)) u(i) where length(w) > 2), {out}_b as (
  select k, ('0x' || substr(md5(f), 1, 8))::bigint % 512 as b, count(*) as n from {out}_f group by all), {out}_l as (
  select k, sqrt(sum(n * n)::double) as len from {out}_b group by k)"""


COVER = """(coalesce(list_contains(t.labels, k.label), false))::int + (coalesce(list_contains(t.colors, k.color), false))::int + (coalesce(list_contains(t.sizes, k.size), false))::int"""

PAIRS = f"""hits as (
  select t.query_id, k.frame_id, k.det_idx, k.label, k.color, k.size, {COVER} as covered, list_contains(t.labels, k.label)::int as label_hit, t.types
  from kept k, typed t), top as (
  select query_id, frame_id, max(covered) as covered, count(*) filter (covered >= types) as full_n, count(*) as n,
         arg_max({{'label': label, 'color': color, 'size': size}}, [covered, label_hit, -det_idx]) as best
  from hits where types > 0 group by query_id, frame_id), pairs as (
  select t.query_id, t.types, x.id, x.seq, x.wall_time, x.labels, x.colors, x.conf, t.labels as ql, t.colors as qc, t.sizes as qs, best, coalesce(top.covered, 0) as covered,
         case when top.covered > 0 then top.covered::double / t.types else 0.0 end as structure,
         case when top.full_n > 0 then ln(1 + top.full_n::double) / ln(2 + top.n::double) else 0.0 end as dominance
  from ix x cross join typed t left join top on top.query_id = t.query_id and top.frame_id = x.id)"""


def _hybrid(order: str = "score desc", where: str = "true", labels: str = "[]::varchar[]", weight: str = "1.0") -> str:
    """The whole search; `order` sorts a query's frames, `where` keeps frames, `labels` are the requested ones, `weight` is that of a frame's text."""
    share = lambda s: f"1 / (60.0::double + rank() over (partition by query_id order by {s} desc) + (count(*) over (partition by query_id, {s}) - 1) / 2.0::double)"
    match = lambda q, f: f"case when types = 0 then 0.0 when len({q}) = 0 then 1.0 when covered > 0 then list_contains({q}, best.{f})::int / len({q})::double else 0.0 end"
    return f"""with {INDEX}, {QUERIES}, {_features("q", "query_id", "text", "qv")}, {_features("ix", "id", "words", "fv")}, {PAIRS}, dot as (
  select a.k as query_id, b.k as id, sum(a.n * b.n)::double as d from qv_b a join fv_b b on a.b = b.b group by all), sem as (
  select d.query_id, d.id, d.d / (x.len * y.len) as s from dot d join qv_l x on x.k = d.query_id join fv_l y on y.k = d.id), sig as (
  select p.* exclude (structure, dominance), round(p.structure, 6) as structure, round(p.dominance, 6) as dominance, round(coalesce(s.s, 0.0) * {weight}, 6) as semantic
  from pairs p left join sem s using (query_id, id) where {where}), fused as (
  select *, case when types > 0 then {share("structure")} + {share("semantic")} + {share("dominance")} else {share("semantic")} end as f from sig), scored as (
  select *, round(f / max(f) over (partition by query_id) * (0.99 + 0.01::double * conf) * case when len({labels}) = 0 or list_has_any({labels}, labels) then 1.0 else 0.2 end, 6) as score from fused), placed as (
  select *, row_number() over (partition by query_id order by {order}, seq) as rank from scored)
select query_id, rank, id, score, round({match("ql", "label")}, 4) as label_match, round({match("qc", "color")}, 4) as color_match, round({match("qs", "size")}, 4) as size_match,
       structure, dominance, semantic, conf as quality from placed where rank <= 10"""


ORACLE_SQL: dict[str, str] = {
    "index_stats": f"""with {INDEX} select count(*) as total_frames, count(distinct source_clip) as total_clips, sum(n_objects)::bigint as total_objects,
       round(round(avg(conf) filter (conf <> 0), 9), 4) as avg_detection_confidence, string_agg(distinct camera, ',' order by camera) as cameras, min(wall_time) as time_min, max(wall_time) as time_max from ix""",
    "label_counts": f"with {DETECTIONS} select label, count(*) as n from kept group by label",
    "color_counts": f"with {DETECTIONS} select color, count(*) as n from kept group by color",
    "tag_counts": f"with {DETECTIONS} select tag, count(*) as n from tags_v group by tag",
    "clip_counts": f"""with {FRAMES}, {DETECTIONS} select source_clip as clip, label, count(*) as n from kept join frames_v on id = frame_id group by all
       union all select distinct source_clip, null, 0 from frames_v where source_clip not in (select source_clip from kept join frames_v on id = frame_id)""",
    "all_counts": f"""with {DETECTIONS} select 'label' as kind, label as key, count(*) as n from kept group by label union all
       select 'color', color, count(*) from kept group by color union all select 'tag', tag, count(*) from tags_v group by tag""",
    "detections_kept": f"with {DETECTIONS} select frame_id, det_idx, label, round(confidence, 4) as confidence from kept where label in ('person', 'car', 'truck', 'dog')",
    "size_classes": f"with {DETECTIONS} select size, count(*) as n, sum(area) as area from sized group by size",
    "frame_assembly": f"""with {INDEX}, c as (select frame_id, string_agg(label || '=' || n, ',' order by label) as counts from (select frame_id, label, count(*) as n from kept group by all) group by frame_id)
       select id, array_to_string(labels, ',') as labels, n_objects, coalesce(counts, '') as counts, conf as detection_confidence from ix left join c on c.frame_id = id""",
    "build_tags": f"with {INDEX} select id, tags from ix",
    "parse_time": """select event_id, case event_id % 5 when 0 then event_id::double when 1 then epoch(date_trunc('second', ts)) when 2 then epoch(date_trunc('second', ts)) end as seconds from events""",
    "derive_wall_time": """select o_orderkey, case o_orderkey % 3 when 0 then (o_orderkey + 1700000000)::double when 1 then o_totalprice else substr((o_orderkey + 1700000000000)::varchar, 1, 10)::double end as wall_time from orders""",
    "time_strings": f"""with {FRAMES} select id, lpad((seq // 60)::varchar, greatest(2, length((seq // 60)::varchar))::int, '0') || ':' || lpad((seq % 60)::varchar, 2, '0') as clip_clock,
       lpad((seq // 3600)::varchar, greatest(2, length((seq // 3600)::varchar))::int, '0') || ':' || lpad((seq % 3600 // 60)::varchar, 2, '0') || ':' || lpad((seq % 60)::varchar, 2, '0') as cut_clock,
       case when wall_time is null or wall_time = 0 then '' else strftime(make_timestamp((wall_time * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') end as wall_clock from frames_v""",
    "token_features": """with w as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents), c as (select w, count(*) as n from w group by w)
       select f as feature, sum(n)::bigint as n from (select '$' || w as f, n from c union all select substr(w, i, 2), n from c, unnest(generate_series(1, length(w) - 1)) u(i) where length(w) > 2) group by f""",
    "hash_embedding": f"""with {_features("documents", "doc_id", "text", "v")} select v_b.k as doc_id, b as bucket, n, round(n / len, 6) as weight from v_b join v_l on v_b.k = v_l.k""",
    "parse_query": f"""with w as (select p_partkey, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+'))) as word from part), m as (
       select p_partkey, c.b as color, case when c.b is null then l.b end as label, case when c.b is null and l.b is null then s.b end as size from w left join (values {_values(COLOR_WORDS)}) c(a, b) on c.a = word
       left join (values {_values(LABEL_WORDS)}) l(a, b) on l.a = word left join (values {_values(SIZE_WORDS)}) s(a, b) on s.a = word)
       select p_partkey, coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(string_agg(distinct color, ',' order by color), '') as colors, coalesce(string_agg(distinct size, ',' order by size), '') as sizes from m group by p_partkey""",
    "cosine": """with v as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)
       select a.vec_id, round(case when a.n * b.n > 0 then greatest(-1.0, least(1.0, list_dot_product(a.e, b.e) / (a.n * b.n))) else 0.0 end, 6) as cosine from v a join v b on b.vec_id = a.vec_id + 1""",
    "cosine_topk": """with v as (select vec_id, embedding::double[] as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings), s as (
       select a.vec_id::varchar as query_id, b.vec_id as seq, round(case when a.n * b.n > 0 then greatest(-1.0, least(1.0, list_dot_product(a.e, b.e) / (a.n * b.n))) else 0.0 end, 6) as score from v a, v b where a.vec_id % 50 = 0), p as (
       select *, row_number() over (partition by query_id order by score desc, seq) as rank from s) select query_id, rank, seq, seq::varchar as id, score from p where rank <= 5""",
    "store_search": f"""with {QUERIES}, {_features("q", "query_id", "text", "qv")}, {_features("part", "p_partkey", "p_name", "iv")}, {_features("part", "p_partkey", "p_type", "tv")}, i as (
       select a.k as query_id, b.k as seq, sum(a.n * b.n)::double / any_value(x.len * y.len) as s from qv_b a join iv_b b on a.b = b.b join qv_l x on x.k = a.k join iv_l y on y.k = b.k group by all), t as (
       select a.k as query_id, b.k as seq, sum(a.n * b.n)::double / any_value(x.len * y.len) as s from qv_b a join tv_b b on a.b = b.b join qv_l x on x.k = a.k join tv_l y on y.k = b.k where b.k % 2 = 0 group by all), s as (
       select q.query_id, p_partkey as seq, round(greatest(coalesce(i.s, 0.0), coalesce(t.s, 0.0)), 6) as score from q cross join part left join i on i.query_id = q.query_id and i.seq = p_partkey left join t on t.query_id = q.query_id and t.seq = p_partkey), p as (
       select *, row_number() over (partition by query_id order by score desc, seq) as rank from s) select query_id, rank, seq, 'p' || seq as id, score from p where rank <= 5""",
    "structure_dominance": f"with {INDEX}, {QUERIES}, {PAIRS} select query_id, round(structure, 4) as structure, round(dominance, 4) as dominance, count(*) as n from pairs group by 1, 2, 3",
    "hybrid_search": _hybrid(),
    "hybrid_labels_penalty": _hybrid(labels="['car', 'dog']"),
    "hybrid_newest": _hybrid("coalesce(wall_time, 0.0) desc", "wall_time between 900000000.0 and 931000000.0"),
    "hybrid_oldest": _hybrid("coalesce(wall_time, 0.0)"),
    "hybrid_voted": _hybrid(weight="power(0.5::double, (select count(*) from events where event_type = 'error' and 'f' || (event_id * 7 % 40000) = p.id))"),
    "label_search": f"""with {INDEX}, w as (select distinct {_list(SUPPORTED_LABELS)}[(l_partkey % 9 + 1)::int] as a, {_list(SUPPORTED_LABELS)}[(l_suppkey % 9 + 1)::int] as b from lineitem), s as (
       select a || '+' || b as query_id, id, seq, len(list_intersect(list_distinct([a, b]), labels)) / 2.0::double as score from ix, w), p as (
       select *, row_number() over (partition by query_id order by score desc, seq) as rank from s where score > 0) select query_id, rank, id, score from p where rank <= 10""",
    "any_label": f"with {DETECTIONS} select distinct frame_id as id from kept join orders on frame_id = 'f' || o_orderkey where label in ('bus', 'cat')",
    "nearest_time": f"""with {INDEX} select id, round(abs(wall_time - 1000000000.0::double), 4) as delta from ix where wall_time is not null and list_has_any(labels, ['car', 'person']) order by 2, seq limit 10""",
    "nearest_time_batch": f"""with {FRAMES}, f as (select seq, id, wall_time from frames_v where wall_time is not null), t as (select event_id as target_id, epoch(ts) - {SHIFT}.0::double as t from events), d as (
       select target_id, min({{'d': round(abs(wall_time - t), 4), 'seq': seq, 'id': id}}, 3) as best from f, t group by target_id)
       select target_id, i as rank, best[i].id as id, best[i].d as delta from d, unnest(generate_series(1, len(best))) u(i)""",
    "nearest_time_labels": f"""with {INDEX}, m as (select seq, id, wall_time, list_contains(labels, 'car')::int as car, list_has_any(labels, ['dog', 'bus'])::int as pet from ix where wall_time is not null), t as (
       select event_id as target_id, epoch(ts) - {SHIFT}.0::double as t, (event_id % 4 = 1)::int as car, (event_id % 4 > 1)::int as pet from events), d as (
       select target_id, min({{'d': round(abs(wall_time - t), 4), 'seq': seq, 'id': id}}, 3) as best from m join t on (t.car = 0 or m.car = 1) and (t.pet = 0 or m.pet = 1) group by target_id)
       select target_id, i as rank, best[i].id as id, best[i].d as delta from d, unnest(generate_series(1, least(len(best), target_id % 3 + 1))) u(i)""",
    "point_lookup": f"with {FRAMES} select seq, id, camera, wall_time from frames_v where id = 'f500'",
    "wall_times": f"with {FRAMES} select id, coalesce(case when seq % 3 = 0 then (seq % 2 * 1000)::double end, wall_time) + timestamp as wall_time from frames_v",
    "channel_defaults": f"""with {FRAMES}, c as (select *, coalesce(nullif(case when seq % 5 = 0 then '' when seq % 5 <> 1 then camera end, ''), 'default') as own from frames_v) select id, own as camera, own || '|' || source_clip as labels from c""",
    "time_range": f"with {FRAMES} select id, wall_time from frames_v where wall_time between 900000000.0 and 931000000.0",
    "clip_offset_range": f"with {FRAMES} select id, timestamp, 1.0::double as score from frames_v where timestamp between 10 and 20 order by seq limit 10",
    "range_join": f"""with {FRAMES}, r as (select event_id, epoch(ts) - {SHIFT}.0::double as a, epoch(ts) - {SHIFT}.0::double + value * 100 as b from events)
       select event_id as range_id, count(*) as n, min(seq) as first from r join frames_v on wall_time between a and b group by event_id""",
    "tail": f"with {FRAMES} select seq, id, camera from frames_v order by seq desc limit 100",
    "page": f"with {FRAMES} select seq, id, camera from frames_v order by seq limit 50 offset 100",
    "page_compat": f"with {FRAMES}, t as (select seq, id, camera from frames_v order by seq desc limit 150) select * from t order by seq limit 50 offset 100",
    "project_results": f"""with {INDEX} select id, array_to_string(list_sort(list_distinct(colors)), ',') as colors, round(timestamp / 7, 4) as score,
       lpad((timestamp::bigint // 60)::varchar, 2, '0') || ':' || lpad((timestamp::bigint % 60)::varchar, 2, '0') as timestamp_str,
       case when wall_time is null then '' else strftime(make_timestamp((wall_time * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') end as wall_time_str from ix""",
    "keyframe_cap": f"with {FRAMES}, n as (select *, row_number() over (partition by source_clip order by seq) - 1 as k from frames_v) select source_clip as clip, 'f' || lpad(k::varchar, 4, '0') as frame_name, id from n where k < 50",
    "sampling_plan": f"with {FRAMES}, c as (select distinct 'clip_' || (c_custkey % 400) as clip from customer) select clip, unnest([0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55]::bigint[]) as ts from c where clip not in (select source_clip from frames_v)",
    "clip_cut_list": f"""with {FRAMES} select id, source_clip, greatest(0.0, timestamp - 2.5) as start, '00:00:' || lpad(floor(greatest(0.0, timestamp - 2.5))::bigint::varchar, 2, '0') as start_clock, 5.0::double as duration, id || '.mp4' as output from frames_v""",
    "motion_filter": "select 'cam' || (user_id % 8) as camera, count(*) as n, max(value / 500) as max_score from events where value / 500 > 0.1 group by 1",
    "motion_sessions": """with m as (select 'cam' || (user_id % 8) as camera, epoch_us(ts) as t, value / 500 as score from events where value / 500 > 0.1), g as (
       select *, case when t - lag(t) over (partition by camera order by t) <= 1800000000 then 0 else 1 end as fresh from m), s as (
       select *, sum(fresh) over (partition by camera order by t rows unbounded preceding) as sid from g)
       select camera, min(t) as start_ts, max(t) as end_ts, max(t) + 1800000000 as record_end, max(score) as max_score, count(*) as n_frames from s group by camera, sid having max(t) - min(t) >= 60000000""",
    "motion_log": """select 'clip_' || user_id as clip, count(*) filter (event_id % 4 = 0) as n_ts, max(value) filter (event_id % 4 = 0) as max_ts, count(*) filter (event_id % 4 = 1) as n_scores,
       max(value / 500) filter (event_id % 4 = 1) as max_score from events group by user_id having n_ts + n_scores > 0""",
    "apply_votes": f"""with {FRAMES}, v as (select 'f' || (event_id * 7 % 40000) as id, count(*) as n from events where event_type = 'error' group by 1) select f.id, coalesce(n, 0) as feedback_downvotes from frames_v f left join v on v.id = f.id""",
    "rejected_votes": """with v as (select event_id, 'f' || (event_id * 7 % 40000) as entry_id, case event_type when 'click' then 'up' when 'error' then 'down' else event_type end as vote from events)
       select *, 'vote' as reason from v where vote not in ('up', 'down') union all select *, 'unknown id' from v where vote in ('up', 'down') and entry_id not in (select 'f' || o_orderkey from orders)""",
    "apply_descriptions": f"""with {FRAMES}, d as (select 'f' || (doc_id % 700) as id, arg_max(text, doc_id) as text from documents where not starts_with(text, 'Description unavailable') group by 1) select f.id, md5(d.text) as description_md5 from frames_v f left join d on d.id = f.id""",
    "upsert": f"""with {FRAMES}, m as (select max(seq) as top from frames_v), c as (select 'f' || (seq * 2) as id, camera, wall_time, seq as o from frames_v)
       select f.seq, f.id, case when c.id is null then f.source_clip else 'changed' end as source_clip, case when c.id is null then f.camera else c.camera end as camera, case when c.id is null then f.wall_time else c.wall_time end as wall_time
       from frames_v f left join c on c.id = f.id union all select top + row_number() over (order by o, id), id, 'changed', camera, wall_time from c, m where id not in (select id from frames_v)""",
    "described_vectors": f"""with {FRAMES}, d as (select 'f' || (doc_id % 700) as id, arg_max(text, doc_id) as text from documents where not starts_with(text, 'Description unavailable') group by 1), {_features("d", "id", "text", "v")}, n as (
       select k, sum(n)::bigint as n_features, sum(n * n)::bigint as squares from v_b group by k) select id, coalesce(n_features, 0) as n_features, coalesce(squares, 0) as squares from frames_v left join n on n.k = id""",
    "build_index": f"""with {DETECTIONS}, clips as (select c_custkey as key, 'cam-' || case when c_custkey % 2 = 0 then c_custkey + 1700000000 else c_custkey end as stem, coalesce(nullif(case when c_custkey % 4 = 0 then '' else 'cam' || (c_custkey % 8) end, ''), 'default') as camera,
       case when c_custkey % 5 = 0 then c_custkey * 100.0::double when c_custkey % 2 = 0 then c_custkey + 1700000000.0::double else c_custkey * 10.0::double end as base from customer), hits as (
       select o_custkey as key, o_orderkey, o_orderkey / 8.0::double as ts, 'f' || lpad((row_number() over (partition by o_custkey order by o_orderkey) - 1)::varchar, 4, '0') as name, row_number() over (partition by o_custkey order by o_orderkey) as n from orders where o_custkey % 3 > 0), marks as (
       select key, ts, name, 'f' || o_orderkey as old from hits where n <= 100 union all select key, i * 5.0::double, 'f000' || i, null from clips, unnest(generate_series(0, 9)) u(i) where key not in (select key from hits)
       union all select key, i * 5.0::double, 'f00' || i, null from clips, unnest(generate_series(10, 11)) u(i) where key not in (select key from hits)), named as (
       select m.*, '/clips/' || stem || '.mp4' as path, stem || '_' || substr(md5('/clips/' || stem || '.mp4|' || name), 1, 8) as id, base, camera, stem from marks m join clips using (key)), agg as (
       select frame_id, string_agg(label, ',' order by det_idx) as labels, round(round(avg(confidence), 9), 4) as conf from kept group by frame_id), tg as (select frame_id, string_agg(tag, '|' order by tag) as tags, string_agg(tag, ' ' order by tag) as words from tags_v group by frame_id), x as (
       select n.*, coalesce(labels, '') as labels, coalesce(conf, 0.0) as conf, coalesce(tags, '') as tags, coalesce(words, id) as words from named n left join agg on agg.frame_id = old left join tg on tg.frame_id = old), {_features("x", "id", "words", "v")}, f as (
       select k, count(*) as n from v_f group by k) select id, ts as timestamp, path as source_clip, path || '/' || name || '.jpg' as thumbnail_path, base + ts as wall_time, camera, labels, tags, conf as detection_confidence, stem || '.mp4' as clip_name, coalesce(f.n, 0) as n_features, true as same_vectors
       from x left join f on f.k = id""",
    "append": f"with {FRAMES}, m as (select max(seq) + 1 as top from frames_v) select camera, 2 * count(*) as n, max(seq) + any_value(top) as last from frames_v, m group by camera",
    "retention": """select event_type as class, count(*) as n, min(event_id) as first from events left join (values ('click', 30), ('view', 10), ('error', 0)) p(c, d) on c = event_type
       where d is null or epoch(ts) >= 1706700000.0::double - d * 86400.0::double group by event_type""",
    "chunk_split": """with b as (select doc_id, base64(encode(text)) as b from documents where length(text) > 0), c as (select *, ceil(length(b) / 2953.0)::bigint as total from b), i as (select *, unnest(generate_series(0, total - 1)) as idx from c)
       select doc_id as archive_id, idx, total, md5(idx || '/' || total || '|' || substr(b, idx * 2953 + 1, 2953)) as payload_md5, idx // 16 as page, idx % 16 // 4 as row, idx % 4 as col from i""",
    "chunk_parse": """with b as (select doc_id, base64(encode(text)) as b from documents where length(text) > 0), c as (select *, ceil(length(b) / 500.0)::bigint as total from b), i as (select *, unnest(generate_series(0, total - 1)) as idx from c)
       select doc_id as archive_id, idx, total, md5(substr(b, idx * 500 + 1, 500)) as slice_md5 from i where idx % 3 <> 2""",
    "chunk_reassemble": """with c as (select doc_id, text, ceil(length(base64(encode(text))) / 500.0)::bigint as total from documents where length(text) > 0), n as (select *, total - (doc_id % 4 = 1 and total > 1)::int as n from c)
       select doc_id as archive_id, case when n >= total then 'complete' when n >= 0.7 * total then 'partial' else 'failed' end as status, n as n_chunks, total, true as totals_agree, case when n >= total then md5(text) end as data_md5 from n""",
    "backup_plan": """with c as (select doc_id, ceil(length(base64(encode(text))) / 2953.0)::bigint as n from documents) select doc_id as archive_id, n as n_codes, ceil(n * 0.3)::bigint as n_redundant, ceil(n / 16.0)::bigint as n_pages from c""",
    "dominant_color_pixels": """with e as (select vec_id, i - 1 as i, floor(abs(embedding[i]::double) * 100000)::bigint as x from embeddings, unnest(generate_series(1, len(embedding))) u(i)), p as (
       select vec_id, (x // 7) % 180 as h, case when vec_id % 5 = 1 then x % 30 else (x + i * 7) % 256 end as s, case when vec_id % 5 = 0 then x % 50 else x % 256 end as v from e), m as (
       select vec_id, floor(avg(s))::bigint as mean_s, floor(avg(v))::bigint as mean_v from p group by vec_id), b as (
       select vec_id, bin, name, sum(s * v) as w from p join (values (0, 0, 8, 'red'), (1, 9, 24, 'orange'), (2, 25, 34, 'yellow'), (3, 35, 80, 'green'), (4, 81, 95, 'cyan'), (5, 96, 129, 'blue'), (6, 130, 170, 'purple'), (7, 171, 181, 'red')) r(bin, lo, hi, name) on h >= lo and h < hi group by all), t as (
       select vec_id, case when max(w) > 0 then arg_max(name, [w, -bin]) else 'red' end as name from b group by vec_id)
       select m.vec_id as det_id, case when mean_v < 40 then 'black' when mean_s < 25 and mean_v >= 200 then 'white' when mean_s < 25 then 'gray' else coalesce(name, 'red') end as color_name, mean_s, mean_v from m left join t on t.vec_id = m.vec_id""",
    "annotate_colors": """with e as (select vec_id, i - 1 as i, floor(abs(embedding[i]::double) * 100000)::bigint as x from embeddings, unnest(generate_series(1, len(embedding))) u(i)), p as (
       select vec_id, i % 8 as px, i // 8 as py, x % 256 as b, (x // 3) % 256 as g, (x // 7 + i * 11) % 256 as r from e), d as (select *, greatest(b, g, r) as hi, greatest(b, g, r) - least(b, g, r) as spread from p), q as (
       select *, case when spread = 0 then 0 when hi = r then (g - b)::double / spread * 30 when hi = g then (2 + (b - r)::double / spread) * 30 else (4 + (r - g)::double / spread) * 30 end as raw,
         case when hi > 0 then round_even((255 * spread)::double / hi, 0) else 0 end::bigint as s, hi as v from d), c as (
       select *, round_even(case when raw < 0 then raw + 180 else raw end, 0)::bigint % 180 as h from q), bx(box, x1, x2) as (values (0, 0, 8), (1, 1, 7), (3, 0, 8)), k as (
       select vec_id, box, h, s, v from c join bx on px >= x1 and px < x2), m as (select vec_id, box, floor(avg(s))::bigint as mean_s, floor(avg(v))::bigint as mean_v from k group by all), w as (
       select vec_id, box, bin, name, sum(s * v) as w from k join (values (0, 0, 8, 'red'), (1, 9, 24, 'orange'), (2, 25, 34, 'yellow'), (3, 35, 80, 'green'), (4, 81, 95, 'cyan'), (5, 96, 129, 'blue'), (6, 130, 170, 'purple'), (7, 171, 181, 'red')) r(bin, lo, hi, name) on h >= lo and h < hi group by all), t as (
       select vec_id, box, case when max(w) > 0 then arg_max(name, [w, -bin]) else 'red' end as name from w group by all)
       select 'img' || m.vec_id as frame_path, m.box::bigint as box, case when mean_v < 40 then 'black' when mean_s < 25 and mean_v >= 200 then 'white' when mean_s < 25 then 'gray' else coalesce(name, 'red') end as color_name
       from m left join t on t.vec_id = m.vec_id and t.box = m.box union all select 'img' || vec_id, 2, 'unknown' from embeddings""",
    "chunk_segments": """with c as (select doc_id, base64(encode(text)) as b from documents where length(text) > 0), n as (select *, ceil(length(b) / 500.0)::bigint as total from c)
       select doc_id as archive_id, k * 900 as offset, md5(from_base64(substr(b, k * 1200 + 1, 1200))) as data_md5 from n, unnest(generate_series(0, (length(b) - 1) // 1200)) u(k) where not (doc_id % 4 = 1 and total > 1)""",
    "page_deep": f"with {FRAMES} select seq, id, camera from frames_v order by seq limit 50 offset 12000",
    "tail_deep": f"with {FRAMES}, t as (select seq from frames_v order by seq desc limit 12000) select count(*) as n, min(seq) as first, max(seq) as last from t",
    "range_join_lengths": f"""with {FRAMES}, r as (select event_id, epoch(ts) - {SHIFT}.0::double as s, value from events), k as (select event_id, case when event_id % 500 <> 4 then s end as a,
       case when event_id % 500 = 2 then s + 5 * 31557600.0::double when event_id % 500 = 3 then null when event_id % 2 = 0 then s + 1 else s + value * 100 end as b from r)
       select event_id as range_id, count(*) as n, min(seq) as first, max(seq) as last from k join frames_v on wall_time is not null and (a is null or wall_time >= a) and (b is null or wall_time <= b) group by event_id""",
    "nearest_time_all": f"""with {FRAMES}, d as (select event_id as target_id, seq, id, round(abs(wall_time - (epoch(ts) - {SHIFT}.0::double)), 4) as delta from events, frames_v where event_id % 1000 = 0 and wall_time is not null)
       select target_id, row_number() over (partition by target_id order by delta, seq) as rank, id, delta from d""",
    "unsupported_labels": f"with {FRAMES} select id, case when seq % 3 = 0 then 'yeti' else 'ufo,yeti' end as unsupported from frames_v where seq % 3 = 0 or seq % 5 = 0",
    "frames_read": f"with {FRAMES}, n as (select *, row_number() over (order by seq) - 1 as line from frames_v) select line as seq, id, wall_time, camera, 0::bigint as n_labels from n where seq % 89 <> 0 and seq % 97 <> 0",
    "events_tail": "select event_id::varchar as timestamp, 'cam' || (user_id % 8) as camera, event_type as label from events order by event_id desc limit 100",
    "vectors_read": """select row_number() over (order by vec_id) - 1 as seq, 'v' || vec_id as id, 'cam' || (vec_id % 8) as camera, len(embedding)::bigint as dimension, round(list_sum(embedding::double[]), 4) as total,
       round(case when vec_id % 3 = 0 then list_sum(embedding[1:5]::double[]) else 0.0 end, 4) as text_total from embeddings""",
    "index_table_votes": f"""with {FRAMES}, m as (select max(seq) + 1 as top from frames_v where seq % 2 = 0), v as (select 'f' || (event_id * 7 % 40000) as id, count(*) as n from events where event_type = 'error' group by 1)
       select seq + case when seq % 2 = 1 then top else 0 end as seq, f.id, camera, (date '1970-01-01' + (seq % 5)::int)::varchar as day, coalesce(n, 0) as feedback_downvotes from m, frames_v f left join v on v.id = f.id""",
    "files_listed": "select event_type, true as filled, 1::bigint as n_files, (select count(*) from events where event_id % 10 <> 0) as n_lines from events group by event_type",
    "stream_ingest": f"with {FRAMES} select row_number() over (order by seq) - 1 as seq, id, camera from frames_v",
    "stream_retention": """with e as (select event_id, event_type as class, epoch_us(ts) / 1e6 as age from events), l as (select max(age) as now from e) select class, count(*) as n, min(event_id) as first from e, l
       where age >= now - case class when 'click' then 5 when 'view' then 1 when 'error' then 0 else 1e9 end * 86400.0 group by class""",
    "stream_sessions": """with m as (select 'cam' || (user_id % 8) as camera, epoch_us(ts) as t, value / 500 as score from events where value / 500 > 0.1), g as (
       select *, case when t - lag(t) over (partition by camera order by t) <= 1800000000 then 0 else 1 end as fresh from m), s as (
       select *, sum(fresh) over (partition by camera order by t rows unbounded preceding) as sid from g)
       select camera, min(t) as start_ts, max(t) as end_ts, max(t) + 1800000000 as record_end, max(score) as max_score, count(*) as n_frames from s group by camera, sid
       having max(t) + 1800000000 <= (select max(t) // 1000 * 1000 - 10000000 from m)""",
    "encoder_hook": """select doc_id, not contains(coalesce(text, ''), '#') as encoded, case when not contains(coalesce(text, ''), '#') then length(coalesce(text, '')) end as signs,
       case when not contains(coalesce(text, ''), '#') then length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) end as es from documents""",
    "detector_hook": """with e as (select vec_id, i - 1 as i, floor(abs(embedding[i]::double) * 100000)::bigint as x from embeddings, unnest(generate_series(1, len(embedding))) u(i)), t as (
       select vec_id, sum(x % 256 + (x // 3) % 256 + (x // 7 + i * 11) % 256) as total from e group by vec_id), b as (
       select 'img' || vec_id as frame_id, case when total % 2 = 1 then 'dog' else 'car' end as label, (total % 100) / 100.0::double as confidence, (total % 8) / 8.0::double as share from t)
       select frame_id, label, round(confidence, 4) as confidence, case when share >= 0.40 then 'huge' when share >= 0.20 then 'large' when share >= 0.08 then 'medium' when share >= 0.02 then 'small' else 'tiny' end as size
       from b where confidence >= 0.5 and share >= 0.005""",
}
ORACLE_SQL |= {"stream_votes": ORACLE_SQL["apply_votes"], "stream_counts": ORACLE_SQL["all_counts"]}
