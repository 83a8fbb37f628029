"""DuckDB SQL for the operators that SQL can express."""

from itertools import permutations

LLM_ORACLE: dict[str, str] = {}

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLE["op4_line_dedup"] = f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (select doc_id, pos, line, {_AZ.format(f"trim(line, {_WS})")} as key from l),
f as (select key, max(doc_id) as keeper from k where length(key) >= 40
      group by key having count(distinct doc_id) >= 5),
j as (select k.doc_id, k.pos, k.line, f.key is not null and k.doc_id <> f.keeper as gone
      from k left join f on k.key = f.key)
select doc_id, cast(count(*) as bigint) as n_lines,
       cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id"""

LLM_ORACLE["op5_mix_sources"] = r"""
with d as (
  select doc_id, source,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('17|' || cast(doc_id as varchar)) as m
  from documents),
b as (
  select *, cast(floor(cast(('0x' || substr(m, 1, 8)) as bigint) / 4294967296.0::double * 1024) as int) as bin,
         cast(('0x' || substr(m, 9, 8)) as bigint) / 4294967296.0::double as v
  from d),
g as (select source, bin, sum(size)::bigint as bin_size from b group by all),
s as (select source, sum(bin_size)::bigint as source_size from g group by source),
w as (
  select *, [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight,
         source_size * 2.0::double as cap
  from s),
r as (select *, cap / weight as ratio, sum(source_size) over () * 1.5::double as budget from w),
l as (
  select *, (budget - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as lv
  from r),
t as (select source, source_size, least(cap, weight * max(lv) over ()) as target from l),
t2 as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
t3 as (select *, greatest(target - whole * source_size, 0.0::double) as rest from t2),
u as (select source, bin, bin_size, sum(bin_size) over (partition by source order by bin rows unbounded preceding) as upto from g),
c as (
  select t3.source, min(bin) as cut_bin from u join t3 on u.source is not distinct from t3.source
  where upto > rest group by t3.source),
c2 as (
  select c.source, cut_bin, bin_size::double as cut_size, (bin_size - upto)::double / bin_size as base_fraction
  from c join u on c.source is not distinct from u.source and c.cut_bin = u.bin)
select b.doc_id, b.size, t3.source_size, t3.target,
       cast(whole * b.size + case when b.bin < coalesce(cut_bin, 1024) then b.size
            when b.bin = cut_bin then least(b.size, cast(floor(b.size * (rest / cut_size + base_fraction) + v) as bigint))
            else 0 end as bigint) as taken
from b join t3 on b.source is not distinct from t3.source
left join c2 on c2.source is not distinct from t3.source"""

LLM_ORACLE["op1_kd_top_k"] = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
  where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


_ORDERS = ", ".join(
    f"('{''.join(order)}', {step + 1}, {1 << 'ABCDE'.index(letter)}, {sum(1 << 'ABCDE'.index(x) for x in order[:step])})"
    for order in permutations("ABCDE")
    for step, letter in enumerate(order)
)

LLM_ORACLE["op12_filter_audit"] = rf"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as capitals,
             min(doc_id) over (partition by text) as holder from t),
m as (select doc_id, part,
        case when len(words) < 100 then 1 else 0 end
        + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
        + case when 100 * capitals > 10 * length(text) then 4 else 0 end
        + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
        + case when coalesce(doc_id > holder, false) then 16 else 0 end as mask from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
      from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
      from m left join l using (doc_id) group by part, mask),
o(filter_order, step, bit, before) as (values {_ORDERS}),
s as (select part, filter_order, step, bit,
        sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
        sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
        sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant,
        sum(case when mask = bit then n else 0 end) as unique_fails,
        sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end) as good_lost,
        sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
      from c cross join o group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from s"""


def _lloyd(rounds: int) -> str:
    """Plain assignment and centroids, round by round."""
    square = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
  select v.n, any_value(v.vec_id) as vec_id, any_value(v.v) as v, arg_min(c.cluster, {square} * 64 + c.cluster) as cluster,
         min({square}) as distance
  from v cross join c{r} c group by v.n)""")
        if r < rounds:
            steps.append(f"""
s{r} as materialized (
  select cluster, i, cast(floor(sum(v[i])::double / count(*)) as bigint) as x
  from (select cluster, v, unnest(range(1, 65)) as i from a{r}) group by cluster, i),
c{r + 1} as materialized (
  select c.cluster, coalesce(any_value(n.v), any_value(c.v)) as v from c{r} c
  left join (select cluster, list(x order by i) as v from s{r} group by cluster) n on n.cluster = c.cluster group by c.cluster)""")
    return ",".join(steps)


LLM_ORACLE["op13_heap_clusters"] = f"""
with v as materialized (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id), v) - 1 as cluster, v
  from v where vec_id is not null order by 1 limit 40),{_lloyd(5)},
i as (select cluster, sum(distance) as cluster_inertia from a5 group by cluster)
select a.vec_id, cast(a.cluster as int) as cluster, cast(a.distance as bigint) as distance,
       cast(i.cluster_inertia as bigint) as cluster_inertia,
       cast((select sum(distance) from a5) as bigint) as inertia,
       sha256(list_aggregate(list_transform(c.v, lambda x: cast(x as varchar)), 'string_agg', ',')) as centroid_sha256
from a5 a join i using (cluster) join c5 c using (cluster)"""
