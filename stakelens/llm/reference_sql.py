"""Reference SQL of the corpus operators that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: Masks of the five filters, then every order of the filters by joins.
OP12_SQL = rf"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), w as (
  select doc_id, part, t, {_WORDS} as ws from d
), first as (
  select t, min(doc_id) as first_id from d where doc_id is not null group by t
), l as (
  select doc_id, max((quality = 1)::integer) as good, max((toxic = 1)::integer) as toxic from labels group by doc_id
), m as (
  select part, coalesce(good, 0) as good, coalesce(l.toxic, 0) as toxic, [
    len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] as fails
  from w left join first using (t) left join l on l.doc_id = w.doc_id
), cells as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all
), f as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as name, unnest([1, 2, 3, 4, 5]) as nth
), perms as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.nth, b.nth, c.nth, d.nth, e.nth] as ats
  from f a join f b on b.nth <> a.nth join f c on c.nth not in (a.nth, b.nth)
    join f d on d.nth not in (a.nth, b.nth, c.nth) join f e on e.nth not in (a.nth, b.nth, c.nth, d.nth)
), steps as (
  select part, filter_order, k as step, ats[k] as nth, n, good, toxic, fails[ats[k]] as here,
    list_bool_or(list_transform(ats[1:k - 1], lambda x: fails[x])) as before,
    len(list_filter(fails, lambda x: x)) as failed
  from cells, perms, (select unnest([1, 2, 3, 4, 5]) as k)
), s as (
  select part, filter_order, step, nth,
    coalesce(sum(n) filter (where not here and not coalesce(before, false)), 0)::bigint as kept,
    coalesce(sum(n) filter (where here and not coalesce(before, false)), 0)::bigint as removed,
    coalesce(sum(n) filter (where here and before), 0)::bigint as redundant,
    coalesce(sum(n) filter (where here and failed = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where here and not coalesce(before, false)), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where here and not coalesce(before, false)), 0)::bigint as toxic_lost
  from steps group by all
)
select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, nth))::bigint as shapley
from s
"""


def _fields(text: str) -> str:
    return " || ".join(
        f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)
    )


#: crc32 of the decimal id, bit by bit (reflected polynomial 0xEDB88320).
_CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda b: ascii(b)::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""


def _groups(name: str, key: str, start: str, levels: int) -> str:
    """CTEs name0, name1, ...: runs of up to 16 nodes (key, up, digests) of each level, and in n how many nodes the level has."""
    out, nodes = [], start
    for k in range(levels):
        out.append(f"""{name}{k} as (
  select {key} as k, pos // 16 as up, max(n) as n, list(digest order by pos) as ds from ({nodes}) group by {key}, pos // 16
)""")
        key = "k"
        nodes = f"select k, up as pos, (n + 15) // 16 as n, case when n > 1 then sha256(array_to_string(ds, '')) else ds[1] end as digest from {name}{k}"
    return ", ".join(out)


def _walk(name: str, base: str, levels: int, key: str) -> str:
    """CTEs that take (pos, proof, node) of every leaf through the levels of ``name``."""
    out, last = [], base
    for k in range(levels):
        slot = f"((pos // {16**k}) % 16)"
        out.append(f"""{name}w{k} as (
  select b.* replace (
    case when g.n > 1 then b.proof || array_to_string(g.ds[1:{slot}], '') || array_to_string(g.ds[{slot} + 2:], '') else b.proof end as proof,
    case when g.n > 1 then sha256(array_to_string(g.ds[1:{slot}], '') || b.node || array_to_string(g.ds[{slot} + 2:], '')) else b.node end as node)
  from {last} b join {name}{k} g on g.k = b.{key} and g.up = b.pos // {16 ** (k + 1)}
)""")
        last = f"{name}w{k}"
    return ", ".join(out)


#: Six levels within a source (16 million rows each) and four over the sources.
OP13_SQL = f"""
with leaf as (
  select doc_id, source, sha256({_fields("text")}) as leaf,
    sha256({_fields(f"(case when ({_CRC32}) % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end)")}) as now
  from documents
), sources as (
  select source, row_number() over (order by source nulls first) - 1 as sno from (select distinct source from documents)
), placed as (
  select doc_id, leaf, now, sno, row_number() over (partition by sno order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by sno) as n
  from leaf join sources on leaf.source is not distinct from sources.source
), {_groups("s", "sno", "select sno, pos, n, leaf as digest from placed", 6)}, subs as (
  select k as sno, case when n > 1 then sha256(array_to_string(ds, '')) else ds[1] end as subroot from s5
), {_groups("t", "one", "select 1 as one, sno as pos, (select count(*) from subs) as n, subroot as digest from subs", 4)}, top as (
  select case when n > 1 then sha256(array_to_string(ds, '')) else ds[1] end as root from t3
), w as (
  select doc_id, leaf, sno, pos, subroot, 1 as one, '' as proof, now as node from placed join subs using (sno)
), {_walk("s", "w", 6, "sno")}, x as (
  select * replace (sno as pos) from sw5
), {_walk("t", "x", 4, "one")}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, node as folded_root, node = root as verified from tw3, top
"""
