"""Queries p1 to p5: the general data problems, over the whole tables as delivered, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as h
from ..operators import orphans, skew, snapshots, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_edges(table(spark, d, "edges"), table(spark, d, "nodes"), table(spark, d, "shared_nodes"))


def p1_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(p1_found(spark, d))


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return h.hierarchy(h.links(table(spark, d, "edges")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).select("node_id", "root_id", "depth", "loop_state")


def p2_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Descendants of each node, counted from its nested-set range."""
    return _hierarchy(spark, d).where("loop_state = 'none'").select("node_id", (F.col("last") - F.col("pre")).alias("descendants"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return h.node_paths(h.links(table(spark, d, "edges")))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node, by range."""
    return h.descendants(_hierarchy(spark, d))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every key of the three fields with its rows in delivered order: ends, steps back and the widest step on in time."""
    edges, nodes = table(spark, d, "edges"), table(spark, d, "nodes")
    fields = [(edges, "source_id", "edges.source_id"), (nodes, "project_name", "nodes.project_name"), (nodes, "repository_name", "nodes.repository_name")]
    profile = skew.key_profile([(df, col, "doc_pos", "scanned_at", name) for df, col, name in fields])
    return profile.drop("chunks")  # as many as the cluster's partitions make it


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_keys(p3_profile(spark, d))


def p3_key_rows(spark: SparkSession, d: str) -> DataFrame:
    return p3_profile(spark, d).select("field_name", "key_value", "key_rows")


def _variants(spark: SparkSession, d: str) -> variants.Variants:
    return variants.Variants(table(spark, d, "graph_documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).child_rows


def _flat(name: str):
    return lambda spark, d: getattr(_variants(spark, d), name)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes({"node": table(spark, d, "node_snapshots"), "edge": table(spark, d, "edge_snapshots")})


def p5_changes_by_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("record_kind", "snapshot_no", "change_kind").agg(F.count("*").alias("ids"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_orphans_by_month, p2_found, p2_ranges, p2_paths, p2_descendants, p3_found, p3_profile, p3_key_rows, p4_found, p5_found, p5_changes_by_snapshot)
} | {f"p4_{n}": _flat(n) for n in ("shapes", "nodes", "edges", "locations", "metadata", "rest", "rejected")}

_P1 = """
with refs as (
  select lower(trim(id)) edge_id, min(scanned_at) seen_at, min(lower(trim(source_id))) s, min(lower(trim(target_id))) t
  from edges where id is not null group by 1),
ends as (
  select edge_id, seen_at, 'source' end_name, s node_id from refs where s is not null and s <> ''
  union all select edge_id, seen_at, 'target', t from refs where t is not null and t <> ''),
alive as (
  select lower(trim(id)) node_id, scanned_at f, coalesce(removed_at, timestamp '9999-01-01') u from nodes
  union all select lower(trim(id)), scanned_at, timestamp '9999-01-01' from shared_nodes),
firsts as (select node_id, min(f) f from alive group by 1),
good as (select distinct e.edge_id, e.end_name from ends e join alive a on a.node_id = e.node_id and a.f <= e.seen_at and e.seen_at < a.u),
found as (
  select e.edge_id, e.end_name, e.node_id,
    case when x.f is null then 'missing' when x.f > e.seen_at then 'late' else 'deleted' end reason, strftime(e.seen_at, '%Y-%m') period
  from ends e left join firsts x using (node_id) left join good g on g.edge_id = e.edge_id and g.end_name = e.end_name
  where g.edge_id is null)
"""
_P2 = """
with recursive raw as (
  select nullif(lower(trim(source_id)), '') p, nullif(lower(trim(target_id)), '') c from edges where lower(trim(type)) in ('contains', 'defines')),
tree as (
  select node_id, min(parent_id) parent_id from (
    select c node_id, p parent_id from raw where c is not null union all select p, null from raw where p is not null)
  group by 1),
down as (
  select node_id, node_id root_id, 0 depth, node_id path from tree where parent_id is null
  union all select t.node_id, d.root_id, d.depth + 1, d.path || '/' || t.node_id from down d join tree t on t.parent_id = d.node_id)
"""
_LOOPS = """,
lost as (select t.node_id, t.parent_id from tree t left join down d using (node_id) where d.node_id is null),
walk as (
  select node_id start, parent_id spot from lost
  union select w.start, l.parent_id from walk w join lost l on l.node_id = w.spot),
loops as (select distinct start from walk where start = spot)
"""
_FIELDS = """
with raw as (
  select 'edges.source_id' field_name, nullif(lower(trim(source_id)), '') key_value, doc_pos, epoch_us(scanned_at) seen_at from edges
  union all select 'nodes.project_name', nullif(lower(trim(project_name)), ''), doc_pos, epoch_us(scanned_at) from nodes
  union all select 'nodes.repository_name', nullif(lower(trim(repository_name)), ''), doc_pos, epoch_us(scanned_at) from nodes),
total as (select field_name, count(*) n from raw group by 1),
per_key as (select field_name, key_value, count(*) key_rows from raw where key_value is not null group by 1, 2)
"""


def _p5(kind: str, extra: str) -> str:
    names = ["type", "display_name", "repository_name", "project_name", *extra.split()]
    plain = ", ".join(f"lower(trim({c})) as {c}" for c in names)
    return f"""
select '{kind}' record_kind, coalesce(a.id, b.id) id, coalesce(a.next_no, b.snapshot_no) snapshot_no,
  case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end change_kind
from (select * from {kind}_rows where next_no is not null) a
full join (select * from {kind}_rows where snapshot_no > (select min(snapshot_no) from {kind}_rows)) b
  on b.id = a.id and b.snapshot_no = a.next_no
where a.id is null or b.id is null or a.body is distinct from b.body""", f"""
{kind}_rows as (
  select x.id, x.snapshot_no, x.body, n.next_no from (
    select distinct lower(trim(id)) id, snapshot_no, to_json(struct_pack({", ".join(f"{c} := lower(trim({c}))" for c in names)},
      source_location := source_location, certainty := certainty, metadata := list_sort(map_entries(metadata))))::varchar body
    from {kind}_snapshots) x
  join (select snapshot_no, lead(snapshot_no) over (order by snapshot_no) next_no from (select distinct snapshot_no from {kind}_snapshots)) n using (snapshot_no))"""


#: DuckDB: elements of all readable documents, as JSON. Camel and Pascal case are the spellings that occur.
_P4 = """
with t as (select distinct document_id, trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) txt from graph_documents where payload is not null and document_id is not null),
a as (select document_id, case when json_valid(txt) then txt::json end v from t),
b as (select document_id, json_type(v) outer_type, case json_type(v) when 'OBJECT' then v when 'VARCHAR' then case when json_valid(v->>'$') then (v->>'$')::json end end r from a where v is not null),
l as (select document_id, 'node' owner_kind, json_extract(coalesce(r->'nodes', r->'Nodes'), '$[*]') l from b where r is not null and json_type(r) = 'OBJECT'
  union all select document_id, 'edge', json_extract(coalesce(r->'edges', r->'Edges'), '$[*]') from b where r is not null and json_type(r) = 'OBJECT'),
e as (select document_id, owner_kind, unnest(l) el, unnest(range(len(l)))::int owner_pos from l),
f as (select distinct document_id, owner_kind, owner_pos, el, coalesce(el->>'id', el->>'Id') id, coalesce(el->>'type', el->>'Type') as type, coalesce(el->>'displayName', el->>'DisplayName') display_name,
  coalesce(el->>'repositoryName', el->>'RepositoryName') repository_name, coalesce(el->>'projectName', el->>'ProjectName') project_name, coalesce(el->>'certainty', el->>'Certainty') certainty,
  coalesce(el->>'sourceId', el->>'SourceId') source_id, coalesce(el->>'targetId', el->>'TargetId') target_id,
  coalesce(el->'sourceLocation', el->'SourceLocation') place, coalesce(el->'metadata', el->'Metadata') meta from e),
g as (select *, coalesce(try_cast(certainty as tinyint), list_position(['unresolved', 'ambiguous', 'inferred', 'exact'], lower(trim(certainty))) - 1)::tinyint certainty_rank from f),
m as (select document_id, owner_kind, owner_pos, unnest(json_keys(meta)) k from f where json_type(meta) = 'OBJECT'
  union all select document_id, owner_kind, owner_pos, coalesce(x->>'key', x->>'Key') from (select *, unnest(json_extract(meta, '$[*]')) x from f where json_type(meta) = 'ARRAY')),
mv as (select document_id, owner_kind, owner_pos, (row_number() over (partition by document_id, owner_kind, owner_pos order by k) - 1)::int entry_pos, k as key, json_extract(meta, '$."' || k || '"') v
  from (select document_id, owner_kind, owner_pos, meta, unnest(json_keys(meta)) k from f where json_type(meta) = 'OBJECT')
  union all select document_id, owner_kind, owner_pos, entry_pos, coalesce(x->>'key', x->>'Key'), coalesce(x->'value', x->'Value') from (select *, unnest(json_extract(meta, '$[*]')) x, unnest(range(json_array_length(meta)::bigint))::int entry_pos from f where json_type(meta) = 'ARRAY'))
"""
#: DuckDB: kind of a JSON value.
_KIND = "case json_type({0}) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'text' when 'BOOLEAN' then 'flag' when 'NULL' then 'none' else case when json_type({0}) is null then 'none' else 'number' end end"
_NAMES = ("certainty", "displayName", "id", "metadata", "projectName", "repositoryName", "sourceId", "sourceLocation", "targetId", "type")


def _kind(value: str) -> str:
    return _KIND.format(value)


def _either(of: str, name: str) -> str:
    return f"coalesce({of}->'{name}', {of}->'{name[0].upper()}{name[1:]}')"


def _p4_shapes() -> str:
    own = {n: _kind(_either("el", n)) for n in _NAMES}
    place = " || ".join(["'place('", "concat_ws(',', " + ", ".join(f"case when {_kind(_either('place', n))} <> 'none' then '{n.lower()}:' || {_kind(_either('place', n))} end" for n in ("column", "filePath", "line")) + ")", "')'"])
    own["sourceLocation"] = f"case when json_type(place) = 'OBJECT' then {place} else {_kind('place')} end"
    values = f"coalesce((select array_to_string(list_sort(list_distinct(list({_kind('v')}))), '|') from mv where mv.document_id = g.document_id and mv.owner_kind = g.owner_kind and mv.owner_pos = g.owner_pos), '')"
    own["metadata"] = f"case json_type(meta) when 'OBJECT' then 'map(' || {values} || ')' when 'ARRAY' then 'list(' || {values} || ')' else {_kind('meta')} end"
    known = ", ".join(f"'{n.lower()}'" for n in _NAMES)
    rest = f"case when len(list_filter(json_keys(el), lambda k: not list_contains([{known}], lower(k)))) > 0 then '+rest' end"
    parts = ", ".join(f"(select case when s <> 'none' then '{n.lower()}:' || s end from (select {own[n]} s))" for n in _NAMES)
    element = f"select owner_kind, owner_kind || '(' || concat_ws(',', {parts}, {rest}) || ')' shape from g"
    lists = ", ".join(f"case when {_kind(_either('r', n))} <> 'none' then '{n}:' || {_kind(_either('r', n))} end" for n in ("edges", "nodes"))
    more = "case when len(list_filter(json_keys(r), lambda k: lower(k) not in ('nodes', 'edges') and json_type(r, '$.\"' || k || '\"') <> 'NULL')) > 0 then '+rest' end"
    document = f"select 'document', 'document:' || case outer_type when 'OBJECT' then 'object' else 'text>object' end || '(' || concat_ws(',', {lists}, {more}) || ')' from b where json_type(r) = 'OBJECT'"
    return f"select owner_kind, shape, count(*) elements from ({element} union all {document}) group by 1, 2"


_N, _NR = _p5("node", "")
_E, _ER = _p5("edge", "source_id target_id")
_P5 = f"with {_NR}, {_ER}, found as ({_N} union all {_E})"

SQL = {
    "p1_found": _P1 + "select edge_id, end_name, node_id, reason, period from found",
    "p1_orphans_by_month": _P1 + "select end_name, reason, period, count(*) orphan_ends, count(distinct node_id) orphan_ids from found group by 1, 2, 3",
    "p2_found": _P2 + _LOOPS + """
select node_id, root_id, depth, 'none' loop_state from down
union all select l.node_id, '', -1, case when o.start is null then 'below' else 'on' end from lost l left join loops o on o.start = l.node_id""",
    "p2_ranges": _P2 + "select a.node_id, count(b.node_id) descendants from down a left join down b on b.root_id = a.root_id and starts_with(b.path, a.path || '/') group by 1",
    "p2_paths": _P2 + "select node_id, path from down",
    "p2_descendants": _P2 + "select a.node_id ancestor_id, b.node_id, b.depth - a.depth levels from down a join down b on b.root_id = a.root_id and starts_with(b.path, a.path || '/')",
    "p3_found": _FIELDS + "select field_name, key_value from per_key join total using (field_name) where key_rows >= 0.03 * n",
    "p3_profile": _FIELDS + """, steps as (
  select *, seen_at - lag(seen_at) over (partition by field_name, key_value order by doc_pos nulls first, seen_at nulls first) step from raw where key_value is not null)
select field_name, key_value, count(*) key_rows, count(*) / max(n) share, first(seen_at order by doc_pos nulls first, seen_at nulls first) first_at,
  last(seen_at order by doc_pos nulls first, seen_at nulls first) last_at, count(*) filter (where step < 0) steps_back, max(step) widest_step
from steps join total using (field_name) group by 1, 2""",
    "p3_key_rows": _FIELDS + "select * from per_key",
    "p4_found": _P4 + """
select document_id, owner_kind, owner_pos, 'record' child_kind, id child_key from f
union all select document_id, owner_kind, owner_pos, 'location', coalesce(place->>'filePath', place->>'FilePath') from f where json_type(place) = 'OBJECT'
union all select distinct document_id, owner_kind, owner_pos, 'metadata', k from m where k is not null""",
    "p4_shapes": _P4 + _p4_shapes(),
    "p4_nodes": _P4 + "select document_id, owner_kind, owner_pos, id, type, display_name, repository_name, project_name, certainty, certainty_rank from g where owner_kind = 'node'",
    "p4_edges": _P4 + "select document_id, owner_kind, owner_pos, id, type, display_name, repository_name, project_name, certainty, certainty_rank, source_id, target_id from g where owner_kind = 'edge'",
    "p4_metadata": _P4 + "select distinct document_id, owner_kind, owner_pos, entry_pos, key, v->>'$' as value from mv where key is not null",
    "p4_rejected": _P4 + """select document_id, case when count(*) filter (where trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) <> '') = 0 then 'empty' else 'damaged' end reason
from graph_documents where document_id is not null and document_id not in (select document_id from b where json_type(r) = 'OBJECT') group by 1""",
    "p4_locations": _P4 + """select document_id, owner_kind, owner_pos, coalesce(place->>'filePath', place->>'FilePath') file_path, coalesce(place->>'line', place->>'Line')::int line,
coalesce(place->>'column', place->>'Column')::int as column from f where json_type(place) = 'OBJECT'""",
    "p5_found": _P5 + "select * from found",
    "p5_changes_by_snapshot": _P5 + "select record_kind, snapshot_no, change_kind, count(*) ids from found group by 1, 2, 3",
}
