"""Queries of single contributors over the scan's facts (see scan_facts), each with SQL over the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract
from . import scan_facts

QUERIES = {}
SQL: dict[str, str] = {}

_TEXT = "nullif(trim({0}), '')"
#: DuckDB: trimmed nodes, one row per node id, and trimmed edges with the names of their ends.
_SCAN = f"""with n as (
  select doc_pos seq, lower(trim(id)) id, lower(trim(type)) kind, {_TEXT.format('display_name')} name, {_TEXT.format('repository_name')} repository_name, {_TEXT.format('project_name')} project_name
  from nodes where {_TEXT.format('id')} is not null),
one as (select id, first(kind order by seq) kind, first(name order by seq) name, first(repository_name order by seq) repository_name, min(seq) seq from n group by 1),
e as (
  select x.*, coalesce(a.name, source_id) source_name, coalesce(b.name, target_id) target_name from (
    select doc_pos seq, lower(trim(source_id)) source_id, lower(trim(target_id)) target_id, lower(trim(type)) kind, {_TEXT.format('repository_name')} repository_name, {_TEXT.format('project_name')} project_name
    from edges where {_TEXT.format('source_id')} is not null and {_TEXT.format('target_id')} is not null) x
  left join one a on a.id = x.source_id left join one b on b.id = x.target_id)
"""


def _rows(spark: SparkSession, d: str, contributor, tables: tuple[str, ...], kind: str) -> DataFrame:
    """The node or edge rows that a contributor gives for some of the fact tables, before merging."""
    f = scan_facts.facts(spark, d)
    out = None
    for rows in contributor({t: f[t] for t in tables}):
        if rows.kind == kind:
            out = rows.df if out is None else out.unionByName(rows.df)
    return out


def _edge_query(name: str, contributor, tables: tuple[str, ...], sql: str, *more: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        columns = [F.expr(x) for x in more] or ["display_name"]
        return _rows(spark, d, contributor, tables, "edge").select("seq", "source_id", "target_id", "type", *columns)

    QUERIES[name], SQL[name] = run, _SCAN + sql


def _labelled(kind: str, type_: str, verb: str, where: str = "true", target: str = "target_name") -> str:
    return f"select seq, source_id, target_id, '{type_}' as type, source_name || ' {verb} ' || {target} display_name from e where kind = '{kind}' and {where}"


def _made(prefix: str, id_: str, ending: str) -> str:
    """An id that is made from the path of a node."""
    return f"'{prefix}:' || substr(sha256('/src/' || {id_} || '{ending}'), 1, 16)"


_edge_query("scan_interfaces", extract.project_graph, ("type_interfaces",), _labelled("implements", "IMPLEMENTS", "implements"))
_edge_query("scan_injections", extract.project_graph, ("injections",), _labelled("injects", "INJECTS", "injects"))
_edge_query("scan_methods", extract.project_graph, ("methods",), _labelled("defines", "DEFINES", "defines", "target_id like 'method:%' and source_id not like 'project:%'"))
_edge_query("scan_calls", extract.project_graph, ("calls",), _labelled("calls", "CALLS", "calls", target="target_name || '.' || target_name"))
_edge_query(
    "scan_entity_uses", extract.data_access, ("entity_uses",),
    _labelled("uses_dbcontext", "USES_DBCONTEXT", "uses") + " union all " + _labelled("queries_entity", "QUERIES_ENTITY", "queries"),
)
_edge_query(
    "scan_references", extract.project_graph, ("projects", "project_refs"),
    f"""
, p as (select id, name, repository_name, seq from one where kind = 'project' and name is not null),
s as (select target_id, first(source_id order by seq) id from e where kind = 'contains' and source_id like 'solution:%' group by 1),
r as (select e.seq, {_made('project', 'e.source_id', '.csproj')} source_id, {_made('project', 'e.target_id', '.csproj')} target_id, a.name x, b.name y, a.repository_name rx, b.repository_name ry
  from e join p a on a.id = e.source_id join p b on b.id = e.target_id where e.kind = 'depends_on' and e.source_id like 'project:%' and e.target_id like 'project:%')
select seq, source_id, target_id, 'DEPENDS_ON' as type, x || ' references ' || y display_name from r
union all select seq, source_id, target_id, 'CROSSES_REPO_BOUNDARY', x || ' crosses into ' || y from r where upper(rx) is distinct from upper(ry)
union all select p.seq, {_made('solution', 's.id', '.sln')}, {_made('project', 'p.id', '.csproj')}, 'CONTAINS', split_part(s.id || '.sln', '.', 1) || ' contains ' || p.name from p join s on s.target_id = p.id""",
)
_edge_query(
    "scan_dispatches", extract.dispatches, ("dispatches", "handlers"),
    """
, d as (select *, case when seq % 5 = 0 then 'publish' else 'send' end way from e where kind = 'dispatches'),
h as (select distinct source_id request, target_id method, target_name handler from e where kind = 'handled_by'),
k as (select request, count(*) n from h group by 1)
select seq, source_id, target_id, 'DISPATCHES' as type, case when way = 'send' and k.n is null then 0 else 3 end certainty, case when way = 'send' and k.n is null then 'no-handler-found' else 'request-handler' end resolution
from d left join k on k.request = d.target_id
union all select d.seq, d.target_id, h.method, 'HANDLED_BY', case when way = 'publish' then 3 when k.n = 1 then 2 else 1 end, 'request-handler' from d join h on h.request = d.target_id join k on k.request = d.target_id""",
    "cast(certainty as int) certainty", "metadata['resolution'] resolution",
)


def scan_types(spark: SparkSession, d: str) -> DataFrame:
    """Declared types with the node type that their kind and name give them."""
    return _rows(spark, d, extract.project_graph, ("types",), "node").select("seq", "id", "type", "display_name")


def scan_exposed(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints that controllers expose, by verb and route."""
    rows = _rows(spark, d, extract.endpoints, ("routes",), "edge").where("type = 'EXPOSES'")
    return rows.select("seq", "source_id", "display_name")


QUERIES |= {"scan_types": scan_types, "scan_exposed": scan_exposed}
SQL |= {
    "scan_types": _SCAN + f"""select seq, id, case when kind = 'interface' then 'Interface' when name like '%Controller' then 'Controller'
  when name like '%Service' or name like '%Repository' or name like '%Manager' or name like '%Handler' or name like '%Client' then 'Service' else 'Implementation' end as type, name display_name
from n where kind in {scan_facts.TYPES} and name is not null""",
    "scan_exposed": _SCAN + """select n.seq, x.source_id, x.source_name || ' exposes ' || coalesce(nullif(regexp_extract(n.name, '^([A-Z]+) ', 1), ''), 'GET') || ' /' || trim(regexp_replace(n.name, '^[A-Z]+ ', ''), '/') display_name
from n join e x on x.kind = 'exposes' and x.target_id = n.id where n.kind = 'endpoint' and n.name is not null""",
}
