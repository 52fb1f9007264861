"""Queries of the graph operators over the delivered graph and the projected business tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.ids import EDGE_TYPES, NODE_TYPES
from ..operators import merge, traverse, views
from ..operators.merge import Graph
from ..session import written
from . import graph_data as G

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def _m(sql: str) -> str:
    return f"with {G.MERGED} {sql}"


def _p(sql: str) -> str:
    return f"with recursive {G.PROJECTED}{sql}"


# -- building ----------------------------------------------------------------------------------------------------------
@query("""select distinct lower(trim(id)) id, 'node:' || substr(sha256(array_to_string(list_filter([trim(repository_name), trim(project_name), trim(display_name)], lambda x: x is not null and x <> ''), '|')), 1, 16) made_id from nodes""")
def graph_ids(spark: SparkSession, d: str) -> DataFrame:
    made = ids.graph_id("node", F.col("repository_name"), F.col("project_name"), F.col("display_name"))
    return G.table(spark, d, "nodes").select(G.key("id").alias("id"), made.alias("made_id")).distinct()


@query(_m("select id, type, display_name, source_location.file_path file_path, source_location.line line, repository_name, project_name, certainty::int certainty from g_nodes"))
def node_merge(spark: SparkSession, d: str) -> DataFrame:
    n = merge.merge_nodes(G.node_rows(spark, d))
    return n.select("id", "type", "display_name", F.col("source_location.file_path").alias("file_path"), F.col("source_location.line").alias("line"), "repository_name", "project_name", F.col("certainty").cast("int").alias("certainty"))


@query(_m("select id, source_id, target_id, type, display_name, repository_name, project_name, certainty::int certainty from g_edges"))
def edge_merge_certainty(spark: SparkSession, d: str) -> DataFrame:
    e = merge.merge_edges(G.edge_rows(spark, d))
    return e.select("id", "source_id", "target_id", "type", "display_name", "repository_name", "project_name", F.col("certainty").cast("int").alias("certainty"))


@query("""
select 'edge:' || substr(sha256(array_to_string(list_filter([trim(source_id), trim(target_id), trim(type), trim(display_name)], lambda x: x is not null and x <> ''), '|')), 1, 16) id,
  max(certainty)::int certainty, count(*) deliveries from edges group by 1""")
def edge_merge_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Edges under the ids that their ends, type and label make."""
    rows = G.edge_rows(spark, d)
    n = rows.groupBy(ids.edge_id(F.col("source_id"), F.col("target_id"), F.col("type"), F.col("display_name")).alias("id")).agg(F.count("*").alias("deliveries"))
    return merge.merge_edges(rows, make_ids=True).select("id", F.col("certainty").cast("int").alias("certainty")).join(n, "id")


@query(_m(""", m_rows as (select id, seq, k, metadata[k] v from (select id, seq, metadata, unnest(map_keys(metadata)) k from raw_nodes where id is not null and id <> '' and cardinality(metadata) > 0)),
  m_first as (select id, min(seq) s0 from m_rows group by 1),
  m_named as (select id, lower(k) lk, first(k order by seq) as key, list(v order by seq) vs from m_rows join m_first using (id) where seq = s0 or regexp_matches(k, '\\S') group by 1, 2)
select id, key, list_reduce(vs, lambda old, v: case when old is null or not regexp_matches(old, '\\S') then v when v is null or not regexp_matches(v, '\\S') or lower(old) = lower(v) then old else old || ' | ' || v end) as value from m_named"""))
def metadata_fold(spark: SparkSession, d: str) -> DataFrame:
    """Merged metadata entries; tests compare the fold with a plain one."""
    return merge.merge_nodes(G.node_rows(spark, d)).select("id", F.explode("metadata").alias("key", "value"))


@query(_m("select type, count(*) nodes from g_nodes group by 1"))
def type_specificity(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_nodes(G.node_rows(spark, d)).groupBy("type").agg(F.count("*").alias("nodes"))


@query(_m("select 'node' kind, id, doc_pos from o_nodes union all select 'edge', id, doc_pos from o_edges"))
def build_order(spark: SparkSession, d: str) -> DataFrame:
    g = G.delivered(spark, d, ordered=True)
    return g.nodes.select(F.lit("node").alias("kind"), "id", "doc_pos").unionByName(g.edges.select(F.lit("edge").alias("kind"), "id", "doc_pos"))


_STATS = """
select count(*) filter (where type = 'Repository') repository_count, count(*) filter (where type = 'Solution') solution_count, count(*) filter (where type = 'Project') project_count,
  count(*) filter (where type = 'Endpoint') endpoint_count, count(*) filter (where type = 'Method') method_count, count(*) filter (where type = 'Table') table_count,
  (select count(*) from g_edges where type in ('CALLS_HTTP', 'USES_HTTP_CLIENT')) http_edge_count, (select count(*) from g_edges where type = 'CROSSES_REPO_BOUNDARY') cross_repo_link_count,
  (select count(*) from g_edges where certainty in (0, 1)) ambiguous_edge_count
from g_nodes"""


@query(_m(_STATS))
def statistics(spark: SparkSession, d: str) -> DataFrame:
    return merge.statistics(G.delivered(spark, d))


@query(_m("""
select e.id edge_id, 'source' end_name, e.source_id node_id from g_edges e where e.source_id is not null and e.source_id not in (select id from g_nodes)
union all select e.id, 'target', e.target_id from g_edges e where e.target_id is not null and e.target_id not in (select id from g_nodes)"""))
def dangling_check(spark: SparkSession, d: str) -> DataFrame:
    return merge.dangling(G.delivered(spark, d))


@query("select lower(trim(id)) id, count(*) deliveries from nodes group by 1 having count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return merge.repeated_ids(G.table(spark, d, "nodes")).withColumnRenamed("rows", "deliveries")


# -- questions ---------------------------------------------------------------------------------------------------------
def _resolved(text: str, name: str, sql_text: str | None = None):
    @query(_m(f"""
select id, type, display_name from (
  select *, case when upper(id) = upper('{text}') then 1 when upper(coalesce(display_name, '')) = upper('{text}') then 2
    when contains(upper(coalesce(display_name, '')), upper('{text}')) or contains(upper(id), upper('{text}')) then 3 end tier from o_nodes)
where tier is not null order by tier, doc_pos limit 1"""), name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        nodes = G.build_order(G.merge_nodes(G.node_rows(spark, d)), NODE_TYPES)
        return traverse.resolved(nodes, text).select("id", "type", "display_name")


_resolved("harbor-platform", "resolve_by_name")
_resolved("Repository:4089EDBB95623AC5", "resolve_by_id")
_resolved("validator", "resolve_by_substring")
_resolved("", "resolve_first")

_HUB = "(select {0} from (select {0}, count(*) n from g_edges where {0} is not null group by 1) order by n desc, {0} limit 1)"


def _reach_sql(walk: str, start: str, depth: int, body: str) -> str:
    return f"""with recursive {G.MERGED},
walk as ({walk}),
bfs(node_id, depth) as (
  select {start}, 0
  union select w.t, b.depth + 1 from bfs b join walk w on w.s = b.node_id where b.depth < {depth}),
seen as (select node_id, min(depth) depth from bfs group by 1)
{body}"""


def _start(g: Graph, end: str = "source_id") -> str:
    """The node at most edges with this end: a start that every data set has."""
    n = g.edges.where(f"{end} is not null").groupBy(end).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), end).limit(1).collect()[0][end]


def _impact(upstream: bool, depth: int, exact: bool, ambiguous: bool, name: str, edges: bool = False):
    sure = "certainty = 3" if exact else "true" if ambiguous else "certainty not in (0, 1)"
    ends = "target_id s, source_id t" if upstream else "source_id s, target_id t"
    walk = f"select id, {ends}, certainty from g_edges where source_id is not null and target_id is not null and {sure}"
    nodes = "select n.id, depth from seen join (select distinct id from g_nodes) n on n.id = seen.node_id"
    body = f"select w.id, seen.depth from walk w join seen on seen.node_id = w.s where seen.depth < {depth}" if edges else nodes

    end = "target_id" if upstream else "source_id"

    @query(_reach_sql(walk, _HUB.format(end), depth, body), name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = G.links_only(spark, d)
        found, walked = traverse.impact(g, _start(g, end), upstream, depth, exact, ambiguous)
        return walked.select("id", "depth") if edges else found.select("id", "depth")


_impact(False, 6, False, True, "impact_downstream")
_impact(True, 6, False, True, "impact_upstream")
_impact(False, 6, True, True, "impact_exact_only")
_impact(False, 6, False, False, "impact_no_ambiguous")
_impact(False, 3, False, True, "impact_edges", edges=True)


@query(_p("""
, bfs(node_id, depth) as (select 'part:7', 0 union select e.source_id, b.depth + 1 from bfs b join p_edges e on e.target_id = b.node_id where b.depth < 6)
select min_depth depth, count(*) nodes from (select node_id, min(depth) min_depth from bfs group by 1) group by 1"""))
def impact_depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    """What affects a part, in the projected business tables, by distance."""
    nodes, _ = traverse.impact(G.projected(spark, d), "part:7", upstream=True)
    return nodes.groupBy("depth").agg(F.count("*").alias("nodes"))


def _paths(source: str, target: str, depth: int, sure: int, name: str):
    exact, ambiguous = sure == 3, sure == 0

    @query(_p(f"""
, walk(at_node, node_ids, edge_ids) as (
  select '{source}', ['{source}'], []::varchar[]
  union all select e.target_id, list_append(w.node_ids, e.target_id), list_append(w.edge_ids, e.id) from walk w join p_edges e on e.source_id = w.at_node
  where w.at_node <> '{target}' and len(w.edge_ids) < {depth} and e.certainty >= {sure} and not list_contains(w.node_ids, e.target_id))
select array_to_string(node_ids, ' ') nodes, array_to_string(edge_ids, ' ') edges, len(edge_ids)::int steps from walk where at_node = '{target}'"""), name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = G.projected(spark, d)
        found = traverse.paths(g, source, target, depth, exact, ambiguous)
        return found.select(F.array_join("node_ids", " ").alias("nodes"), F.array_join("edge_ids", " ").alias("edges"), F.col("length").alias("steps"))


_paths("region:0", "part:7", 8, 0, "paths_region_part")
_paths("region:2", "part:7", 8, 2, "paths_inferred_only")
_paths("region:2", "part:7", 8, 3, "paths_exact_only")
_paths("evt:view", "evt:purchase", 8, 0, "paths_event_cycle")
_paths("part:7", "part:7", 8, 0, "paths_to_itself")


@query(_p("select e.source_id, e.target_id, e.type from p_edges e where e.source_id like 'evt:%'"))
def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    return G.projected(spark, d).edges.where("source_id like 'evt:%'").select("source_id", "target_id", "type")


def _review(level: int, name: str):
    @query(_m(f"select id, type, display_name from g_edges where certainty = {level}"), name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return traverse.review(G.delivered(spark, d))["unresolved" if level == 0 else "ambiguous"].select("id", "type", "display_name")


_review(0, "review_unresolved")
_review(1, "review_ambiguous")


@query(_m("select type, count(*) edges from g_edges where certainty = 1 group by 1"))
def review_by_type(spark: SparkSession, d: str) -> DataFrame:
    return traverse.review(G.delivered(spark, d))["ambiguous"].groupBy("type").agg(F.count("*").alias("edges"))


# -- views -------------------------------------------------------------------------------------------------------------
def _rows(g: Graph) -> DataFrame:
    return g.nodes.select(F.lit("node").alias("kind"), "id").unionByName(g.edges.select(F.lit("edge").alias("kind"), "id"))


def _view_by_types(name: str, key: str):
    types = ", ".join(f"'{t}'" for t in views.VIEW_TYPES[key])

    @query(_m(f""", v as (select id from g_nodes where type in ({types}))
select 'node' kind, id from v union all select 'edge', id from g_edges where source_id in (select id from v) and target_id in (select id from v)"""), name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rows(views.view(G.delivered(spark, d), key))


_view_by_types("view_topology", "workspace-topology")
_view_by_types("view_services", "service-dependencies")
_view_by_types("view_data_impact", "data-impact")


def _view_by_edges(name: str, key: str, where: str):
    @query(_m(f""", v as (select id, source_id, target_id from g_edges where {where})
select 'edge' kind, id from v union all select 'node', id from g_nodes where id in (select source_id from v where source_id is not null union select target_id from v where target_id is not null)"""), name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rows(views.view(G.delivered(spark, d), key))


_view_by_edges("view_dispatch", "mediatr-dispatch", "type in ('DISPATCHES', 'HANDLED_BY')")
_view_by_edges("view_cross_repo", "cross-repo", "type = 'CROSSES_REPO_BOUNDARY'")
_view_by_edges("view_ambiguity", "ambiguity-audit", "certainty is distinct from 3")


@query(_m("""
select facet, value from (select 'repository' facet, repository_name value from g_nodes union select 'project', project_name from g_nodes union select 'node_type', type from g_nodes
  union select 'edge_type', type from g_edges) where value is not null
union all select unnest(['repository', 'project', 'node_type', 'edge_type']), 'All'"""))
def facets(spark: SparkSession, d: str) -> DataFrame:
    return views.facets(G.delivered(spark, d))


@query(_m(""", v as (select id from g_nodes where repository_name = 'harbor-platform' and (contains(lower(coalesce(display_name, '')), 'store') or contains(id, 'store')))
select 'node' kind, id from v union all select 'edge', id from g_edges where source_id in (select id from v) and target_id in (select id from v) and certainty in (2, 3)"""))
def filter_working_graph(spark: SparkSession, d: str) -> DataFrame:
    return _rows(views.working_graph(G.delivered(spark, d), repository="harbor-platform", search=" Store ", include_ambiguous=False))


_SHOWN = """, ends as (select source_id id from o_edges union select target_id from o_edges),
v as (select * from o_nodes where id in (select id from ends where id is not null) order by doc_pos limit 160),
w as (select * from o_edges where source_id in (select id from v) and target_id in (select id from v) order by doc_pos limit 260)
"""


@query(_m(_SHOWN + "select 'node' kind, id from v union all select 'edge', id from w"))
def shown_graph(spark: SparkSession, d: str) -> DataFrame:
    """What a screen shows: a capped view, which is the feature."""
    return _rows(views.shown(G.delivered(spark, d, ordered=True)))


@query(_m("select id, type, certainty::int certainty from o_edges where certainty is distinct from 3 order by doc_pos limit 40"))
def audit_top40(spark: SparkSession, d: str) -> DataFrame:
    return views.audit(G.delivered(spark, d, ordered=True)).select("id", "type", F.col("certainty").cast("int").alias("certainty"))


@query(_m("""select x.id, x.label, (select count(*) from g_nodes where type = x.t)::varchar as value
from (values ('endpoints', 'Endpoints', 'Endpoint'), ('controllers', 'Controllers', 'Controller'), ('services', 'Services', 'Service'), ('repositories', 'Repositories', 'Repository'), ('entities', 'EF Core entities', 'Entity')) x(id, label, t)"""))
def dashboard_metrics(spark: SparkSession, d: str) -> DataFrame:
    return views.metrics(merge.merge_nodes(G.node_rows(spark, d)))


@query("select unnest(['endpoints', 'controllers', 'services', 'repositories', 'entities']) id, unnest(['Endpoints', 'Controllers', 'Services', 'Repositories', 'EF Core entities']) label, '-' as value")
def unavailable_metrics(spark: SparkSession, d: str) -> DataFrame:
    return views.unavailable_metrics(spark)


@query(_m(f""", s as ({_STATS}) select unnest(['Repos scanned', 'Projects', 'Endpoints', 'Methods', 'MediatR edges', 'HTTP edges', 'DB tables', 'Cross-repo links', 'Ambiguous edges']) label,
unnest([repository_count, project_count, endpoint_count, method_count, (select count(*) from g_edges where type in ('DISPATCHES', 'HANDLED_BY')), http_edge_count, table_count, cross_repo_link_count, ambiguous_edge_count]) as value from s"""))
def summary_tiles(spark: SparkSession, d: str) -> DataFrame:
    return views.tiles(G.delivered(spark, d))


@query("select unnest([" + ", ".join("'" + p[0] + "'" for p in views.PRESETS) + "]) id, unnest([" + ", ".join("'" + p[1] + "'" for p in views.PRESETS) + "]) title, unnest([" + ", ".join("'" + p[2] + "'" for p in views.PRESETS) + "]) description, unnest([" + ", ".join("'" + p[3] + "'" for p in views.PRESETS) + "]) direction")
def presets(spark: SparkSession, d: str) -> DataFrame:
    return views.presets(spark)


_DEPTH = ", ".join(f"'{t}'" for t in views.DEPTH_ORDER)


@query(_m(f"select id, greatest(coalesce(list_position([{_DEPTH}], type), 0) - 1, 0)::int depth from g_nodes"))
def depth_by_type(spark: SparkSession, d: str) -> DataFrame:
    return views.depth_by_type(merge.merge_nodes(G.node_rows(spark, d))).select("id", "depth")


@query(_reach_sql("select source_id s, target_id t from g_edges where source_id is not null and target_id is not null", _HUB.format("source_id"), 30, "select n.id, coalesce(depth, 0)::int depth from g_nodes n left join seen on seen.node_id = n.id"))
def depth_by_focus(spark: SparkSession, d: str) -> DataFrame:
    g = G.links_only(spark, d)
    return views.depth_by_focus(g, _start(g)).select("id", "depth")


_LAYOUT = _SHOWN + f""", l as (select id, 140 + 250 * dd x, 80 + 82 * (row_number() over (partition by dd order by doc_pos) - 1) y from (
  select *, greatest(coalesce(list_position([{_DEPTH}], type), 0) - 1, 0) dd from v))
"""


@query(_m(_LAYOUT + "select id, x::int x, y::int y from l"))
def layout(spark: SparkSession, d: str) -> DataFrame:
    return views.layout(views.depth_by_type(views.shown(G.delivered(spark, d, ordered=True)).nodes)).select("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


@query(_m(_LAYOUT + "select greatest(1400, max(x) + 220)::int width, greatest(900, max(y) + 120)::int height from l"))
def layout_bounds(spark: SparkSession, d: str) -> DataFrame:
    placed = views.layout(views.depth_by_type(views.shown(G.delivered(spark, d, ordered=True)).nodes))
    return views.bounds(placed).select(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))


@query(_m(_SHOWN + ", r as (select *, row_number() over (order by doc_pos) - 1 n from v) select id, 120.0::double + n % 4 * 260 x, 100.0::double + n // 4 * 170 y, display_name as label from r"))
def grid_layout(spark: SparkSession, d: str) -> DataFrame:
    return views.grid_layout(views.shown(G.delivered(spark, d, ordered=True)).nodes)


@query(_m("""select id, case when type = 'DISPATCHES' then '#f9c74f' when type = 'HANDLED_BY' then '#06d6a0' when type = 'CROSSES_REPO_BOUNDARY' then '#ff5d5d' when certainty = 3 then '#4ecdc4' when certainty = 2 then '#ffd166' else '#ff5d5d' end stroke,
case when type = 'CROSSES_REPO_BOUNDARY' then '3' when type in ('DISPATCHES', 'HANDLED_BY') then '2.4' else '1.4' end width, case when type = 'DISPATCHES' then '5 3' else '' end dash from g_edges"""))
def edge_styles(spark: SparkSession, d: str) -> DataFrame:
    return views.edge_styles(merge.merge_edges(G.edge_rows(spark, d)))


@query(_m("select id, substr(display_name, 1, 24) as label from g_nodes"))
def short_labels(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_nodes(G.node_rows(spark, d)).select("id", views.short_label(F.col("display_name")).alias("label"))


@query("select lower(trim(id)) id, unnest(map_keys(metadata)) as key, unnest(map_values(metadata)) as value from shared_nodes where id = (select min(id) from shared_nodes where cardinality(metadata) > 0)")
def node_details(spark: SparkSession, d: str) -> DataFrame:
    shared = G.table(spark, d, "shared_nodes")
    first = shared.where(F.size("metadata") > 0).agg(F.min("id").alias("id")).collect()[0].id
    return views.details(merge.merge_nodes(G.node_rows(spark, d)), first)


@query(_m("""select e.id, a.repository_name source_repository, b.repository_name target_repository from g_edges e join g_nodes a on a.id = e.source_id join g_nodes b on b.id = e.target_id
where upper(a.repository_name) is distinct from upper(b.repository_name)"""))
def repo_boundary(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.extract import crosses

    g = G.delivered(spark, d)
    n = g.nodes.select("id", "repository_name")
    a, b = n.withColumnsRenamed({"id": "source_id", "repository_name": "source_repository"}), n.withColumnsRenamed({"id": "target_id", "repository_name": "target_repository"})
    return g.edges.select("id", "source_id", "target_id").join(a, "source_id").join(b, "target_id").where(crosses(F.col("source_repository"), F.col("target_repository"))).select("id", "source_repository", "target_repository")


def top_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first ten paths as text."""
    g = G.projected(spark, d)
    return traverse.path_lines(written(traverse.paths(g, "region:0", "part:7", include_ambiguous=True)), g.nodes)


QUERIES["top_paths"] = top_paths
