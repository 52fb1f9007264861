"""The graph of the delivered tables, the projection of the business tables to a graph, and the SQL of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import EDGE_TYPES, NODE_TYPES, SPECIFICITY
from ..functions.keys import key
from ..operators.merge import Graph, build_order, merge_edges, merge_nodes
from ..session import written

#: Arrival numbers of shared nodes start here, after all others.
SHARED_FROM = 10**12


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def node_rows(spark: SparkSession, d: str) -> DataFrame:
    """Delivered node rows of both node tables with `seq`."""
    cols = ["id", "type", "display_name", "source_location", "repository_name", "project_name", "certainty", "metadata"]
    own = table(spark, d, "nodes").select(*cols, F.col("doc_pos").alias("seq"))
    shared = table(spark, d, "shared_nodes")  # a fixed, small table
    return own.unionByName(shared.select(*cols, (F.lit(SHARED_FROM) + F.row_number().over(W.orderBy("id"))).alias("seq")))


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").select("id", "source_id", "target_id", "type", "display_name", "source_location", "repository_name", "project_name", "certainty", "metadata", F.col("doc_pos").alias("seq"))


def delivered(spark: SparkSession, d: str, ordered: bool = False) -> Graph:
    """The merged graph; with `ordered`, in document order (doc_pos)."""
    nodes, edges = merge_nodes(node_rows(spark, d)), merge_edges(edge_rows(spark, d))
    if not ordered:
        return Graph(nodes, edges)
    return Graph(build_order(nodes, NODE_TYPES), build_order(edges, EDGE_TYPES))


def links_only(spark: SparkSession, d: str) -> Graph:
    """Merged edges by their ends and certainty alone, and node ids: what a walk needs, without the other columns."""
    e = table(spark, d, "edges")
    edges = e.select(key("id").alias("id"), key("source_id").alias("s"), key("target_id").alias("t"), F.upper(F.btrim("type")).alias("type"), "certainty", "doc_pos").where("id is not null")
    edges = edges.groupBy("id").agg(F.min_by("s", "doc_pos").alias("source_id"), F.min_by("t", "doc_pos").alias("target_id"), F.min_by("type", "doc_pos").alias("type"), F.max("certainty").alias("certainty"))
    nodes = node_rows(spark, d).select(key("id").alias("id")).where("id is not null").distinct()
    return Graph(written(nodes), written(edges))


#: Certainty of a line item, by its flags.
_SURE = "CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END END"
#: The projection, in SQL that both engines read.
PROJECTED_NODES = """
select concat('region:', r_regionkey) id, 'Workspace' type, r_name display_name, cast(null as varchar(100)) repository_name, cast(null as varchar(100)) project_name, 3 certainty from region
union all select concat('nation:', n_nationkey), 'Repository', n_name, n_name, null, 3 from nation
union all select concat('customer:', c_custkey), 'Project', c_name, n_name, c_name, 3 from customer join nation on c_nationkey = n_nationkey
union all select concat('order:', o_orderkey), 'Endpoint', concat('GET /orders/', o_orderkey), n_name, c_name, case o_orderstatus when 'F' then 3 when 'O' then 2 else 1 end from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
union all select concat('supplier:', s_suppkey), 'Service', s_name, n_name, s_name, 3 from supplier join nation on s_nationkey = n_nationkey
union all select concat('part:', p_partkey), 'Table', p_name, null, null, 2 from part
union all select distinct concat('evt:', event_type), 'Method', event_type, null, null, 3 from events where event_type is not null
"""
PROJECTED_EDGES = f"""
select source_id, target_id, type, max(certainty) certainty, concat(source_id, '>', target_id, ':', type) id from (
  select concat('region:', n_regionkey) source_id, concat('nation:', n_nationkey) target_id, 'CONTAINS' type, 3 certainty from nation
  union all select concat('nation:', c_nationkey), concat('customer:', c_custkey), 'CONTAINS', 3 from customer
  union all select concat('customer:', o_custkey), concat('order:', o_orderkey), 'EXPOSES', 3 from orders
  union all select concat('order:', l_orderkey), concat('supplier:', l_suppkey), 'CALLS', 3 from lineitem
  union all select concat('order:', l_orderkey), concat('part:', l_partkey), 'DEPENDS_ON', {_SURE} from lineitem
  union all select concat('order:', o_orderkey), concat('supplier:', s_suppkey), 'CROSSES_REPO_BOUNDARY', 3
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey
  union all select concat('evt:', event_type), concat('evt:', following), 'CALLS', 3 from (
    select event_type, lead(event_type) over (partition by user_id order by ts, event_id) following from events) steps where following is not null
) raw group by source_id, target_id, type
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def projected(spark: SparkSession, d: str) -> Graph:
    """The business tables as a graph."""
    names = {t: table(spark, d, t) for t in TABLES}
    own = {t: f"{{{t}}}" for t in TABLES}

    def sql(text: str) -> DataFrame:
        for t in TABLES:
            text = text.replace(f"from {t} ", f"from {own[t]} {t} ").replace(f"join {t} ", f"join {own[t]} {t} ").replace(f"from {t}\n", f"from {own[t]} {t}\n").replace(f"from {t})", f"from {own[t]} {t})")
        return spark.sql(text, **{t: df for t, df in names.items() if own[t] in text})

    return Graph(sql(PROJECTED_NODES), sql(PROJECTED_EDGES))


def _values(names: tuple[str, ...]) -> str:
    return ", ".join(f"('{n}', '{n.lower()}', {i}, {SPECIFICITY.get(n, 0)})" for i, n in enumerate(names))


#: DuckDB: the merged graph as g_nodes and g_edges (merge rules written again from their description, in SQL).
MERGED = f"""
n_types(name, low, ord, prio) as (values {_values(NODE_TYPES)}),
e_types(name, low, ord, prio) as (values {_values(EDGE_TYPES)}),
raw_nodes as (
  select lower(trim(id)) id, type, display_name, source_location, repository_name, project_name, certainty, metadata, doc_pos seq from nodes
  union all select lower(trim(id)), type, display_name, source_location, repository_name, project_name, certainty, metadata, {SHARED_FROM} + row_number() over (order by id) from shared_nodes),
g_nodes as (
  select id, first(coalesce(t.name, trim(type)) order by coalesce(prio, 0) desc, seq) filter (where type is not null) as type,
    coalesce(first(display_name order by seq) filter (where regexp_matches(display_name, '\\S')), last(display_name order by seq)) display_name,
    first(source_location order by seq) filter (where source_location is not null) source_location,
    first(repository_name order by seq) filter (where repository_name is not null) repository_name,
    first(project_name order by seq) filter (where project_name is not null) project_name,
    max(certainty) certainty, min(seq) seq
  from raw_nodes left join n_types t on t.low = lower(trim(type)) where id is not null and id <> '' group by id),
g_edges as (
  select lower(trim(id)) id, first(lower(trim(source_id)) order by doc_pos) source_id, first(lower(trim(target_id)) order by doc_pos) target_id,
    first(coalesce(t.name, trim(type)) order by doc_pos) as type, first(display_name order by doc_pos) display_name,
    first(repository_name order by doc_pos) filter (where repository_name is not null) repository_name,
    first(project_name order by doc_pos) filter (where project_name is not null) project_name,
    max(certainty) certainty, min(doc_pos) seq
  from edges left join e_types t on t.low = lower(trim(type)) where id is not null and trim(id) <> '' group by 1),
o_nodes as (select g.*, row_number() over (order by coalesce(ord, 17), upper(coalesce(display_name, '')), seq) - 1 doc_pos from g_nodes g left join n_types t on t.name = g.type),
o_edges as (select g.*, row_number() over (order by coalesce(ord, 17), upper(coalesce(display_name, '')), seq) - 1 doc_pos from g_edges g left join e_types t on t.name = g.type)
"""
#: DuckDB: the projection as p_nodes and p_edges.
PROJECTED = f"p_nodes as ({PROJECTED_NODES}), p_edges as ({PROJECTED_EDGES})"
