"""Filtered views, tiles, metrics and layout of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .merge import Graph, statistics
from .numbering import numbered
from .traverse import reach

# Which node types each view shows; the other views choose by their edges.
VIEW_TYPES = {
    "workspace-topology": ("Workspace", "Repository", "Solution", "Project"),
    "service-dependencies": ("Controller", "Endpoint", "Service", "Implementation", "Interface", "Method", "HttpClient", "ExternalService", "ExternalEndpoint", "Project", "Repository"),
    "data-impact": ("Endpoint", "Controller", "Service", "Implementation", "Method", "DbContext", "Entity", "Table", "Project"),
}
DISPATCH_TYPES = ("DISPATCHES", "HANDLED_BY")
# Columns of the layout without a focus.
DEPTH_ORDER = (
    "Workspace", "Repository", "Solution", "Project", "Controller", "Endpoint", "Service", "Implementation", "Interface", "Method", "HttpClient",
    "ExternalService", "ExternalEndpoint", "DbContext", "Entity", "Table", "ConfigurationKey",
)
# Dashboard metrics (id, label, node type).
METRICS = (("endpoints", "Endpoints", "Endpoint"), ("controllers", "Controllers", "Controller"), ("services", "Services", "Service"), ("repositories", "Repositories", "Repository"), ("entities", "EF Core entities", "Entity"))
# Summary tiles (label, statistic).
TILES = (
    ("Repos scanned", "repository_count"), ("Projects", "project_count"), ("Endpoints", "endpoint_count"), ("Methods", "method_count"), ("MediatR edges", "dispatch_edge_count"),
    ("HTTP edges", "http_edge_count"), ("DB tables", "table_count"), ("Cross-repo links", "cross_repo_link_count"), ("Ambiguous edges", "ambiguous_edge_count"),
)
# The canned questions (id, title, description, direction).
PRESETS = (
    ("table-impact", "Show Endpoints Touching a Selected Table", "Start from a table node and walk upstream to controllers, minimal APIs, and callers.", "upstream"),
    ("cross-repo", "Show Cross-Repo Dependencies", "Filter the graph to edges that cross repository boundaries.", "downstream"),
    ("endpoint-downstream", "Show All Downstream Dependencies of an Endpoint", "Trace endpoint to handler, services, repositories, entities, tables, and HTTP calls.", "downstream"),
    ("mediatr-dispatch", "Show MediatR Dispatch Chains", "Filter to request dispatch and handler-resolution edges to inspect endpoint-to-handler flow.", "downstream"),
    ("service-callers", "Show All Upstream Callers of a Service or Method", "Walk inbound edges to reveal callers, entry points, and repos affected by a change.", "upstream"),
    ("ambiguity-audit", "Show Ambiguous Edges Requiring Human Review", "Audit all non-exact edges and unresolved static links before making a change.", "downstream"),
)
# Colours by edge type, and by certainty for the other types.
TYPE_STROKES = {"DISPATCHES": "#f9c74f", "HANDLED_BY": "#06d6a0", "CROSSES_REPO_BOUNDARY": "#ff5d5d"}
STROKES = {3: "#4ecdc4", 2: "#ffd166"}
OTHER_STROKE = "#ff5d5d"


def facets(g: Graph) -> DataFrame:
    """(facet, value): the distinct repositories, projects, node types and edge types, and `All` for each."""
    cols = [("repository", g.nodes, "repository_name"), ("project", g.nodes, "project_name"), ("node_type", g.nodes, "type"), ("edge_type", g.edges, "type")]
    out = g.nodes.sparkSession.createDataFrame([(f, "All") for f, _, _ in cols], "facet string, value string")
    for facet, df, col in cols:
        out = out.unionByName(df.where(F.col(col).isNotNull()).select(F.lit(facet).alias("facet"), F.col(col).alias("value")).distinct())
    return out


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def at_ends(nodes: DataFrame, edges: DataFrame, selected: str | None = None) -> DataFrame:
    """The nodes at an end of any edge, and the selected one."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    if selected is not None:
        ends = ends.unionByName(nodes.sparkSession.createDataFrame([(selected,)], "id string"))
    return nodes.join(ends, "id", "left_semi")


def working_graph(g: Graph, repository: str | None = None, project: str | None = None, node_type: str | None = None, edge_type: str | None = None, search: str = "", exact_only: bool = False, include_ambiguous: bool = True) -> Graph:
    """Filter nodes by equality and by text in name or id, then edges by type, certainty and both ends. None stands for all."""
    keep = F.lit(True)
    for col, value in (("repository_name", repository), ("project_name", project), ("type", node_type)):
        if value is not None:
            keep &= F.col(col).eqNullSafe(value)
    if text := search.strip().lower():
        keep &= F.contains(F.lower(F.coalesce("display_name", F.lit(""))), F.lit(text)) | F.contains(F.lower("id"), F.lit(text))
    nodes = g.nodes.where(keep)
    sure = F.lit(True) if edge_type is None else F.col("type") == edge_type
    if exact_only:
        sure &= F.col("certainty") == 3
    if not include_ambiguous:
        sure &= F.col("certainty").isin(2, 3)
    return Graph(nodes, between(g.edges.where(sure), nodes))


def view(g: Graph, name: str) -> Graph:
    """One of the named views; another name leaves the graph as it is."""
    if types := VIEW_TYPES.get(name):
        nodes = g.nodes.where(F.col("type").isin(*types))
        return Graph(nodes, between(g.edges, nodes))
    chosen: dict[str, Column] = {"mediatr-dispatch": F.col("type").isin(*DISPATCH_TYPES), "cross-repo": F.col("type") == "CROSSES_REPO_BOUNDARY", "ambiguity-audit": ~F.col("certainty").eqNullSafe(3)}
    if name in chosen:
        edges = g.edges.where(chosen[name])
        return Graph(at_ends(g.nodes, edges), edges)
    return g


def shown(g: Graph, selected: str | None = None, most_nodes: int = 160, most_edges: int = 260) -> Graph:
    """What a screen shows: the first nodes at an edge (or selected), and the first edges among them, in document order."""
    nodes = at_ends(g.nodes, g.edges, selected).orderBy("doc_pos").limit(most_nodes)
    return Graph(nodes, between(g.edges, nodes).orderBy("doc_pos").limit(most_edges))


def audit(g: Graph, most: int = 40) -> DataFrame:
    """The first edges that are not Exact, in document order."""
    return g.edges.where(~F.col("certainty").eqNullSafe(3)).orderBy("doc_pos").limit(most)


def tiles(g: Graph) -> DataFrame:
    """(label, value) of nine counts."""
    dispatch = g.edges.agg(F.count_if(F.col("type").isin(*DISPATCH_TYPES)).alias("dispatch_edge_count"))
    one = statistics(g).join(F.broadcast(dispatch))  # one row each
    return one.select(F.inline(F.array(*(F.struct(F.lit(label).alias("label"), F.col(c).cast("long").alias("value")) for label, c in TILES))))


def metrics(nodes: DataFrame) -> DataFrame:
    """(id, label, value): five counts by node type as text, zeros too."""
    counts = nodes.agg(*(F.count_if(F.col("type") == t).alias(i) for i, _, t in METRICS))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), F.col(i).cast("string").alias("value")) for i, label, _ in METRICS))))


def unavailable_metrics(spark: SparkSession) -> DataFrame:
    """The same rows with `-` where no document is there."""
    return spark.createDataFrame([(i, label, "-") for i, label, _ in METRICS], "id string, label string, value string")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "id string, title string, description string, direction string")


def depth_by_type(nodes: DataFrame) -> DataFrame:
    """Adds depth: the place of the node's type in the fixed order; unknown types stand at 0."""
    place = F.array_position(F.array(*map(F.lit, DEPTH_ORDER)), F.col("type"))
    return nodes.withColumn("depth", F.coalesce(F.greatest(place - 1, F.lit(0)), F.lit(0)).cast("int"))


def depth_by_focus(g: Graph, focus: str) -> DataFrame:
    """Adds depth: the fewest steps from the focus over the graph's edges; nodes that are not reached stand at 0."""
    start = g.nodes.sparkSession.createDataFrame([(focus,)], "node_id string")
    found = reach(g.edges, start).withColumnsRenamed({"node_id": "id"})
    return g.nodes.join(found, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def layout(nodes: DataFrame) -> DataFrame:
    """(id, x, y) of nodes with depth: a column per depth, rows in document order. For what a screen shows (`shown`)."""
    row = F.row_number().over(W.partitionBy("depth").orderBy("doc_pos")) - 1
    return nodes.select("id", (140 + 250 * F.col("depth")).alias("x"), (80 + 82 * row).alias("y"))


def bounds(placed: DataFrame) -> DataFrame:
    """(width, height) that hold a layout; at least 1400 by 900."""
    return placed.agg(F.greatest(F.lit(1400), F.coalesce(F.max("x") + 220, F.lit(0))).alias("width"), F.greatest(F.lit(900), F.coalesce(F.max("y") + 120, F.lit(0))).alias("height"))


def grid_layout(nodes: DataFrame) -> DataFrame:
    """(id, x, y, label): places given in metadata layoutX and layoutY, else a grid of four columns in document order."""
    x, y = F.try_element_at("metadata", F.lit("layoutX")).try_cast("double"), F.try_element_at("metadata", F.lit("layoutY")).try_cast("double")
    given = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
    name = F.coalesce("id", "display_name", F.concat("type", F.lit("-"), F.col("n").cast("string")))
    return numbered(nodes, ["doc_pos"], "n").select(name.alias("id"), F.when(given, x).otherwise(120.0 + F.col("n") % 4 * 260).alias("x"), F.when(given, y).otherwise(100.0 + F.expr("n div 4") * 170).alias("y"), F.coalesce("display_name", "id", "type").alias("label"))


def edge_styles(edges: DataFrame, colours: dict[str, str] = TYPE_STROKES) -> DataFrame:
    """(id, stroke, width, dash): a colour by type or else by certainty, a width and a dash by type."""
    stroke = F.when(F.col("certainty") == 3, STROKES[3]).when(F.col("certainty") == 2, STROKES[2]).otherwise(OTHER_STROKE)
    if colours:
        stroke = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]), F.col("type")), stroke)
    width = F.when(F.col("type") == "CROSSES_REPO_BOUNDARY", "3").when(F.col("type").isin(*DISPATCH_TYPES), "2.4").otherwise("1.4")
    return edges.select(F.coalesce("id", F.concat_ws("-", "source_id", "target_id")).alias("id"), stroke.alias("stroke"), width.alias("width"), F.when(F.col("type") == "DISPATCHES", "5 3").otherwise("").alias("dash"))


def short_label(name: Column, most: int = 24) -> Column:
    return F.substring(name, 1, most)


def details(nodes: DataFrame, node_id: str) -> DataFrame:
    """(id, key, value) of a node: its metadata entries."""
    return nodes.where(F.col("id") == node_id).select("id", F.explode("metadata").alias("key", "value"))
