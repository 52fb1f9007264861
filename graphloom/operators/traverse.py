"""Questions on a graph: which node is meant, what it reaches, and by which paths.

Loops run level by level. Only ids move: edges are filtered once, before the loop, and their other columns are joined at
the end. Each level is written, so that the plan of a level does not hold the ones before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import counted, discard, small, written
from .merge import Graph


def admitted(exact_only: bool = False, include_ambiguous: bool = True) -> Column:
    """Which edges may be walked: only Exact ones, or all but Ambiguous and Unresolved ones, or all."""
    if exact_only:
        return F.col("certainty") == 3
    return F.lit(True) if include_ambiguous else F.coalesce(~F.col("certainty").isin(0, 1), F.lit(True))


def resolved(nodes: DataFrame, text: str) -> DataFrame:
    """The first node in document order whose id is `text`, else whose name is, else whose name or id holds it; no row if none.

    Comparison does not regard case. `''` is held by every name. `nodes` needs doc_pos.
    """
    t = F.lit(text.upper())
    name, id_ = F.upper(F.coalesce("display_name", F.lit(""))), F.upper(F.col("id"))
    tier = F.when(id_ == t, 1).when(name == t, 2).when(F.contains(name, t) | F.contains(id_, t), 3)
    return nodes.withColumn("tier", tier).where("tier is not null").orderBy("tier", "doc_pos").limit(1)


def resolve(nodes: DataFrame, text: str) -> Row:
    """The row of `resolved`. Raises LookupError if there is none."""
    found = resolved(nodes, text).collect()
    if not found:
        raise LookupError(f"no node is called {text!r}")
    return found[0]


def reach(edges: DataFrame, start: DataFrame, max_depth: int | None = None, upstream: bool = False) -> DataFrame:
    """(node_id, depth): all nodes that `start` (node_id) reaches over edges (source_id, target_id), with the fewest steps.

    Edges are followed from source to target, or with `upstream` from target to source. A written table is walked as it is.
    """
    ends = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    own = None if hasattr(edges, "_graphloom_path") else written(edges.select(*ends).where("source_id is not null and target_id is not null"))
    steps = (edges if own is None else own).select(F.col(ends[0]).alias("source_id"), F.col(ends[1]).alias("target_id"))
    level = written(start.select("node_id").distinct().select("node_id", F.lit(0).alias("depth")))
    seen, rows, size, depth = level, counted(level), counted(level, "bytes"), 0
    while counted(level) and (max_depth is None or depth < max_depth):
        depth += 1
        front = small(level.select(F.col("node_id").alias("source_id")), level)
        reached = steps.join(front, "source_id").select(F.col("target_id").alias("node_id")).distinct()
        level = written(reached.join(small(seen.select("node_id"), rows=rows, bytes_=size), "node_id", "left_anti").select("node_id", F.lit(depth).alias("depth")))
        seen, rows, size = seen.unionByName(level), rows + counted(level), size + counted(level, "bytes")
    discard(own)
    return seen


def impact(g: Graph, focus: str, upstream: bool = False, max_depth: int = 6, exact_only: bool = False, include_ambiguous: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a node affects, or with `upstream` what affects it: (nodes with depth, edges with the depth they lead from).

    Nodes at most `max_depth` steps away; all admitted edges that leave a node less than `max_depth` steps away, those to
    nodes already seen too. Edges of null ends are never walked.
    """
    usable = g.edges.where(admitted(exact_only, include_ambiguous)).where("source_id is not null and target_id is not null")
    found = written(reach(usable, g.nodes.sparkSession.createDataFrame([(focus,)], "node_id string"), max_depth, upstream))
    nodes = g.nodes.join(small(found.select(F.col("node_id").alias("id"), "depth"), found), "id")
    end = "target_id" if upstream else "source_id"
    edges = usable.join(small(found.where(F.col("depth") < max_depth).select(F.col("node_id").alias(end), "depth"), found), end)
    return nodes, edges.select(*g.edges.columns, "depth")


def paths(g: Graph, source: str, target: str, max_depth: int = 8, exact_only: bool = False, include_ambiguous: bool = False) -> DataFrame:
    """(node_ids, edge_ids, length): all paths without repeated nodes, of at most `max_depth` edges, along the edges.

    A path is known by its edges, so parallel edges make several; it ends where it first meets the target; from a node to
    itself there is one path without edges. A search backwards from the target first finds how far each node is from it, and
    no path is followed that could not arrive in time.
    """
    spark = g.nodes.sparkSession
    usable = g.edges.where(admitted(exact_only, include_ambiguous)).where("source_id is not null and target_id is not null").select("id", "source_id", "target_id")
    if source == target:
        return spark.createDataFrame([([source], [], 0)], "node_ids array<string>, edge_ids array<string>, length int")
    usable = written(usable)
    to_go = written(reach(usable, spark.createDataFrame([(target,)], "node_id string"), max_depth, upstream=True))
    left = small(to_go.select(F.col("node_id").alias("target_id"), F.col("depth").alias("to_go")), to_go)
    steps = written(usable.join(left, "target_id"))
    level = grown = written(spark.createDataFrame([(source, [source], [])], "at string, node_ids array<string>, edge_ids array<string>"))
    done = level.where("false")
    for depth in range(1, max_depth + 1):
        ahead = steps.where(F.col("to_go") <= max_depth - depth)
        grown = (
            ahead.join(small(level, grown), F.col("source_id") == F.col("at"))
            .where(~F.array_contains("node_ids", F.col("target_id")))
            .select(F.col("target_id").alias("at"), F.array_append("node_ids", F.col("target_id")).alias("node_ids"), F.array_append("edge_ids", F.col("id")).alias("edge_ids"))
        )
        grown = written(grown, open=F.when(F.col("at") != target, 1))
        done = done.unionByName(grown.where(F.col("at") == target))
        level = grown.where(F.col("at") != target)
        if not counted(grown, "open"):
            break
    return done.select("node_ids", "edge_ids", F.size("edge_ids").alias("length"))


def review(g: Graph) -> dict[str, DataFrame]:
    """What needs a look: `unresolved` and `ambiguous` edges and `symbols`, the warnings that are not certain."""
    from .merge import unresolved

    out = {"unresolved": g.edges.where("certainty = 0").orderBy(F.upper("display_name"), "id"), "ambiguous": g.edges.where("certainty = 1").orderBy("type", F.upper("display_name"), "id")}
    if g.warnings is not None:
        out["symbols"] = unresolved(g.warnings)
    return out


def path_lines(found: DataFrame, nodes: DataFrame, limit: int = 10, arrow: str = " -> ") -> DataFrame:
    """(place, line): the first paths by length and edges, as node names joined by arrows (a top-k report)."""
    first = found.orderBy("length", "edge_ids").limit(limit)
    rows = first.select("length", "edge_ids", F.posexplode("node_ids").alias("pos", "id"))
    named = rows.join(nodes.select("id", "display_name"), "id", "left")
    lines = named.groupBy("length", "edge_ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("display_name", "id").alias("n")))), lambda x: x["n"]), arrow).alias("line"))
    return lines.select("length", "line")
