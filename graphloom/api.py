"""Questions in one call each, on a graph in memory: the functions behind the command line and any server.

Results are lazy DataFrames or small rows. A graph is held in `State`, which a scan or a loaded file replaces whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import extract, merge, reports, traverse, views
from .operators.merge import Graph
from .session import written
from .sources import discovery, exchange

#: Rows that a printed report shows; the operators themselves have no limit.
SHOWN_EDGES, SHOWN_PATHS, SHOWN_REVIEW = 40, 10, 50


class NotLoaded(LookupError):
    """No graph is loaded yet."""


@dataclass
class State:
    """The current graph with its scan metadata."""

    graph: Graph | None = None
    metadata: dict = field(default_factory=dict)

    def need(self) -> Graph:
        if self.graph is None:
            raise NotLoaded("no graph is loaded")
        return self.graph


def scan(spark: SparkSession, facts: extract.Facts, state: State | None = None, report: Callable[[str], None] = lambda line: None, contributors=extract.CONTRIBUTORS) -> State:
    """Build a graph from fact tables and make it the current one; stage times go to the metadata."""
    state = state or State()
    began, timings = time.perf_counter(), []
    started = datetime.now(timezone.utc)

    def stage(name: str, make):
        t = time.perf_counter()
        out = make()
        timings.append({"stage": name, "elapsed": round(time.perf_counter() - t, 3)})
        report(f"[{name}] {timings[-1]['elapsed']:.1f}s")
        return out

    g = stage("build", lambda: extract.build(facts, contributors))
    state.graph = stage("write", lambda: Graph(written(g.nodes), written(g.edges), g.warnings))
    state.metadata = {"startedAtUtc": started.isoformat(), "completedAtUtc": datetime.now(timezone.utc).isoformat(), "timings": timings}
    report(f"[scan] Scan complete in {time.perf_counter() - began:.1f}s")
    return state


def scan_folder(spark: SparkSession, root: str, excluded: list[str] | None = None, state: State | None = None) -> State:
    """Scan a folder's listing: repositories, solutions, projects and settings. Facts of code come from fact tables.

    `excluded` is by default what the root's own ignore file names.
    """
    tables = discovery.discover(written(discovery.listing(spark, root)), root, excluded if excluded is not None else discovery.excluded_paths(spark, root))
    return scan(spark, {k: v for k, v in tables.items()}, state)


def load(spark: SparkSession, path: str, state: State | None = None) -> State:
    """Make the graph of a JSON document the current one."""
    state = state or State()
    g = exchange.read_document(spark, path)
    state.graph = Graph(written(g.nodes), written(g.edges), written(g.warnings))
    return state


def summary(state: State) -> dict:
    """Statistics, scan metadata and the number of warnings."""
    g = state.need()
    return {"statistics": merge.statistics(g).first().asDict(), "scanMetadata": state.metadata, "warningCount": g.warnings.count() if g.warnings is not None else 0}


def summary_text(state: State) -> list[str]:
    return [r.line for r in reports.summary_lines(merge.statistics(state.need())).orderBy("place").collect()]


def impact(state: State, node: str, direction: str = "downstream", depth: int = 6, exact_only: bool = False, include_ambiguous: bool = True):
    """(focus row, nodes, edges) of what a node affects, or with direction `upstream` what affects it."""
    g = state.need()
    focus = traverse.resolve(g.nodes, node)
    nodes, edges = traverse.impact(g, focus.id, direction.lower() == "upstream", depth, exact_only, include_ambiguous)
    return focus, nodes.orderBy(F.upper("display_name"), "doc_pos"), edges.orderBy("depth", "doc_pos")


def impact_text(state: State, node: str, direction: str = "downstream", depth: int = 6, exact_only: bool = False, include_ambiguous: bool = True) -> list[str]:
    """Focus, counts and the first edges, as printed."""
    focus, nodes, edges = impact(state, node, direction, depth, exact_only, include_ambiguous)
    nodes, edges = written(nodes), written(edges)
    first = edges.orderBy("depth", "doc_pos").limit(SHOWN_EDGES).collect()
    return [f"Focus: {focus.display_name} ({focus.type})", f"Nodes: {nodes.count()}", f"Edges: {edges.count()}", *(f"{e.type}: {e.display_name}" for e in first)]


def paths(state: State, source: str, target: str, depth: int = 8, exact_only: bool = False, include_ambiguous: bool = False) -> DataFrame:
    """(node_ids, edge_ids, length) of the simple paths between two nodes."""
    g = state.need()
    return traverse.paths(g, traverse.resolve(g.nodes, source).id, traverse.resolve(g.nodes, target).id, depth, exact_only, include_ambiguous)


def paths_text(state: State, source: str, target: str, depth: int = 8, exact_only: bool = False, include_ambiguous: bool = False) -> list[str]:
    found = written(paths(state, source, target, depth, exact_only, include_ambiguous))
    lines = traverse.path_lines(found, state.need().nodes, SHOWN_PATHS).orderBy("length", "line").collect()
    return [f"Paths: {found.count()}", *(r.line for r in lines)]


def review_text(state: State, limit: int = SHOWN_REVIEW) -> list[str]:
    """Unresolved edges, ambiguous edges by type, and uncertain warnings, each as far as `limit` and with what is left."""
    out: list[str] = []
    for title, df in traverse.review(state.need()).items():
        n = df.count()
        out.append(f"{title}: {n}")
        if title == "ambiguous":
            out += [f"  {r.type}: {r['count']}" for r in df.groupBy("type").count().orderBy("type").collect()]
        shown = df.limit(limit).collect()
        out += [f"  {r.display_name if 'display_name' in df.columns else r.message}" for r in shown]
        if n > len(shown):
            out.append(f"  ... {n - len(shown)} more")
    return out


def presets(spark: SparkSession) -> DataFrame:
    return views.presets(spark)
