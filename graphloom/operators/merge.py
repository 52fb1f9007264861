"""Rows as delivered to a graph: upsert-merge, build order, statistics and integrity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import EDGE_TYPES, NODE_TYPES, SPECIFICITY, blank, edge_id, lookup, type_name, type_rank
from ..functions.keys import key
from .numbering import numbered


@dataclass
class Graph:
    """Merged nodes and edges (lazy DataFrames, see `merge_nodes` and `merge_edges`), and the warnings of a scan."""

    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame | None = None


def _first(value: Column, seq: Column, keep: Column | None = None) -> Column:
    """Value of the first row in which it is there."""
    return F.min_by(value, F.when(value.isNotNull() if keep is None else keep, seq))


def fold_metadata(rows: DataFrame, by: str) -> DataFrame:
    """(by, folded): the maps of each key folded in the order of `seq`, from (by, seq, metadata).

    Names compare without case and keep their first spelling; a blank value is replaced by what comes, an equal one stays,
    another one is appended as `old | new`. Blank names are skipped, but the first map that is not empty is taken whole.
    The rows of a key stream by in order; what is held of a key is its folded map alone.
    """
    kind = rows.schema[by].dataType.simpleString()
    entries = F.transform(F.map_entries("metadata"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    sorted_ = rows.where(F.size("metadata") > 0).select(F.col(by), "seq", entries.alias("entries")).repartition(by).sortWithinPartitions(by, "seq").select(by, "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_blank = lambda text: text is None or not text.strip(" \t\n\x0b\f\r")
        own, acc = None, {}  # lower-case name: [name, parts of the value or None, its length]

        def done() -> tuple:
            return own, [(k, None if parts is None else " | ".join(parts)) for k, parts, _ in acc.values()]

        for b in batches:
            out = []
            for key_, es in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key_ != own:
                    if own is not None:
                        out.append(done())
                    own, acc = key_, {}
                first = not acc
                for e in es:
                    name, value = e["key"], e["value"]
                    at = None if first else acc.get(name.lower())
                    if first:  # taken whole, names that differ in case alone too
                        acc[name.lower() if name.lower() not in acc else (name, len(acc))] = [name, None if value is None else [value], len(value or "")]
                    elif is_blank(name):
                        continue
                    elif at is None:
                        acc[name.lower()] = [name, None if value is None else [value], len(value or "")]
                    elif at[1] is None or len(at[1]) == 1 and is_blank(at[1][0]):
                        at[1], at[2] = None if value is None else [value], len(value or "")
                    elif not is_blank(value) and not (at[2] == len(value) and " | ".join(at[1]).lower() == value.lower()):
                        at[1].append(value)
                        at[2] += 3 + len(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], b.schema.field(0).type), pa.array([m for _, m in out], pa.map_(pa.string(), pa.string()))], names=[by, "folded"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([done()[1]], pa.map_(pa.string(), pa.string()))], names=[by, "folded"])

    return sorted_.mapInArrow(run, f"`{by}` {kind}, folded map<string,string>")


def _merged(rows: DataFrame, by: str, extra: list[Column]) -> DataFrame:
    """The columns that nodes and edges merge alike, per key `by`, in the order of `seq`.

    Everything but the metadata fold is a plain aggregate that combines before the shuffle. The fold is ordered and not
    idempotent (a, b, b gives `a | b | b`), so it needs all maps, but only of keys whose maps differ at all; any number of
    equal deliveries folds to the first. These stream by in order, and no list of them is gathered.
    """
    seq, full = F.col("seq"), F.size("metadata") > 0
    rows = rows.withColumn("mark", F.when(full, F.xxhash64(F.to_json(F.array_sort(F.map_entries("metadata")), {"ignoreNullFields": "false"}))))
    base = rows.groupBy(by).agg(
        *extra,
        _first(F.col("source_location"), seq).alias("source_location"),
        _first(F.col("repository_name"), seq).alias("repository_name"),
        _first(F.col("project_name"), seq).alias("project_name"),
        F.max("certainty").alias("certainty"),
        F.map_from_entries(F.min_by(F.map_entries("metadata"), F.when(full, seq))).alias("first_map"),
        F.min("mark").alias("mark_lo"),
        F.max("mark").alias("mark_hi"),
        F.min("seq").alias("seq"),
    )
    differ = base.where("mark_lo < mark_hi").select(by)
    folds = fold_metadata(rows.select(by, "seq", "metadata").join(differ, by, "left_semi"), by)
    empty = F.create_map().cast("map<string,string>")
    return base.join(folds, by, "left").withColumn("metadata", F.coalesce("folded", "first_map", empty)).drop("folded", "first_map", "mark_lo", "mark_hi")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """One row per node id: (id, type, display_name, source_location, repository_name, project_name, certainty, metadata, seq).

    `rows` has these columns, `seq` giving the order of arrival. Ids compare without case and blanks and come out in lower
    case; rows without id are left out. The more specific type stays (the earlier of equals), the first display name that
    is not blank, the first location, repository and project that are there, the highest certainty, and the metadata fold.
    """
    own = rows.withColumn("node_key", key("id")).where("node_key is not null")
    rank = lookup(F.col("type"), SPECIFICITY, 0)
    extra = [
        F.min_by(type_name(F.col("type"), NODE_TYPES), F.when(F.col("type").isNotNull(), F.struct(-rank, "seq"))).alias("type"),
        F.coalesce(_first(F.col("display_name"), F.col("seq"), ~blank(F.col("display_name"))), F.max_by("display_name", "seq")).alias("display_name"),
    ]
    return _merged(own, "node_key", extra).select(F.col("node_key").alias("id"), "type", "display_name", "source_location", "repository_name", "project_name", F.col("certainty").cast("tinyint").alias("certainty"), "metadata", "seq")


def merge_edges(rows: DataFrame, make_ids: bool = False) -> DataFrame:
    """One row per edge: as merge_nodes, with source_id and target_id; type, ends and label are those of the first row.

    make_ids: the id is made from ends, type and label, so equal links merge; else rows merge by the `id` they have.
    """
    if make_ids:
        rows = rows.withColumn("id", edge_id(F.col("source_id"), F.col("target_id"), F.col("type"), F.col("display_name")))
    own = rows.withColumn("edge_key", key("id")).where("edge_key is not null")
    seq = F.col("seq")
    extra = [
        F.min_by(key("source_id"), seq).alias("source_id"),
        F.min_by(key("target_id"), seq).alias("target_id"),
        F.min_by(type_name(F.col("type"), EDGE_TYPES), seq).alias("type"),
        F.min_by("display_name", seq).alias("display_name"),
    ]
    return _merged(own, "edge_key", extra).select(F.col("edge_key").alias("id"), "source_id", "target_id", "type", "display_name", "source_location", "repository_name", "project_name", F.col("certainty").cast("tinyint").alias("certainty"), "metadata", "seq")


def build_order(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Adds doc_pos, the place in the built document: by type, then name in upper case, then arrival.

    The places are exact without one task sorting everything (see `numbered`).
    """
    order = [type_rank(F.col("type"), types).alias("o_type"), F.upper(F.coalesce("display_name", F.lit(""))).alias("o_name")]
    return numbered(rows.select("*", *order), ["o_type", "o_name", "seq"], "doc_pos").drop("o_type", "o_name")


def unresolved(warnings: DataFrame) -> DataFrame:
    """Warnings of certainty Unresolved or Ambiguous; a warning without certainty is Unresolved."""
    return warnings.where(F.coalesce("certainty", F.lit(0)).isin(0, 1))


def statistics(g: Graph) -> DataFrame:
    """One row of nine counts."""
    n = lambda t, name: F.count_if(F.col("type") == t).alias(name)
    nodes = g.nodes.agg(n("Repository", "repository_count"), n("Solution", "solution_count"), n("Project", "project_count"), n("Endpoint", "endpoint_count"), n("Method", "method_count"), n("Table", "table_count"))
    edges = g.edges.agg(F.count_if(F.col("type").isin("CALLS_HTTP", "USES_HTTP_CLIENT")).alias("http_edge_count"), n("CROSSES_REPO_BOUNDARY", "cross_repo_link_count"), F.count_if(F.col("certainty").isin(0, 1)).alias("ambiguous_edge_count"))
    return nodes.join(F.broadcast(edges))  # one row each


def dangling(g: Graph) -> DataFrame:
    """(edge_id, end_name, node_id) of edge ends that no node has; an engine that walks such a graph would fail on them."""
    ends = g.edges.select(F.col("id").alias("edge_id"), F.expr("stack(2, 'source', source_id, 'target', target_id) as (end_name, node_id)"))
    return ends.where("node_id is not null").join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("edge_id", "end_name", "node_id")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(id, rows) of ids that occur more than once in a built table."""
    return rows.groupBy(key("id").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1")
