"""Node and edge ids, and the fixed type lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The node types in their order, which is the sort order of a built document.
NODE_TYPES = (
    "Workspace", "Repository", "Solution", "Project", "Service", "Controller", "Endpoint", "Method", "Interface", "Implementation",
    "HttpClient", "ExternalService", "ExternalEndpoint", "DbContext", "Entity", "Table", "ConfigurationKey",
)
# The edge types in their order.
EDGE_TYPES = (
    "CONTAINS", "DEFINES", "EXPOSES", "IMPLEMENTS", "INJECTS", "CALLS", "DISPATCHES", "HANDLED_BY", "USES_HTTP_CLIENT", "CALLS_HTTP",
    "RESOLVES_TO_SERVICE", "USES_DBCONTEXT", "QUERIES_ENTITY", "MAPS_TO_TABLE", "DEPENDS_ON", "CROSSES_REPO_BOUNDARY", "AMBIGUOUS",
)
# How specific a node type is; of two types of one node the higher stays.
SPECIFICITY = {
    "Endpoint": 100, "Controller": 90, "DbContext": 85, "Entity": 84, "Table": 83, "ExternalEndpoint": 82, "ExternalService": 81, "HttpClient": 80,
    "Method": 70, "Interface": 60, "Service": 55, "Implementation": 50, "ConfigurationKey": 45, "Project": 40, "Solution": 30, "Repository": 20, "Workspace": 10,
}
# Certainties by rank.
CERTAINTIES = ("Unresolved", "Ambiguous", "Inferred", "Exact")
UNRESOLVED, AMBIGUOUS, INFERRED, EXACT = range(4)


def lookup(col: Column, table: dict[str, int], default: int | None = None) -> Column:
    """The number of a name in a fixed table, without regard to case and surrounding blanks."""
    pairs = [x for k, v in table.items() for x in (F.lit(k.lower()), F.lit(v))]
    found = F.try_element_at(F.create_map(*pairs), F.lower(F.btrim(col)))
    return found if default is None else F.coalesce(found, F.lit(default))


def type_rank(col: Column, names: tuple[str, ...]) -> Column:
    """Place of a type in its list; unknown names come last."""
    return lookup(col, {n: i for i, n in enumerate(names)}, len(names))


def type_name(col: Column, names: tuple[str, ...]) -> Column:
    """The spelling of a type as in its list; unknown names stay as they are, trimmed."""
    pairs = [x for n in names for x in (F.lit(n.lower()), F.lit(n))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.btrim(col))), F.btrim(col))


def certainty_name(col: Column) -> Column:
    return F.get(F.array(*map(F.lit, CERTAINTIES)), col.cast("int"))


def blank(col: Column) -> Column:
    """Null, empty or only white space."""
    return col.isNull() | ~col.rlike(r"\S")


def graph_id(prefix: str | Column, *parts: Column) -> Column:
    """`prefix:` and the first 16 hex digits of the SHA-256 of the trimmed parts that are not blank, joined by a pipe."""
    kept = F.filter(F.array(*parts), lambda p: ~blank(p))
    text = F.array_join(F.transform(kept, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), "|")
    return F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))


def edge_id(source: Column, target: Column, kind: Column, label: Column) -> Column:
    return graph_id("edge", source, target, kind, label)


def type_id(documentation_id: Column, full_name: Column) -> Column:
    return F.concat(F.lit("type:"), F.coalesce(documentation_id, full_name))


def method_id(documentation_id: Column, full_name: Column) -> Column:
    return F.concat(F.lit("method:"), F.coalesce(documentation_id, full_name))


def synthetic_method_id(project: Column, hint: Column, file_path: Column, offset: Column) -> Column:
    return graph_id("method", project, hint, file_path, offset.cast("string"))
