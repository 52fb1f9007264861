"""Facts about code to graph rows. Each contributor is a function `facts -> list of Rows`; `build` merges them in order.

`facts` maps table names to DataFrames (README lists their columns); a contributor skips tables that are not there. Every
fact row has `seq`, the order in which it was met, and mostly repository_name, project_name and location.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import routes as R
from ..functions.ids import AMBIGUOUS, EDGE_TYPES, EXACT, INFERRED, NODE_TYPES, UNRESOLVED, blank, graph_id
from ..functions.paths import file_name, stem
from ..functions.routes import absolute_url, combine_uri, host, segments, url_path
from ..session import counted, discard, written
from .merge import Graph, build_order, merge_edges, merge_nodes

Facts = dict[str, DataFrame]
LOCATION = "struct<file_path:string,line:int,column:int>"
# Endings of names that make a class a service.
SERVICE_ENDINGS = ("Service", "Repository", "Manager", "Handler", "Client")
# Base classes that decide a class's type.
CONTEXT_BASE, CONTROLLER_BASE = "Microsoft.EntityFrameworkCore.DbContext", "Microsoft.AspNetCore.Mvc.ControllerBase"
# Methods that register an implementation of a service.
REGISTRATIONS = ("AddScoped", "AddTransient", "AddSingleton", "TryAddScoped", "TryAddTransient", "TryAddSingleton")
# Fixed value: tables named in SQL text.
SQL_TABLE = r"(?i)\b(?:from|join|update|into|table)\s+([A-Za-z0-9_.\[\]]+)"


@dataclass
class Rows:
    """Node or edge rows of one contributor, before merging."""

    kind: str
    df: DataFrame


def _nodes(df: DataFrame, id_: Column, type_: Column | str, name: Column, certainty: Column | int = EXACT, location: Column | None = None, repository: Column | None = None, project: Column | None = None, metadata: dict[str, Column] | None = None) -> Rows:
    return Rows("node", df.select(id_.alias("id"), _lit(type_).alias("type"), name.alias("display_name"), _null(location, LOCATION).alias("source_location"), _null(repository, "string").alias("repository_name"), _null(project, "string").alias("project_name"), _lit(certainty).cast("tinyint").alias("certainty"), _map(metadata).alias("metadata"), "seq"))


def _edges(df: DataFrame, source: Column, target: Column, type_: Column | str, label: Column, certainty: Column | int = EXACT, location: Column | None = None, repository: Column | None = None, project: Column | None = None, metadata: dict[str, Column] | None = None) -> Rows:
    rows = df.where(source.isNotNull() & target.isNotNull())
    return Rows("edge", rows.select(source.alias("source_id"), target.alias("target_id"), _lit(type_).alias("type"), label.alias("display_name"), _null(location, LOCATION).alias("source_location"), _null(repository, "string").alias("repository_name"), _null(project, "string").alias("project_name"), _lit(certainty).cast("tinyint").alias("certainty"), _map(metadata).alias("metadata"), "seq"))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _null(x: Column | None, kind: str) -> Column:
    return F.lit(None).cast(kind) if x is None else x.cast(kind)


def _map(metadata: dict[str, Column] | None) -> Column:
    if not metadata:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))])


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts))


def _place(path: Column) -> Column:
    return F.when(path.isNotNull(), F.struct(path.alias("file_path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column")))


def _own(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


c = F.col


# -- names -------------------------------------------------------------------------------------------------------------
def classify(kind: Column, name: Column, bases: Column) -> Column:
    """Node type of a declared type from its kind, name and the full names of its base classes (itself first)."""
    ends = lambda *xs: F.greatest(*(F.endswith(name, F.lit(x)).cast("int") for x in (*xs, *xs))) == 1
    return (
        F.when(kind == "interface", "Interface")
        .when(F.array_contains(bases, CONTEXT_BASE), "DbContext")
        .when(F.array_contains(bases, CONTROLLER_BASE) | ends("Controller"), "Controller")
        .when(ends(*SERVICE_ENDINGS), "Service")
        .otherwise("Implementation")
    )


def inherits(type_bases: DataFrame, deepest: int = 64) -> DataFrame:
    """(type_name, base_name, depth): all base classes of each type, itself at 0, from direct links (type_name, base_name).

    Rounds double the reach, so a chain of any depth up to 2^`deepest` ends after as many rounds as its depth has bits. A
    shortest chain longer than `half` passes a type at exactly that depth, so only pairs of that depth are carried on.
    """
    direct = type_bases.where("type_name is not null and base_name is not null and type_name != base_name").select("type_name", "base_name").distinct()
    own = type_bases.select(F.explode(F.array("type_name", "base_name")).alias("type_name")).where("type_name is not null").distinct().select("type_name", c("type_name").alias("base_name"), F.lit(0).alias("depth"))
    far = written(own.unionByName(direct.withColumn("depth", F.lit(1))), ends=F.when(c("depth") == 1, 1))
    for bit in range(deepest):
        if not counted(far, "ends"):  # no pair at the present reach, so none beyond it
            break
        half = 1 << bit
        on = far.where("depth > 0").select(c("type_name").alias("base_name"), c("base_name").alias("up"), c("depth").alias("more"))
        more = far.where(c("depth") == half).join(on, "base_name").select("type_name", c("up").alias("base_name"), (c("depth") + c("more")).alias("depth"))
        before, far = far, written(far.unionByName(more).groupBy("type_name", "base_name").agg(F.min("depth").alias("depth")), ends=F.when(c("depth") == 2 * half, 1))
        discard(before)
    return far


def named_tables(sql: Column) -> Column:
    """Array of the tables that SQL text names, as written, in order and with repeats."""
    return F.regexp_extract_all(sql, F.lit(SQL_TABLE), F.lit(1))


# -- contributors ------------------------------------------------------------------------------------------------------
def topology(f: Facts) -> list[Rows]:
    """Workspace, repositories, solutions, projects and settings, and who contains whom."""
    out: list[Rows] = []
    root = f["workspace"]
    out.append(_nodes(root, graph_id("workspace", c("root_path")), "Workspace", file_name(c("root_path")), location=_place(c("root_path")), metadata={"rootPath": c("root_path")}))
    above = F.broadcast(root.select(c("root_path").alias("ws_path")))  # one row
    if "repositories" in f:
        d = f["repositories"].join(above)
        own = graph_id("repository", c("root_path"))
        out.append(_nodes(d, own, "Repository", c("name"), location=_place(c("root_path")), repository=c("name"), metadata={"rootPath": c("root_path")}))
        out.append(_edges(d, graph_id("workspace", c("ws_path")), own, "CONTAINS", _text(file_name(c("ws_path")), " contains ", c("name"))))
    for table, prefix, kind in (("solutions", "solution", "Solution"), ("projects", "project", "Project")):
        if table not in f:
            continue
        d = f[table].join(above)
        own = graph_id(prefix, c("full_path"))
        owner = F.when(c("repository_path").isNotNull(), graph_id("repository", c("repository_path"))).otherwise(graph_id("workspace", c("ws_path")))
        label = _text(owner, " contains ", c("name")) if table == "solutions" else _text(F.coalesce(c("repository_name"), file_name(c("ws_path"))), " contains ", c("name"))
        out.append(_nodes(d, own, kind, c("name"), location=_place(c("full_path")), repository=c("repository_name"), project=c("name") if table == "projects" else None, metadata={"filePath": c("full_path")}))
        out.append(_edges(d, owner, own, "CONTAINS", label))
    if "config_values" in f:
        d = f["config_values"]
        out.append(_nodes(d, graph_id("config", c("file_path"), c("key")), "ConfigurationKey", c("key"), INFERRED, _place(c("file_path")), _own(d, "repository_name"), metadata={"value": c("value"), "filePath": c("file_path")}))
    return out


def project_graph(f: Facts) -> list[Rows]:
    """Projects and their references, types, interfaces, injected services, methods and calls."""
    out: list[Rows] = []
    at = lambda d: {"location": _own(d, "location"), "repository": c("repository_name"), "project": c("project_name")}
    if "projects" in f:
        d = f["projects"]
        own = graph_id("project", c("full_path"))
        out.append(_nodes(d, own, "Project", c("name"), location=_place(c("full_path")), repository=c("repository_name"), project=c("name"), metadata={"filePath": c("full_path"), "assemblyName": _own(d, "assembly_name")}))
        if "solution_path" in d.columns:
            s = d.where("solution_path is not null")
            out.append(_edges(s, graph_id("solution", c("solution_path")), own, "CONTAINS", _text(stem(c("solution_path")), " contains ", c("name")), repository=c("repository_name"), project=c("name")))
        if "project_refs" in f:
            p = d.select(c("full_path").alias("project_path"), c("name").alias("from_name"), c("repository_name").alias("from_repo"))
            q = d.select(c("full_path").alias("referenced_path"), c("name").alias("to_name"), c("repository_name").alias("to_repo"))
            r = f["project_refs"].select("seq", "project_path", "referenced_path").join(p, "project_path").join(q, "referenced_path")
            a, b = graph_id("project", c("project_path")), graph_id("project", c("referenced_path"))
            here = {"repository": c("from_repo"), "project": c("from_name")}
            out.append(_edges(r, a, b, "DEPENDS_ON", _text(c("from_name"), " references ", c("to_name")), **here))
            out.append(_edges(r.where(crosses(c("from_repo"), c("to_repo"))), a, b, "CROSSES_REPO_BOUNDARY", _text(c("from_name"), " crosses into ", c("to_name")), **here))
    if "types" in f:
        d = f["types"]
        kind = classify(c("kind"), c("name"), _own(d, "bases").cast("array<string>"))
        out.append(_nodes(d, c("type_id"), kind, c("name"), metadata={"fullName": c("full_name"), "namespace": c("namespace"), "kind": c("kind")}, **at(d)))
        out.append(_edges(d, graph_id("project", c("project_path")), c("type_id"), "DEFINES", _text(c("project_name"), " defines ", c("name")), **at(d)))
    if "type_interfaces" in f:
        d = f["type_interfaces"].where("is_direct")
        out.append(_nodes(d, c("interface_id"), "Interface", c("interface_name"), **at(d)))
        out.append(_edges(d, c("type_id"), c("interface_id"), "IMPLEMENTS", _text(c("type_name"), " implements ", c("interface_name")), **at(d)))
    if "injections" in f:
        d = f["injections"].where("ctor_public and in_source")
        out.append(_nodes(d, c("parameter_type_id"), classify(c("parameter_kind"), c("parameter_name"), F.array().cast("array<string>")), c("parameter_name"), **at(d)))
        out.append(_edges(d, c("type_id"), c("parameter_type_id"), "INJECTS", _text(c("type_name"), " injects ", c("parameter_name")), **at(d)))
    if "methods" in f:
        d = f["methods"].where("not coalesce(is_accessor, false)") if "is_accessor" in f["methods"].columns else f["methods"]
        out.append(_nodes(d, c("method_id"), "Method", c("display_name"), metadata={"returns": c("returns")}, **at(d)))
        out.append(_edges(d, c("type_id"), c("method_id"), "DEFINES", _text(c("type_name"), " defines ", c("name")), **at(d)))
    if "calls" in f:
        d = f["calls"].where("target_in_source")
        out.append(_nodes(d, c("target_id"), "Method", _text(c("target_type_name"), ".", c("target_name")), **at(d)))
        out.append(_edges(d, c("caller_id"), c("target_id"), "CALLS", _text(c("caller_name"), " calls ", c("target_type_name"), ".", c("target_name")), **at(d)))
        if "impl_methods" in f:
            r = interface_targets(f["calls"], f["impl_methods"], f.get("registrations"))
            out.append(_nodes(r, c("method_id"), "Method", c("display_name"), c("certainty")))
            out.append(_edges(r, c("caller_id"), c("method_id"), F.when(c("certainty") == AMBIGUOUS, "AMBIGUOUS").otherwise("CALLS"), _text(c("caller_name"), " resolves ", c("target_name")), c("certainty"), metadata={"interfaceMethod": c("target_id"), "resolution": c("resolution")}, **at(r)))
    out += dispatches(f)
    return out


def crosses(a: Column, b: Column) -> Column:
    """Do two repository names differ, without regard to case? Two nulls do not."""
    return ~F.upper(a).eqNullSafe(F.upper(b))


def interface_targets(calls: DataFrame, impl_methods: DataFrame, registrations: DataFrame | None) -> DataFrame:
    """Calls of interface methods with what may run: (calls' columns, method_id, display_name, resolution, certainty).

    If the interface has any registration, only registered implementations count, even if none is left; one candidate is
    Inferred, several are Ambiguous, none gives no row.
    """
    own = calls.where("target_is_interface and target_in_source").withColumn("call_no", F.monotonically_increasing_id())
    impl = impl_methods.groupBy(F.upper("interface_method_id").alias("k"), F.upper("method_id").alias("m")).agg(*(F.min_by(x, "seq").alias(x) for x in ("method_id", "containing_type_id", "display_name")))
    found = own.join(impl, F.upper("target_id") == c("k")).drop("k", "m")
    if registrations is None:
        kept = found.withColumn("resolution", F.lit("interface-implementation"))
    else:
        known = registrations.select(F.upper("interface_id").alias("i")).distinct().withColumn("registered", F.lit(True))
        pairs = registrations.select(F.upper("interface_id").alias("i2"), F.upper("implementation_id").alias("t2")).distinct().withColumn("chosen", F.lit(True))
        kept = (
            found.join(known, F.upper("target_type_id") == c("i"), "left")
            .join(pairs, (F.upper("target_type_id") == c("i2")) & (F.upper("containing_type_id") == c("t2")), "left")
            .where("registered is null or chosen")
            .withColumn("resolution", F.when(c("registered"), "service-registration").otherwise("interface-implementation"))
            .drop("i", "registered", "i2", "t2", "chosen")
        )
    several = F.count("*").over(W.partitionBy("call_no"))
    return kept.withColumn("certainty", F.when(several == 1, INFERRED).otherwise(AMBIGUOUS)).drop("call_no")


def registration_pairs(calls: DataFrame) -> DataFrame:
    """(seq, interface_id, implementation_id, method_name) of registration calls with `type_args` and `arg_types`: two type
    arguments name interface and implementation, one names both, else the first two argument types do."""
    t, a = c("type_args"), c("arg_types")
    first = F.when(F.size(t) >= 1, F.get(t, 0)).when(F.size(a) >= 2, F.get(a, 0))
    second = F.when(F.size(t) == 2, F.get(t, 1)).when(F.size(t) == 1, F.get(t, 0)).when(F.size(a) >= 2, F.get(a, 1))
    return calls.where(c("target_name").isin(*REGISTRATIONS)).select("seq", first.alias("interface_id"), second.alias("implementation_id"), c("target_name").alias("method_name")).where("interface_id is not null and implementation_id is not null")


def dispatches(f: Facts) -> list[Rows]:
    """Messages sent through a mediator: caller to request type, and request type to handlers."""
    if "dispatches" not in f:
        return []
    d = resolved_dispatches(f["dispatches"], f["handlers"]) if "handlers" in f else resolved_dispatches(f["dispatches"], f["dispatches"].where("false").selectExpr("request_type_id", "caller_id as method_id", "kind as handler_kind", "caller_id as handler_name"))
    at = {"location": _own(d, "location"), "repository": c("repository_name"), "project": c("project_name")}
    meta = {"framework": F.lit("MediatR"), "dispatchKind": c("kind"), "requestType": c("request_name")}
    one = d.dropDuplicates(["dispatch_no"])
    handled = d.where("method_id is not null")
    return [
        _nodes(one, c("request_type_id"), "Implementation", c("short_name"), metadata={"fullName": c("request_name")}, **at),
        _edges(one, c("caller_id"), c("request_type_id"), "DISPATCHES", _text(c("caller_name"), " dispatches ", c("short_name")), c("dispatch_certainty"), metadata=meta | {"mediatorMethod": c("mediator_method"), "resolution": F.when(c("dispatch_certainty") == UNRESOLVED, "no-handler-found").otherwise("request-handler")}, **at),
        _edges(handled, c("request_type_id"), c("method_id"), "HANDLED_BY", _text(c("short_name"), " handled by ", c("handler_name")), c("handler_certainty"), metadata=meta | {"resolution": F.lit("request-handler")}, **at),
    ]


def request_type(static: Column, cast: Column, initial: Column, abstract: Column) -> Column:
    """The first of the static, the cast and the initialiser's type that is a concrete type (not in the array `abstract`)."""
    good = lambda t: F.when(~F.coalesce(F.array_contains(abstract, t), F.lit(False)), t)
    return F.coalesce(good(static), good(cast), good(initial))


def resolved_dispatches(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """Each dispatch with its handlers: adds dispatch_no, method_id, handler_name, dispatch_certainty, handler_certainty.

    kind `send`: one handler is Inferred, several are Ambiguous, none makes the dispatch Unresolved. kind `publish`: always Exact.
    """
    own = calls.withColumn("dispatch_no", F.monotonically_increasing_id())
    h = handlers.select("request_type_id", c("handler_kind").alias("kind"), "method_id", "handler_name").distinct()
    found = own.join(h, ["request_type_id", "kind"], "left")
    n = F.count("method_id").over(W.partitionBy("dispatch_no"))
    return found.withColumn("n", n).withColumn("dispatch_certainty", F.when((c("kind") == "send") & (c("n") == 0), UNRESOLVED).otherwise(EXACT)).withColumn("handler_certainty", F.when(c("kind") == "publish", EXACT).when(c("n") == 1, INFERRED).otherwise(AMBIGUOUS)).drop("n")


def endpoints(f: Facts) -> list[Rows]:
    """Controller actions and mapped routes as endpoints, with who exposes and what they invoke."""
    out: list[Rows] = []
    if "routes" in f:
        d = f["routes"].withColumn("verb", R.verb(c("verb_attribute"), R.ATTRIBUTE_VERBS) if "verb_attribute" in f["routes"].columns else c("verb")).where("verb is not null")
        d = d.withColumn("route", R.normalize_route(c("class_route"), c("method_route"), c("controller_name"), c("action_name"))).withColumn("shown", F.concat_ws(" ", "verb", "route"))
        own = graph_id("endpoint", c("project_name"), c("verb"), c("route"), c("method_id"))
        at = {"location": _own(d, "location"), "repository": c("repository_name"), "project": c("project_name")}
        out += [
            _nodes(d, own, "Endpoint", c("shown"), metadata={"verb": c("verb"), "route": c("route")}, **at),
            _edges(d, c("controller_id"), own, "EXPOSES", _text(c("controller_name"), " exposes ", c("shown")), **at),
            _edges(d, own, c("method_id"), "CALLS", _text(c("shown"), " invokes ", c("controller_name"), ".", c("action_name")), **at),
        ]
    if "mapped_routes" in f:
        d = f["mapped_routes"].withColumn("verb", R.verb(c("map_name"), R.MAP_VERBS)).where("verb is not null and arguments >= 2")
        d = d.withColumn("route", F.coalesce("pattern", F.lit("/unknown"))).withColumn("shown", F.concat_ws(" ", "verb", "route"))
        known = c("handler_kind").isin("method", "lambda")
        own = F.when(known, graph_id("endpoint", c("project_name"), c("verb"), c("route"), c("handler_id"))).otherwise(graph_id("endpoint", c("project_name"), c("verb"), c("route"), c("location.file_path"), c("offset").cast("string")))
        at = {"location": c("location"), "repository": c("repository_name"), "project": c("project_name")}
        d = d.withColumn("own_id", own)
        lam = d.where("handler_kind = 'lambda'")
        out += [
            _nodes(d.where(known), c("own_id"), "Endpoint", c("shown"), metadata={"verb": c("verb"), "route": c("route")}, **at),
            _nodes(d.where(~F.coalesce(known, F.lit(False))), c("own_id"), "Endpoint", c("shown"), AMBIGUOUS, **at),
            _nodes(lam, c("handler_id"), "Method", _text("lambda ", c("shown")), INFERRED, **at),
            _edges(d.where(known), c("own_id"), c("handler_id"), "CALLS", _text(c("shown"), " invokes handler"), F.when(c("handler_kind") == "lambda", INFERRED).otherwise(EXACT), **at),
        ]
        if "nested_calls" in d.columns:
            n = lam.withColumn("n", F.explode("nested_calls"))
            out.append(_edges(n, c("handler_id"), c("n.target_id"), "CALLS", _text("lambda ", c("shown"), " calls ", c("n.target_name")), INFERRED, **at))
    return out


def base_urls(clients: DataFrame, config: DataFrame) -> DataFrame:
    """(client_no, base_url): for clients (client_no, hint, repository_path) the first absolute address among settings.

    Tiers: of the client's own repository a key with `url` that names the hint in key or value; then any key with `url`;
    then of the workspace a key that names the hint; then any value. Within a tier the earliest setting counts. A text holds
    a hint if the hint is among the text's parts of that length, so every tier is an equi-join or one row, and no client
    meets settings that do not name it.
    """
    good = config.withColumn("url", absolute_url(c("value"))).where("url is not null").select("seq", F.upper("key").alias("k"), F.upper("value").alias("v"), "url", _present(F.upper("repository_path")).alias("repo"))
    own = clients.select("client_no", F.upper("hint").alias("h"), _present(F.upper("repository_path")).alias("repo"))
    asked = own.where("h is not null").select("repo", "h").distinct()
    lengths = F.broadcast(asked.agg(F.collect_set(F.length("h")).alias("lengths")))  # one row; as many lengths as there are at most characters in a name

    def parts(*texts: Column) -> Column:
        """The parts of the texts that are as long as any hint."""
        cut = lambda t: F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length(t)), lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))))
        return F.array_distinct(F.concat(*(F.coalesce(cut(t), F.array().cast("array<string>")) for t in texts)))

    urls = good.where(F.contains(c("k"), F.lit("URL")))
    first = urls.groupBy("repo").agg(F.min_by("url", "seq").alias("near"))
    naming = urls.join(lengths).select("repo", F.explode(parts(c("k"), c("v"))).alias("h"), "url", "seq").join(asked, ["repo", "h"], "left_semi")
    nearest = naming.groupBy("repo", "h").agg(F.min_by("url", "seq").alias("nearest"))
    keys = good.groupBy("k").agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq")).join(lengths).select(F.explode(parts(c("k"))).alias("h"), "url", "seq")
    named = keys.join(asked.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min_by("url", "seq").alias("named"))
    anyone = good.agg(F.min_by("url", "seq").alias("any"))
    found = own.join(nearest, ["repo", "h"], "left").join(first, "repo", "left").join(named, "h", "left").join(F.broadcast(anyone))
    return found.select("client_no", F.coalesce("nearest", "near", "named", "any").alias("base_url"))


def _present(text: Column) -> Column:
    """A text that equals another exactly if both are null or both are equal, and never is null."""
    return F.coalesce(F.concat(F.lit("+"), text), F.lit("-"))


def described_clients(calls: DataFrame, clients: DataFrame) -> DataFrame:
    """HTTP calls with their client: adds client_name and client_certainty.

    A local variable made by a factory is Inferred and one made by `new` is Ambiguous; else a receiver typed HttpClient is
    known by its text (Inferred); else the containing type stands in (Ambiguous). Calls whose verb is not known are left out.
    """
    made = clients.groupBy(c("method_id").alias("caller_id"), c("variable").alias("receiver")).agg(F.max_by("client_name", "seq").alias("made_name"), F.max_by("creation_kind", "seq").alias("creation_kind"))
    d = calls.withColumn("verb", R.verb(c("target_name"), R.CLIENT_VERBS, exact_case=True)).where(c("verb").isNotNull() & F.contains("target_type_name", F.lit("HttpClient")))
    d = d.join(made, ["caller_id", "receiver"], "left")
    typed = c("receiver_type") == "HttpClient"
    name = F.when(c("creation_kind").isNotNull(), F.coalesce("made_name", "receiver")).when(typed, c("receiver")).otherwise(c("caller_type_name"))
    sure = F.when(c("creation_kind") == "factory", INFERRED).when(c("creation_kind").isNotNull(), AMBIGUOUS).when(typed, INFERRED).otherwise(AMBIGUOUS)
    return d.withColumn("client_name", name).withColumn("client_certainty", sure)


def http_calls(f: Facts) -> list[Rows]:
    """Clients, the services and endpoints they call, and the endpoints of this workspace that these resolve to."""
    if "http_requests" not in f:
        return []
    d = f["http_requests"]  # described calls with request_path and base_url
    d = d.withColumn("request_path", F.when(c("verb") != "SEND", c("request_path"))).withColumn("uri", combine_uri(c("base_url"), c("request_path")))
    d = d.withColumn("service", F.coalesce(host(c("uri")), "client_name")).withColumn("target", F.coalesce(F.regexp_extract(c("uri"), r"^[^:]+://[^/?#]*(.*)$", 1), "request_path", F.lit("/unknown")))
    client, service = graph_id("http-client", c("project_name"), c("client_name")), graph_id("external-service", F.coalesce("service", "project_name"))
    outer = graph_id("external-endpoint", c("verb"), F.coalesce("uri", "request_path", "client_name"))
    d = d.withColumn("client_id", client).withColumn("service_id", service).withColumn("outer_id", outer).withColumn("call_no", F.monotonically_increasing_id())
    d = written(d)  # the numbers are used in several plans
    at = {"location": _own(d, "location"), "repository": c("repository_name"), "project": c("project_name")}
    by_uri, by_path = F.when(c("uri").isNull(), AMBIGUOUS).otherwise(INFERRED), F.when(c("request_path").isNull(), UNRESOLVED).otherwise(INFERRED)
    out = [
        _nodes(d, c("client_id"), "HttpClient", c("client_name"), c("client_certainty"), metadata={"name": c("client_name"), "baseUrl": c("base_url")}, **at),
        _nodes(d, c("service_id"), "ExternalService", F.coalesce("service", F.lit("external-service")), by_uri, metadata={"host": host(c("uri"))}, **at),
        _nodes(d, c("outer_id"), "ExternalEndpoint", F.concat_ws(" ", "verb", "target"), by_path, metadata={"verb": c("verb"), "path": c("request_path"), "absoluteUri": c("uri")}, **at),
        _edges(d, c("caller_id"), c("client_id"), "USES_HTTP_CLIENT", _text(c("caller_name"), " uses ", c("client_name")), c("client_certainty"), **at),
        _edges(d, c("client_id"), c("service_id"), "CALLS_HTTP", _text(c("client_name"), " targets ", c("service")), by_uri, **at),
        _edges(d, c("service_id"), c("outer_id"), "CALLS_HTTP", _text(c("service"), " serves ", F.concat_ws(" ", "verb", "target")), by_path, **at),
    ]
    if "endpoints" in f:
        r = internal_targets(d.withColumn("path", F.coalesce(url_path(c("uri")), "request_path")).withColumn("host", host(c("uri"))), f["endpoints"])
        out.append(_edges(r, c("outer_id"), c("endpoint_id"), F.when(c("certainty") == AMBIGUOUS, "AMBIGUOUS").otherwise("RESOLVES_TO_SERVICE"), _text(c("client_name"), " resolves to ", c("endpoint_name")), c("certainty"), **at))
        out.append(_edges(r.where(crosses(c("repository_name"), c("endpoint_repo"))), c("outer_id"), c("endpoint_id"), "CROSSES_REPO_BOUNDARY", _text(c("project_name"), " calls across repo into ", c("endpoint_repo")), c("certainty"), **at))
    return out


def _prefixes(text: Column) -> Column:
    """All leading parts of a text, itself included."""
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.substring(text, F.lit(1), i))


def _repositories_in(calls: DataFrame, routes: DataFrame, strict: bool) -> DataFrame:
    """(call_no, r_repo): repositories of routes that fit a call by its host or base address: the host itself, or named in
    either. A missing repository fits any address, unless `strict`. Each distinct address is searched once, by its parts as
    long as a repository's name."""
    names = routes.select(F.upper("endpoint_repo").alias("name")).where("name is not null").distinct()
    lengths = F.broadcast(names.agg(F.collect_set(F.length("name")).alias("lengths")))  # one row
    own = calls.select("call_no", F.explode(F.array_distinct(F.array_compact(F.array(F.upper("host"), F.upper("base_url"))))).alias("address"))
    t = c("address")
    cut = F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length(t)), lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))))
    held = own.select("address").distinct().join(lengths).select("address", F.explode(F.array_distinct(cut)).alias("name")).join(names, "name")
    found = own.join(held, "address").select("call_no", _present(c("name")).alias("r_repo"))
    nameless = calls.where(c("host").isNull() if strict else c("host").isNull() | c("host").isNotNull() | c("base_url").isNotNull()).select("call_no", F.lit("-").alias("r_repo"))
    return found.unionByName(nameless).distinct()


def _alike(calls: DataFrame, routes: DataFrame, strict: bool = False) -> DataFrame:
    """(call_no, endpoint_id, matched, head): pairs whose route matches the path, or whose first segments are equal and
    whose repository fits the call's host or base address.

    Each way to be alike is an equi-join of its own: one text among the leading parts of the other; segment count and
    first segment (`*` for a parameter); first segment and fitting repository.
    """
    p = calls.select("call_no", F.upper("path").alias("p"), c("path"))
    r = routes.select("endpoint_id", F.upper("route").alias("r"), c("route"))
    first = lambda x: F.get(segments(x), 0)
    starts = p.select("call_no", F.explode(_prefixes(c("p"))).alias("r")).join(r, "r")
    started = r.select("endpoint_id", F.explode(_prefixes(c("r"))).alias("p")).join(p, "p")
    count = lambda x: F.size(segments(x))
    parameter = F.when(F.startswith(first(c("r")), F.lit("{")), "*").otherwise(F.coalesce(first(c("r")), F.lit("")))
    a = p.select("call_no", "path", count(c("p")).alias("n"), F.explode(F.array_distinct(F.array(F.coalesce(first(c("p")), F.lit("")), F.lit("*")))).alias("k"))
    segment = a.join(r.select("endpoint_id", "route", count(c("r")).alias("n"), parameter.alias("k")), ["n", "k"]).where(R.route_matches(c("path"), c("route")))
    fits = _repositories_in(calls, routes, strict)
    a = p.select("call_no", _present(first(c("p"))).alias("a")).join(fits, "call_no")
    head = a.join(routes.select("endpoint_id", _present(first(F.upper("route"))).alias("a"), _present(F.upper("endpoint_repo")).alias("r_repo")), ["a", "r_repo"])
    one = lambda d, m: d.select("call_no", "endpoint_id", F.lit(m).alias("matched"), F.lit(not m).alias("head"))
    every = one(starts, True).unionByName(one(started, True)).unionByName(one(segment, True)).unionByName(one(head, False))
    return every.groupBy("call_no", "endpoint_id").agg(F.bool_or("matched").alias("matched"), F.bool_or("head").alias("head"))


def internal_targets(calls: DataFrame, endpoints_: DataFrame, strict: bool = False) -> DataFrame:
    """HTTP calls (call_no, path, host, client_name, base_url, ...) with the endpoints they may mean.

    Adds endpoint_id, endpoint_name, endpoint_repo and certainty: Inferred for one candidate, Ambiguous for several. Tiers,
    of which the first with a candidate counts: the route matches (segment by segment, or one text starts the other) and
    host or base address and names contain each other; the first segments are equal and the repository fits; the
    repository is the host. A missing name is contained in any text, unless `strict`.
    """
    e = endpoints_.select(c("id").alias("endpoint_id"), c("display_name").alias("endpoint_name"), c("repository_name").alias("endpoint_repo"), c("project_name").alias("endpoint_project"), F.try_element_at("metadata", F.lit("route")).alias("route"))
    own = calls.where(~blank(c("path"))).select("call_no", "path", "host", "client_name", "base_url")

    def held(whole: Column, part: Column) -> Column:
        return F.coalesce(F.contains(F.upper(whole), F.upper(part if strict else F.coalesce(part, F.lit("")))), F.lit(False))

    pairs = _alike(own, e.where(~blank(c("route"))), strict).join(own, "call_no").join(e, "endpoint_id")
    by_host = held(c("host"), c("endpoint_project")) | held(c("host"), c("endpoint_repo"))
    by_name = held(c("endpoint_project"), c("client_name")) | held(c("endpoint_repo"), c("client_name")) | held(c("base_url"), c("endpoint_project")) | held(c("base_url"), c("endpoint_repo"))
    by_repo = F.upper("endpoint_repo").eqNullSafe(F.upper("host")) | held(c("host"), c("endpoint_repo")) | held(c("base_url"), c("endpoint_repo"))
    tier = F.when(c("matched") & F.when(c("host").isNull(), by_name).otherwise(by_host), 1).when(c("head") & by_repo, 2)
    columns = ["call_no", "endpoint_id", "endpoint_name", "endpoint_repo"]
    near = pairs.withColumn("tier", tier).where("tier is not null").select(*columns, "tier")
    far = own.where("host is not null").join(e, F.upper("endpoint_repo") == F.upper("host")).select(*columns, F.lit(3).alias("tier"))
    best = near.unionByName(far).withColumn("best", F.min("tier").over(W.partitionBy("call_no"))).where("tier = best")
    several = F.count("*").over(W.partitionBy("call_no"))
    return calls.join(best.select(*columns, F.when(several == 1, INFERRED).otherwise(AMBIGUOUS).alias("certainty")), "call_no")


def data_access(f: Facts) -> list[Rows]:
    """Contexts, entities, the tables they map to, who uses them, and tables named in SQL text."""
    out: list[Rows] = []
    owner = F.coalesce("repository_name", "project_name")
    here = {"repository": c("repository_name"), "project": c("project_name")}
    if "entity_mappings" in f:
        d = entity_tables(f["entity_mappings"])
        table = graph_id("table", owner, c("table_name"))
        out += [
            _nodes(d, c("entity_id"), "Entity", c("entity_name"), c("certainty"), metadata={"fullName": _own(d, "full_name")}, **here),
            _nodes(d, table, "Table", c("table_name"), c("certainty"), metadata={"table": c("table_name")}, **here),
            _edges(d, c("entity_id"), table, "MAPS_TO_TABLE", _text(c("entity_name"), " maps to ", c("table_name")), c("certainty"), **here),
        ]
        if "context_name" in d.columns:
            out.append(_nodes(d.where("context_id is not null"), c("context_id"), "DbContext", c("context_name"), **here))
    if "entity_uses" in f:
        u = f["entity_uses"]
        out.append(_edges(u.where("context_id is not null"), c("method_id"), c("context_id"), "USES_DBCONTEXT", _text(c("method_name"), " uses ", c("context_name")), **here))
        e = u.where("entity_id is not null")
        out.append(_edges(e, c("method_id"), c("entity_id"), "QUERIES_ENTITY", _text(c("method_name"), " queries ", c("entity_name")), **here))
        if "entity_mappings" in f:
            # A use sees only the explicit mappings met before it in its project; of several the latest holds.
            m = entity_tables(f["entity_mappings"]).where("explicit").select(c("project_name").alias("p"), c("entity_id").alias("e"), "table_name", c("seq").alias("m_seq"))
            seen = e.join(m, c("project_name").eqNullSafe(c("p")) & (c("entity_id") == c("e")) & (c("m_seq") < c("seq")))
            seen = seen.groupBy("seq", "method_id", "method_name", "repository_name", "project_name").agg(F.max_by("table_name", "m_seq").alias("table_name"))
            out.append(_edges(seen, c("method_id"), graph_id("table", owner, c("table_name")), "DEPENDS_ON", _text(c("method_name"), " touches ", c("table_name")), INFERRED, **here))
    if "sql_texts" in f:
        d = f["sql_texts"].where(~blank(c("sql"))).withColumn("table_name", F.explode(named_tables(c("sql"))))
        table = graph_id("table", owner, c("table_name"))
        out += [
            _nodes(d, table, "Table", c("table_name"), AMBIGUOUS, metadata={"table": c("table_name")}, **here),
            _edges(d, c("method_id"), table, "DEPENDS_ON", _text(c("method_name"), " references ", c("table_name"), " in SQL"), AMBIGUOUS, **here),
        ]
    return out


def entity_tables(mappings: DataFrame) -> DataFrame:
    """Adds table_name, certainty and explicit: the mapped name, else the attribute's, else the entity's own.

    Only a name given by `to_table` is Exact. Sets of a context (is_set) see the mappings met before in their project.
    """
    to, attribute = F.nullif(c("to_table"), F.lit("")), F.nullif(c("attribute_table"), F.lit(""))
    return mappings.withColumn("table_name", F.coalesce(to, attribute, "entity_name")).withColumn("certainty", F.when(to.isNotNull(), EXACT).otherwise(INFERRED)).withColumn("explicit", to.isNotNull() | attribute.isNotNull())


#: The contributors in the order in which their rows arrive.
CONTRIBUTORS: list[tuple[str, Callable[[Facts], list[Rows]]]] = [("topology", topology), ("project", project_graph), ("endpoints", endpoints), ("http", http_calls), ("data", data_access)]


def contribute(f: Facts, contributors=CONTRIBUTORS) -> tuple[DataFrame, DataFrame]:
    """(node rows, edge rows) of all contributors; seq is (contributor, output, fact row), which sorts by these in turn.

    The endpoints that HTTP calls may resolve to are those that the contributors before found, all of them.
    """
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []
    for stage, (name, run) in enumerate(contributors):
        if name == "http" and "endpoints" not in f and nodes:
            # Written, so that what follows does not carry the plans of all contributors before it.
            nodes = [written(_union(nodes))]
            f = f | {"endpoints": written(merge_nodes(nodes[0]).where("type = 'Endpoint'"))}
        for part, rows in enumerate(run(f)):
            placed = rows.df.withColumn("seq", F.struct(F.lit(stage).alias("stage"), F.lit(part).alias("part"), c("seq").cast("long").alias("fact")))
            (nodes if rows.kind == "node" else edges).append(placed)

    return _union(nodes), _union(edges)


def _union(dfs: list[DataFrame]) -> DataFrame | None:
    out = None
    for d in dfs:
        out = d if out is None else out.unionByName(d)
    return out


def build(f: Facts, contributors=CONTRIBUTORS) -> Graph:
    """The whole graph of the facts: merged nodes and edges with doc_pos, and the warnings."""
    nodes, edges = map(written, contribute(f, contributors))
    return Graph(build_order(merge_nodes(nodes), NODE_TYPES), build_order(merge_edges(edges, make_ids=True), EDGE_TYPES), f.get("warnings"))
