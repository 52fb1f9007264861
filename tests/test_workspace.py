"""Two repositories as facts: an API that dispatches messages, reads a table and calls the other repository over HTTP."""

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.operators import extract, merge, traverse

HERE, THERE = ("repo-orders", "Orders.Api"), ("repo-catalog", "Catalog.Api")
IN = "repository_name string, project_name string"
ACTIONS = [("List", None), ("Get", "{id}"), ("Query", "query/{id}"), ("Local", "local/{id}"), ("Generic", "generic/{id}"), ("Many", "many"), ("None", "none"), ("LookAlike", "look")]


def facts(spark):
    def t(rows, schema):
        return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "seq long, " + schema)

    project = lambda name, repo, solution: (name, f"/w/{repo}/{name}/{name}.csproj", solution, repo, f"/w/{repo}")
    projects = [project(f"Orders.{x}", "repo-orders", "/w/repo-orders/Orders.sln") for x in ("Framework", "Core", "Data", "Api")] + [project("Catalog.Api", "repo-catalog", None)]
    refs = [("Orders.Api", "Orders.Core"), ("Orders.Api", "Orders.Data"), ("Orders.Core", "Orders.Framework")]
    path = {p[0]: p[1] for p in projects}
    iface, impl = "method:I{0}", "method:{0}"
    return {
        "workspace": spark.createDataFrame([("/w", 0)], "root_path string, seq long"),
        "repositories": t([("repo-orders", "/w/repo-orders"), ("repo-catalog", "/w/repo-catalog")], "name string, root_path string"),
        "solutions": t([("Orders", "/w/repo-orders/Orders.sln", "repo-orders", "/w/repo-orders")], "name string, full_path string, repository_name string, repository_path string"),
        "projects": t(projects, "name string, full_path string, solution_path string, repository_name string, repository_path string"),
        "project_refs": t([(path[a], path[b]) for a, b in refs], "project_path string, referenced_path string"),
        "config_values": t([("CatalogClient:BaseUrl", "http://repo-catalog", "/w/repo-orders/Orders.Api/appsettings.json", "repo-orders", "/w/repo-orders")], "key string, value string, file_path string, repository_name string, repository_path string"),
        "types": t(
            [("type:OrdersController", "OrdersController", "class", [extract.CONTROLLER_BASE], path["Orders.Api"], *HERE), ("type:OrdersService", "OrdersService", "class", [], path["Orders.Core"], *HERE), ("type:OrdersContext", "OrdersContext", "class", [extract.CONTEXT_BASE], path["Orders.Data"], *HERE), ("type:IOrdersService", "IOrdersService", "interface", [], path["Orders.Core"], *HERE), ("type:Order", "Order", "class", [], path["Orders.Data"], *HERE)],
            f"type_id string, name string, kind string, bases array<string>, project_path string, {IN}",
        ).withColumn("full_name", F.col("name")).withColumn("namespace", F.lit("Orders")),
        "type_interfaces": t([("type:OrdersService", "type:IOrdersService", "OrdersService", "IOrdersService", True, *HERE)], f"type_id string, interface_id string, type_name string, interface_name string, is_direct boolean, {IN}"),
        "injections": t([("type:OrdersController", "type:IOrdersService", "interface", "OrdersController", "IOrdersService", True, True, *HERE), ("type:OrdersController", "type:Hidden", "class", "OrdersController", "Hidden", False, True, *HERE)], f"type_id string, parameter_type_id string, parameter_kind string, type_name string, parameter_name string, ctor_public boolean, in_source boolean, {IN}"),
        "methods": t([(f"method:{a}", "type:OrdersController", f"OrdersController.{a}", a, "OrdersController", "Task", *HERE) for a, _ in ACTIONS], f"method_id string, type_id string, display_name string, name string, type_name string, returns string, {IN}"),
        "calls": t(
            [("method:Get", iface.format("Load"), "type:IOrdersService", "OrdersController.Get", "Load", "IOrdersService", True, True, *HERE), (impl.format("Load"), iface.format("Find"), "type:IOrderRepository", "OrdersService.Load", "Find", "IOrderRepository", True, True, *HERE), (impl.format("Load"), iface.format("Fetch"), "type:ICatalogGateway", "OrdersService.Load", "Fetch", "ICatalogGateway", True, True, *HERE)],
            f"caller_id string, target_id string, target_type_id string, caller_name string, target_name string, target_type_name string, target_in_source boolean, target_is_interface boolean, {IN}",
        ),
        "impl_methods": t([(iface.format(m), impl.format(m), f"type:{c}", f"{c}.{m}") for m, c in (("Load", "OrdersService"), ("Find", "OrderRepository"), ("Fetch", "CatalogGateway"))], "interface_method_id string, method_id string, containing_type_id string, display_name string"),
        "registrations": t([("type:IOrdersService", "type:OrdersService", "AddScoped"), ("type:IOrderRepository", "type:OrderRepository", "AddScoped"), ("type:ICatalogGateway", "type:CatalogGateway", "AddScoped")], "interface_id string, implementation_id string, method_name string"),
        "dispatches": t([(f"method:{a}", f"type:{q}", kind, f"OrdersController.{a}", f"Orders.Core.{q}", q, "Send" if kind == "send" else "Publish", *HERE) for a, q, kind in (("Query", "GetOrderQuery", "send"), ("Local", "GetOrderQuery", "send"), ("Generic", "GetOrderQuery", "send"), ("Many", "ManyQuery", "send"), ("None", "LostQuery", "send"), ("List", "OrderSeen", "publish"))], f"caller_id string, request_type_id string, kind string, caller_name string, request_name string, short_name string, mediator_method string, {IN}"),
        "handlers": spark.createDataFrame([("type:GetOrderQuery", "method:H1", "send", "H1"), ("type:ManyQuery", "method:H2", "send", "H2"), ("type:ManyQuery", "method:H3", "send", "H3"), ("type:OrderSeen", "method:H4", "publish", "H4"), ("type:OrderSeen", "method:H5", "publish", "H5")], "request_type_id string, method_id string, handler_kind string, handler_name string"),
        "routes": t([("OrdersController", a, "api/[controller]", r, "HttpPost" if a == "None" else "HttpGet", f"method:{a}", "type:OrdersController", *HERE) for a, r in ACTIONS], f"controller_name string, action_name string, class_route string, method_route string, verb_attribute string, method_id string, controller_id string, {IN}"),
        "mapped_routes": t([("MapGet", 2, "/products/{id}", "method", "method:GetProduct", 7, ("CatalogApi.cs", 20, 1), *THERE)], f"map_name string, arguments int, pattern string, handler_kind string, handler_id string, offset long, location {extract.LOCATION}, {IN}"),
        "http_requests": t([(impl.format("Fetch"), "CatalogGateway.Fetch", "CatalogClient", 2, "GET", "/products/{value}", "http://repo-catalog", *HERE)], f"caller_id string, caller_name string, client_name string, client_certainty int, verb string, request_path string, base_url string, {IN}"),
        "entity_mappings": t([("type:OrdersContext", "OrdersContext", "type:Order", "Order", None, None, *HERE)], f"context_id string, context_name string, entity_id string, entity_name string, attribute_table string, to_table string, {IN}"),
        "entity_uses": t([(impl.format("Find"), "OrderRepository.Find", "type:OrdersContext", "OrdersContext", "type:Order", "Order", *HERE)], f"method_id string, method_name string, context_id string, context_name string, entity_id string, entity_name string, {IN}"),
        "warnings": spark.createDataFrame([("load-failed", "x", 0), ("note", "y", 3)], "code string, message string, certainty tinyint"),
    }


@pytest.fixture(scope="module")
def state(spark):
    return api.scan(spark, facts(spark))


def test_counts(state):
    s = merge.statistics(state.need()).first()
    assert (s.repository_count, s.solution_count, s.project_count, s.endpoint_count, s.table_count) == (2, 1, 5, 9, 1)
    assert (s.http_edge_count, s.cross_repo_link_count, s.ambiguous_edge_count) == (3, 1, 3)
    assert merge.dangling(state.need()).count() == len({"H1", "H2", "H3", "H4", "H5", "GetProduct"})  # handlers whose methods no fact names
    assert api.summary(state)["warningCount"] == 2 and [r.code for r in traverse.review(state.need())["symbols"].collect()] == ["load-failed"]


def test_edges(state):
    """Ids come out in lower case."""
    g = state.need()
    names = {r.id: r for r in g.nodes.collect()}
    edges = [(r.type, r.certainty, r.source_id, r.target_id, r.display_name, r.metadata) for r in g.edges.collect()]
    of = lambda kind, source: sorted((t, c) for k, c, s, t, _, _ in edges if k == kind and s == source)
    assert of("DISPATCHES", "method:query") == of("DISPATCHES", "method:local") == of("DISPATCHES", "method:generic") == [("type:getorderquery", 3)]
    assert of("HANDLED_BY", "type:getorderquery") == [("method:h1", 2)]
    assert of("HANDLED_BY", "type:manyquery") == [("method:h2", 1), ("method:h3", 1)] and of("HANDLED_BY", "type:orderseen") == [("method:h4", 3), ("method:h5", 3)]
    assert of("DISPATCHES", "method:none") == [("type:lostquery", 0)] and of("DISPATCHES", "method:lookalike") == []
    assert next(m["resolution"] for k, _, _, t, _, m in edges if k == "DISPATCHES" and t == "type:lostquery") == "no-handler-found"
    assert of("CALLS", "method:get") == [("method:iload", 3), ("method:load", 2)] and any("resolves" in d for k, _, s, _, d, _ in edges if s == "method:get")
    assert of("USES_DBCONTEXT", "method:find") == [("type:orderscontext", 3)] and of("QUERIES_ENTITY", "method:find") == [("type:order", 3)]
    assert [(names[t].display_name, names[t].type) for t, _ in of("MAPS_TO_TABLE", "type:order")] == [("Order", "Table")]
    assert {(names[s].display_name, names[t].display_name) for k, _, s, t, _, _ in edges if k == "CROSSES_REPO_BOUNDARY"} == {("GET /products/{value}", "GET /products/{id}")}
    assert {r.type for r in names.values() if r.display_name == "OrdersContext"} == {"DbContext"} and names["type:orderscontroller"].type == "Controller"
    assert "type:hidden" not in names and of("INJECTS", "type:orderscontroller") == [("type:iordersservice", 3)]


def test_blast_radius(state):
    get = "GET /api/Orders/{id}"
    named = lambda *a, **k: {r.display_name: r.depth for r in api.impact(state, *a, **k)[1].collect()}
    down = named(get, depth=12)
    assert down["GET /products/{value}"] == 6 and down["GET /products/{id}"] == 7
    near = named(get)
    assert "GET /products/{value}" in near and "GET /products/{id}" not in near
    table = state.need().nodes.where("type = 'Table'").first().id
    assert "OrderRepository.Find" in named(table, "upstream", depth=12)


def test_an_excluded_repository_is_gone(spark):
    f = facts(spark)
    kept = {k: df.where("repository_name is null or repository_name != 'repo-catalog'") if "repository_name" in df.columns else df.where("name != 'repo-catalog'") if k == "repositories" else df for k, df in f.items()}
    g = extract.build(kept)
    assert {r.display_name for r in g.nodes.where("type = 'Repository'").collect()} == {"repo-orders"}
    assert "GET /products/{id}" not in {r.display_name for r in g.nodes.collect()}
