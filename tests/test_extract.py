from graphloom.operators import extract
from graphloom.operators.merge import statistics


def facts(spark):
    def t(rows, schema):
        return spark.createDataFrame(rows, schema)

    here = ("repo-orders", "Api")
    return {
        "workspace": t([("/w", 0)], "root_path string, seq long"),
        "repositories": t([("repo-orders", "/w/repo-orders", 1), ("repo-catalog", "/w/repo-catalog", 2)], "name string, root_path string, seq long"),
        "projects": t([("Api", "/w/repo-orders/Api.csproj", "/w/repo-orders/O.sln", "repo-orders", "/w/repo-orders", 1), ("Cat", "/w/repo-catalog/Cat.csproj", None, "repo-catalog", "/w/repo-catalog", 2)], "name string, full_path string, solution_path string, repository_name string, repository_path string, seq long"),
        "project_refs": t([("/w/repo-orders/Api.csproj", "/w/repo-catalog/Cat.csproj", 1), ("/w/repo-orders/Api.csproj", "/w/none.csproj", 2)], "project_path string, referenced_path string, seq long"),
        "calls": t([(1, "method:c", "method:i", "type:i", "Ctl.Get", "Load", "IRepo", True, True, *here), (2, "method:c", "method:j", "type:j", "Ctl.Get", "Go", "IOther", True, True, *here), (3, "method:c", "method:x", "type:x", "Ctl.Get", "Ext", "X", False, False, *here)], "seq long, caller_id string, target_id string, target_type_id string, caller_name string, target_name string, target_type_name string, target_in_source boolean, target_is_interface boolean, repository_name string, project_name string"),
        "impl_methods": t([(1, "method:i", "method:a", "type:a", "A.Load"), (2, "method:i", "method:b", "type:b", "B.Load"), (3, "method:j", "method:m", "type:m", "M.Go"), (4, "method:j", "method:n", "type:n", "N.Go")], "seq long, interface_method_id string, method_id string, containing_type_id string, display_name string"),
        "registrations": t([(1, "TYPE:I", "type:A", "AddScoped")], "seq long, interface_id string, implementation_id string, method_name string"),
        "dispatches": t([(1, "method:c", "type:q1", "send", "Ctl.Get", "Q1", "Q1", "Send", *here), (2, "method:c", "type:q2", "send", "Ctl.Get", "Q2", "Q2", "Send", *here), (3, "method:c", "type:q3", "send", "Ctl.Get", "Q3", "Q3", "Send", *here), (4, "method:c", "type:n", "publish", "Ctl.Get", "N", "N", "Publish", *here)], "seq long, caller_id string, request_type_id string, kind string, caller_name string, request_name string, short_name string, mediator_method string, repository_name string, project_name string"),
        "handlers": t([("type:q1", "method:h1", "send", "H1"), ("type:q2", "method:h2", "send", "H2"), ("type:q2", "method:h3", "send", "H3"), ("type:n", "method:h4", "publish", "H4"), ("type:n", "method:h5", "publish", "H5")], "request_type_id string, method_id string, handler_kind string, handler_name string"),
        "routes": t([(1, "OrdersController", "Get", "api/[controller]", "{id}", "HttpGetAttribute", "method:c", "type:ctl", *here), (2, "OrdersController", "Odd", "api/[controller]", None, "Nothing", "method:o", "type:ctl", *here)], "seq long, controller_name string, action_name string, class_route string, method_route string, verb_attribute string, method_id string, controller_id string, repository_name string, project_name string"),
        "mapped_routes": t([(1, "MapGet", 2, "/products/{id}", "method", "method:p", 5, ("f.cs", 1, 1), "repo-catalog", "Cat")], "seq long, map_name string, arguments int, pattern string, handler_kind string, handler_id string, offset long, location struct<file_path:string,line:int,column:int>, repository_name string, project_name string"),
        "http_requests": t([(1, "method:a", "A.Load", "CatalogClient", 2, "GET", "/products/{value}", "http://repo-catalog", *here)], "seq long, caller_id string, caller_name string, client_name string, client_certainty int, verb string, request_path string, base_url string, repository_name string, project_name string"),
        "entity_mappings": t([(1, "type:ctx", "Ctx", "type:e", "Order", None, None, *here)], "seq long, context_id string, context_name string, entity_id string, entity_name string, attribute_table string, to_table string, repository_name string, project_name string"),
        "entity_uses": t([(2, "method:a", "Load", "type:ctx", "Ctx", "type:e", "Order", *here)], "seq long, method_id string, method_name string, context_id string, context_name string, entity_id string, entity_name string, repository_name string, project_name string"),
        "sql_texts": t([(1, "method:a", "Load", "select * from [dbo].Orders o JOIN lines l", *here), (2, "method:a", "Load", " ", *here)], "seq long, method_id string, method_name string, sql string, repository_name string, project_name string"),
    }


def test_whole_graph(spark):
    g = extract.build(facts(spark))
    nodes = {r.id: r for r in g.nodes.collect()}
    edges = {(r.source_id, r.target_id, r.type): r for r in g.edges.collect()}
    name = lambda n: next(i for i, r in nodes.items() if r.display_name == n)
    assert {r.display_name for r in nodes.values() if r.type == "Endpoint"} == {"GET /api/Orders/{id}", "GET /products/{id}"}
    # one registered implementation; several without registration
    assert edges["method:c", "method:a", "CALLS"].certainty == 2 and ("method:c", "method:b", "CALLS") not in edges
    assert edges["method:c", "method:a", "CALLS"].metadata["resolution"] == "service-registration"
    assert edges["method:c", "method:m", "AMBIGUOUS"].certainty == edges["method:c", "method:n", "AMBIGUOUS"].certainty == 1
    assert ("method:c", "method:x", "CALLS") not in edges
    # dispatch
    assert edges["method:c", "type:q1", "DISPATCHES"].certainty == 3 and edges["type:q1", "method:h1", "HANDLED_BY"].certainty == 2
    assert edges["type:q2", "method:h2", "HANDLED_BY"].certainty == edges["type:q2", "method:h3", "HANDLED_BY"].certainty == 1
    assert edges["method:c", "type:q3", "DISPATCHES"].certainty == 0 and edges["method:c", "type:q3", "DISPATCHES"].metadata["resolution"] == "no-handler-found"
    assert edges["type:n", "method:h4", "HANDLED_BY"].certainty == 3
    # http across repositories
    outer = name("GET /products/{value}")
    inner = name("GET /products/{id}")
    assert edges[outer, inner, "RESOLVES_TO_SERVICE"].certainty == 2 and (outer, inner, "CROSSES_REPO_BOUNDARY") in edges
    assert edges[name("CatalogClient"), name("repo-catalog") if nodes[name("repo-catalog")].type == "ExternalService" else next(i for i, r in nodes.items() if r.type == "ExternalService"), "CALLS_HTTP"].certainty == 2
    # data
    assert (name("Order"), next(i for i, r in nodes.items() if r.type == "Table" and r.display_name == "Order"), "MAPS_TO_TABLE") in edges
    assert {r.display_name for r in nodes.values() if r.type == "Table"} == {"Order", "[dbo].Orders", "lines"}
    assert ("method:a", "type:ctx", "USES_DBCONTEXT") in edges and ("method:a", "type:e", "QUERIES_ENTITY") in edges
    s = statistics(g).first()
    assert (s.repository_count, s.project_count, s.endpoint_count, s.http_edge_count) == (2, 2, 2, 3)
    assert sorted(r.doc_pos for r in g.nodes.collect()) == list(range(len(nodes)))


def test_registrations_and_request_types(spark):
    from pyspark.sql import functions as F

    calls = spark.createDataFrame([(1, "AddScoped", ["I", "A"], []), (2, "AddSingleton", ["B"], []), (3, "AddTransient", [], ["I2", "C"]), (4, "AddScoped", [], ["I3"]), (5, "Other", ["I", "A"], [])], "seq long, target_name string, type_args array<string>, arg_types array<string>")
    assert [(r.seq, r.interface_id, r.implementation_id) for r in extract.registration_pairs(calls).orderBy("seq").collect()] == [(1, "I", "A"), (2, "B", "B"), (3, "I2", "C")]
    d = spark.createDataFrame([("I", "A", None), ("A", "B", None), (None, None, "Z"), ("I", None, None)], "s string, c string, i string")
    got = d.select(extract.request_type(F.col("s"), F.col("c"), F.col("i"), F.array(F.lit("I"))).alias("t")).collect()
    assert [r.t for r in got] == ["A", "A", "Z", None]
