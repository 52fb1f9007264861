from pyspark.sql import functions as F

from graphloom.functions import jsonflat, routes
from graphloom.operators import extract, reports


def test_routes(spark):
    rows = [("api/[controller]", "{id}", "OrdersController", "Get", "/api/Orders/{id}"), (None, "/[action]/", "X", "Do$1", "/Do$1"), (" ", None, "X", "Y", "/"), ("[CONTROLLER]", "", "MyControllerBase", "a", "/MyBase")]
    df = spark.createDataFrame(rows, "c string, m string, n string, a string, want string")
    for r in df.withColumn("got", routes.normalize_route(F.col("c"), F.col("m"), F.col("n"), F.col("a"))).collect():
        assert r.got == r.want
    rows = [("/a/b", "/a/{x}", True), ("/A/b/", "a/B", True), ("/a", "/a/b", False), ("/", "", True), (None, "/a", False), ("/a/b", "/{x/b", False)]
    for r in spark.createDataFrame(rows, "p string, r string, want boolean").withColumn("got", routes.route_matches(F.col("p"), F.col("r"))).collect():
        assert r.got == r.want, r


def test_addresses(spark):
    rows = [("http://a.b/c/d", "x", "http://a.b/c/x"), ("http://a.b/c/d", "/x?q=1", "http://a.b/x?q=1"), ("http://a.b", "x", "http://a.b/x"), ("nothing", "x", None), (None, "https://z/y", "https://z/y"), ("http://a.b/c", "?q", "http://a.b/c?q"), ("http://a.b", " ", None), ("http://a.b", None, None)]
    for r in spark.createDataFrame(rows, "b string, r string, want string").withColumn("got", routes.combine_uri(F.col("b"), F.col("r"))).collect():
        assert r.got == r.want, r


def test_verbs_and_constant_texts(spark):
    df = spark.createDataFrame([("HttpGetAttribute", "GET"), ("httppost", "POST"), ("Other", None), (None, None)], "n string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", routes.verb(F.col("n"), routes.ATTRIBUTE_VERBS)).collect())
    parts = spark.createDataFrame([([("/a/", None), (None, None)],), ([("/a/", None), (None, "7")],), ([("/a", None)],), ([],)], "p array<struct<text:string,value:string>>")
    got = parts.select(*(routes.constant_text(F.col("p"), m).alias(m) for m in ("strict", "placeholder", "constant"))).collect()
    assert [tuple(r) for r in got] == [(None, "/a/{value}", None), ("/a/7", "/a/7", None), ("/a", "/a", "/a"), ("", "", "")]


def test_clients(spark):
    calls = spark.createDataFrame([(1, "m", "c", "GetAsync", "System.HttpClient", None, "T"), (2, "m", "d", "PostAsync", "HttpClient", "HttpClient", "T"), (3, "m", "e", "SendAsync", "HttpClient", "Other", "T"), (4, "m", "f", "Odd", "HttpClient", None, "T"), (5, "m", "g", "GetAsync", "Else", None, "T"), (6, "n", "c", "PatchAsync", "HttpClient", "HttpClient", "T")], "seq long, caller_id string, receiver string, target_name string, target_type_name string, receiver_type string, caller_type_name string")
    made = spark.createDataFrame([(1, "m", "c", "Catalog", "factory"), (2, "n", "c", None, "new")], "seq long, method_id string, variable string, client_name string, creation_kind string")
    got = {r.seq: (r.verb, r.client_name, r.client_certainty) for r in extract.described_clients(calls, made).collect()}
    assert got == {1: ("GET", "Catalog", 2), 2: ("POST", "d", 2), 3: ("SEND", "T", 1), 6: ("PATCH", "c", 1)}


def test_classification_and_inheritance(spark):
    rows = [("interface", "OrderService", ["x"], "Interface"), ("class", "A", ["A", extract.CONTEXT_BASE], "DbContext"), ("class", "B", [extract.CONTROLLER_BASE], "Controller"), ("class", "XController", [], "Controller"), ("class", "XClient", [], "Service"), ("class", "Thing", None, "Implementation"), ("class", None, None, "Implementation")]
    df = spark.createDataFrame(rows, "k string, n string, b array<string>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", extract.classify(F.col("k"), F.col("n"), F.col("b"))).collect())
    bases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", None), (None, "z")], "type_name string, base_name string")
    got = {(r.type_name, r.base_name): r.depth for r in extract.inherits(bases).collect()}
    assert got["a", "c"] == 2 and got["c", "b"] == 2 and got["x", "y"] == 1 and ("y", "x") not in got


def test_flatten():
    v = jsonflat.parse('{"a": {"b": [1.50, {"c": null}], "e": {}}, "t": true, "s": "x"}')
    assert list(jsonflat.flatten(v)) == [("a:b[0]", "1.50"), ("a:b[1]:c", ""), ("t", "True"), ("s", "x")]
    deep = "[" * 900 + "1" + "]" * 900
    assert list(jsonflat.flatten(jsonflat.parse(deep))) == [("[0]" * 900, "1")]


def test_failures_are_suppressed(spark):
    rows = [(n, "load", f"Failed to load p{n}: same", n, 9) for n in range(6)] + [(10, "scan", "Done", None, None), (11, "scan", None, None, None)]
    df = spark.createDataFrame(rows, "seq long, stage string, message string, current int, total int")
    lines = {r.seq: r.line for r in reports.printed(df).collect()}
    assert set(lines) == {0, 1, 2, 3, 10, 11} and lines[3] == "[load 3/9] Suppressing additional repeated failures for: same" and lines[10] == "[scan] Done"
    assert [tuple(r) for r in reports.failure_summary(df).collect()] == [("same", 3)]
    assert {r.current for r in reports.sampled(df, 4).collect()} == {0, 1, 4}
