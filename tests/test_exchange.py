import json

from pyspark.sql import functions as F

from graphloom.functions import paths as P
from graphloom.operators.merge import Graph
from graphloom.sources import discovery, exchange

PLACE = "struct<file_path:string,line:int,column:int>"
NODE = f"id string, type string, display_name string, source_location {PLACE}, repository_name string, project_name string, certainty tinyint, metadata map<string,string>, doc_pos long"
EDGE = NODE.replace("id string, ", "id string, source_id string, target_id string, ", 1)


def graph(spark):
    n = [("a", "Method", 'say "hi", ok', ("f.cs", 3, None), None, "p", 3, {"k": None, "l": "v"}, 0), ("b", "Table", None, None, "r", None, 0, {}, 1)]
    return Graph(spark.createDataFrame(n, NODE), spark.createDataFrame([("e", "a", "b", "CALLS", "x", None, None, None, 1, {}, 0)], EDGE))


def test_document_round_trip(spark, tmp_path):
    g = graph(spark)
    exchange.write_document(g, str(tmp_path / "out" / "graph.json"))
    raw = json.loads((tmp_path / "out" / "graph.json").read_text())
    assert list(raw["nodes"][0]) == ["id", "type", "displayName", "sourceLocation", "projectName", "certainty", "metadata"]
    assert raw["nodes"][0]["metadata"] == {"k": None, "l": "v"} and raw["nodes"][1]["certainty"] == "Unresolved"
    assert raw["statistics"]["methodCount"] == 1
    back = exchange.read_document(spark, str(tmp_path / "out" / "graph.json"))
    assert back.nodes.orderBy("id").collect() == g.nodes.orderBy("id").collect()
    assert back.edges.collect() == g.edges.collect()


def test_certainties_in_any_spelling_and_several_documents(spark, tmp_path):
    element = lambda i, c: {"id": i, "type": "Method", "certainty": c}
    (tmp_path / "1.json").write_text(json.dumps({"nodes": [element("a", "exact"), element("b", 2)], "edges": [], "warnings": [{"code": "x", "message": "m", "certainty": "Ambiguous"}]}))
    (tmp_path / "2.json").write_text(json.dumps({"nodes": [element("c", "Sure"), element("d", None)], "edges": None}))
    g = exchange.read_document(spark, str(tmp_path / "*.json"))
    assert [(r.id, r.certainty, r.doc_pos) for r in g.nodes.orderBy("doc_pos").collect()] == [("a", 3, 0), ("b", 2, 1), ("c", 0, 2), ("d", 0, 3)]
    assert sorted((r.code, r.message, r.certainty) for r in g.warnings.collect()) == [("unknown-certainty", "nodes c: Sure", None), ("x", "m", 1)]


def test_folder_and_warnings_round_trip(spark, tmp_path):
    import pytest

    from graphloom import api

    g = graph(spark)
    g.warnings = spark.createDataFrame([("w1", "lost", None, 0, {"k": "v"}), ("w2", "sure", "p", 3, None)], exchange.WARNINGS)
    exchange.write_json(g, str(tmp_path / "f"))
    exchange.write_document(g, str(tmp_path / "g.json"))
    raw = json.loads((tmp_path / "g.json").read_text())
    assert [w["code"] for w in raw["warnings"]] == ["w1", "w2"] and [w["code"] for w in raw["unresolved"]] == ["w1"]
    for path in ("f", "g.json"):
        back = api.load(spark, str(tmp_path / path)).need()
        assert back.nodes.orderBy("doc_pos").collect() == g.nodes.orderBy("doc_pos").collect() and back.edges.collect() == g.edges.collect()
        assert back.warnings.orderBy("code").collect() == g.warnings.orderBy("code").collect()
    (tmp_path / "empty.json").write_text("{}")
    with pytest.raises(ValueError):
        exchange.read_document(spark, str(tmp_path / "empty.json"))


def test_order_is_that_of_paths(spark):
    paths = [f"/w/r{i % 7}/p{i:03}/P.csproj" for i in range(200)] + [f"/w/r{i}/.git" for i in range(7)]
    files = [(p, False, None) for p in reversed(paths)] + [("/w/r3/appsettings.json", False, '{"b": 1, "a": [2, 3], "c": {"z": 4, "y": 5}}'), ("/w/r1/AppSettings.json", False, '{"k": 0}')]
    t = discovery.discover(spark.createDataFrame(files, "path string, is_dir boolean, content string"), "/w")
    assert [r.full_path for r in t["projects"].orderBy("seq").collect()] == sorted(p for p in paths if p.endswith("proj"))
    assert [r.name for r in t["repositories"].orderBy("seq").collect()] == [f"r{i}" for i in range(7)]
    assert [r.key for r in t["config_values"].orderBy("seq").collect()] == ["k", "b", "a[0]", "a[1]", "c:z", "c:y"]
    assert max(r.seq for r in t["projects"].collect()) < 300


def test_markers_and_unreadable_folders(spark):
    files = [("/w/a/.hg", True, None, None), ("/w/a/P.csproj", False, None, None), ("/w/b", True, None, "Permission denied")]
    t = discovery.discover(spark.createDataFrame(files, "path string, is_dir boolean, content string, error string"), "/w", markers=(".hg",))
    assert [r.name for r in t["repositories"].collect()] == ["a"] and [(r.code, r.path) for r in t["warnings"].collect()] == [("directory-scan-failed", "/w/b")]


def test_ignore_files(spark, tmp_path):
    import pytest

    (tmp_path / discovery.IGNORE_FILE).write_text("# built\n tools \n\nplatform/core\n")
    (tmp_path / "more").write_text("samples\nTOOLS\n")
    assert discovery.excluded_paths(spark, str(tmp_path), [str(tmp_path / "more"), " "], ["own"]) == ["own", "platform/core", "samples", "tools"]
    with pytest.raises(FileNotFoundError):
        discovery.excluded_paths(spark, str(tmp_path), [str(tmp_path / "none")])


def test_csv_quotes_everything(spark, tmp_path):
    g = graph(spark)
    assert [r.line for r in exchange.csv_lines(g.nodes, exchange.NODE_COLUMNS).orderBy("doc_pos").collect()] == ['"a","Method","say ""hi"", ok","","p","Exact"', '"b","Table","","r","","Unresolved"']
    exchange.write_csv_pair(g, str(tmp_path))
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/nodes.csv").orderBy("id").collect()
    assert [r.displayName for r in back] == ['say "hi", ok', None] and back[0].certainty == "Exact"
    exchange.write_json(g, str(tmp_path / "j"))
    assert spark.read.json(f"{tmp_path}/j/nodes").count() == 2


def test_views_answer_sql(spark):
    exchange.register(graph(spark))
    assert spark.sql("select count(*) n from graph_edges e join graph_nodes n on n.id = e.source_id").first().n == 1


def test_exclusions(spark):
    rows = [("/w/a/x.cs", ["a"], True), ("/w/ab/x.cs", ["a"], False), ("/w/s/lib/a/x.cs", ["lib\\a"], True), ("/w/z/x.cs", ["/W/Z"], True), ("/w/z/x.cs", ["/w/zz", " ", "#"], False), ("/home/w/x.cs", ["w"], True), ("/w/b", [], False), (None, ["a"], False)]
    df = spark.createDataFrame(rows, "p string, pats array<string>, want boolean")
    for r in df.withColumn("got", P.excluded(F.col("p"), F.lit("/w"), F.col("pats"))).collect():
        assert r.got == r.want, r


def test_discovery_of_nothing_and_owner_by_longest_root(spark):
    t = discovery.discover(spark.createDataFrame([], "path string, is_dir boolean, content string"), "/w")
    assert [r.code for r in t["warnings"].collect()] == ["root-not-found"] and t["projects"].count() == 0
    items = spark.createDataFrame([("/w/a/b/p.csproj",), ("/W/A/q.csproj",), ("/w/ab/r.csproj",)], "path string")
    repos = spark.createDataFrame([("/w/a", "outer"), ("/w/a/b", "inner")], "root_path string, name string")
    assert {r.path: r.repository_name for r in discovery.owners(items, repos).collect()} == {"/w/a/b/p.csproj": "inner", "/W/A/q.csproj": "outer", "/w/ab/r.csproj": None}
    assert discovery.combined(["B", " a "], None, ["b", "c"]) == ["a", "B", "c"]


def test_project_list_last_solution_wins(spark):
    s = spark.createDataFrame([(1, "/x/P.csproj", "S1"), (2, "/X/p.csproj", "S2")], "seq long, full_path string, solution string")
    loose = spark.createDataFrame([(5, "/x/P.csproj"), (6, "/y/Q.csproj")], "seq long, full_path string")
    assert {(r.full_path, r.solution) for r in discovery.project_list(s, loose).collect()} == {("/X/p.csproj", "S2"), ("/y/Q.csproj", None)}
