import pytest

from graphloom import api
from tests_graph import EDGE, NODE


def state(spark):
    from graphloom.operators.merge import Graph

    nodes = spark.createDataFrame([(x, "Method", x.upper(), None, None, None, 3, {}, n) for n, x in enumerate("abc")], NODE)
    edges = spark.createDataFrame([("e1", "a", "b", "CALLS", "a calls b", None, None, None, 3, {}, 0), ("e2", "b", "c", "CALLS", "b calls c", None, None, None, 1, {}, 1)], EDGE)
    return api.State(Graph(nodes, edges))


def test_texts(spark):
    s = state(spark)
    assert api.impact_text(s, "A") == ["Focus: A (Method)", "Nodes: 3", "Edges: 2", "CALLS: a calls b", "CALLS: b calls c"]
    assert api.impact_text(s, "c", "upstream")[1] == "Nodes: 3"
    assert api.paths_text(s, "a", "b") == ["Paths: 1", "A -> B"]
    assert api.paths_text(s, "a", "c") == ["Paths: 0"]  # ambiguous edges are left out of paths
    assert api.review_text(s, 1) == ["unresolved: 0", "ambiguous: 1", "  CALLS: 1", "  b calls c"]
    assert api.summary_text(s)[3] == "Methods: 3" and api.summary(s)["warningCount"] == 0


def test_nothing_loaded_and_unknown_node(spark):
    with pytest.raises(api.NotLoaded):
        api.impact(api.State(), "a")
    with pytest.raises(LookupError):
        api.impact(state(spark), "zzz")


def test_folder_scan(spark, tmp_path):
    for p, text in (("r/.git/HEAD", "x"), ("r/A.sln", "x"), ("r/p/P.csproj", "x"), ("r/p/appsettings.json", '{"a": {"b": 1}}')):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    s = api.scan_folder(spark, str(tmp_path))
    assert {r.type: r.n for r in s.need().nodes.groupBy("type").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {"Workspace": 1, "Repository": 1, "Solution": 1, "Project": 1, "ConfigurationKey": 1}
    assert [t["stage"] for t in s.metadata["timings"]] == ["build", "write"]
