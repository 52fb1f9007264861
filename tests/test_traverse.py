import random
from collections import deque

import pytest

from graphloom.operators import traverse, views
from graphloom.operators.merge import Graph, dangling

NODE = "id string, type string, display_name string, repository_name string, project_name string, certainty int, metadata map<string,string>, doc_pos long"
EDGE = "id string, source_id string, target_id string, type string, display_name string, certainty int, doc_pos long"


def graph(spark, edges, names=None):
    ids = sorted({x for _, a, b, _ in edges for x in (a, b) if x} | set(names or {}))
    nodes = spark.createDataFrame([(i, "Method", (names or {}).get(i, i), "r", "p", 3, {}, n) for n, i in enumerate(ids)], NODE)
    return Graph(nodes, spark.createDataFrame([(e, a, b, "CALLS", e, c, n) for n, (e, a, b, c) in enumerate(edges)], EDGE))


def random_edges(seed, nodes=12, count=30):
    rng = random.Random(seed)
    return [(f"e{i}", f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.randrange(4)) for i in range(count)]


def keep(c, exact, ambiguous):
    return c == 3 if exact else ambiguous or c not in (0, 1)


@pytest.mark.parametrize("upstream,depth,exact,ambiguous", [(False, 3, False, True), (True, 6, False, False), (False, 6, True, True), (False, 0, False, True)])
def test_impact_like_breadth_first(spark, upstream, depth, exact, ambiguous):
    edges = random_edges(4)
    nodes, walked = traverse.impact(graph(spark, edges), "n1", upstream, depth, exact, ambiguous)
    use = [(e, b, a) if upstream else (e, a, b) for e, a, b, c in edges if keep(c, exact, ambiguous)]
    seen, todo = {"n1": 0}, deque(["n1"])
    while todo:
        at = todo.popleft()
        for _, a, b in use:
            if a == at and b not in seen and seen[at] < depth:
                seen[b] = seen[at] + 1
                todo.append(b)
    assert {r.id: r.depth for r in nodes.collect()} == seen
    assert {r.id for r in walked.collect()} == {e for e, a, _ in use if seen.get(a, depth) < depth}


@pytest.mark.parametrize("depth,ambiguous", [(4, True), (8, False)])
def test_paths_like_depth_first(spark, depth, ambiguous):
    edges = random_edges(9, 9, 24) + [("twin", "n0", "n1", 3), ("twin2", "n0", "n1", 3), ("null", "n0", None, 3)]
    want = set()

    def go(at, nodes, used):
        if at == "n3":
            want.add(tuple(used))
            return
        if len(used) < depth:
            for e, a, b, c in edges:
                if a == at and b and b not in nodes and keep(c, False, ambiguous):
                    go(b, nodes | {b}, [*used, e])

    go("n0", {"n0"}, [])
    got = [tuple(r.edge_ids) for r in traverse.paths(graph(spark, edges), "n0", "n3", depth, include_ambiguous=ambiguous).collect()]
    assert set(got) == want and len(got) == len(want)


def test_path_to_itself_and_without_way(spark):
    g = graph(spark, [("e", "a", "b", 3)])
    assert [tuple(map(tuple, (r.node_ids, r.edge_ids))) for r in traverse.paths(g, "a", "a").collect()] == [(("a",), ())]
    assert traverse.paths(g, "b", "a").count() == 0


def test_resolve_tiers(spark):
    g = graph(spark, [("e", "x1", "x2", 3)], {"x1": "orders", "x2": "Orders api", "x3": "x1"})
    assert traverse.resolve(g.nodes, "X1").id == "x1"
    assert traverse.resolve(g.nodes, "ORDERS").id == "x1"
    assert traverse.resolve(g.nodes, "rs AP").id == "x2"
    assert traverse.resolve(g.nodes, "").id == "x1"
    with pytest.raises(LookupError):
        traverse.resolve(g.nodes, "nowhere")


def test_dangling_and_views(spark):
    g = graph(spark, [("e1", "a", "b", 3), ("e2", "b", "a", 1)])
    g.edges = g.edges.unionByName(spark.createDataFrame([("e3", "a", "gone", "CALLS", "x", 0, 9), ("e4", None, "b", "CALLS", "x", 3, 10)], EDGE))
    assert [tuple(r) for r in dangling(g).collect()] == [("e3", "target", "gone")]
    v = views.view(g, "ambiguity-audit")
    assert {r.id for r in v.edges.collect()} == {"e2", "e3"} and {r.id for r in v.nodes.collect()} == {"a", "b"}
    assert views.view(g, "no such view") is g
    w = views.working_graph(g, search="A", include_ambiguous=False)
    assert {r.id for r in w.nodes.collect()} == {"a"} and w.edges.count() == 0
    assert {(r.id, r.depth) for r in views.depth_by_focus(g, "b").collect()} == {("a", 1), ("b", 0)}
    grid = {r.id: (r.x, r.y) for r in views.grid_layout(g.nodes).collect()}
    assert grid == {"a": (120.0, 100.0), "b": (380.0, 100.0)}
