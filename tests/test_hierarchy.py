import random

from graphloom.operators import hierarchy as h


def frame(spark, rows):
    return spark.createDataFrame([(p, c, t, "x", 1) for p, c, t in rows], "source_id string, target_id string, type string, node_id string, depth int")


def brute(pairs):
    parent = {}
    for p, c in pairs:
        if c:
            parent[c] = min((x for x in (parent.get(c), p) if x), default=None)
        if p:
            parent.setdefault(p, None)
    out = {}
    for n in parent:
        seen, at = [n], parent[n]
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is None:
            out[n] = (seen[-1], len(seen) - 1, "none")
        else:
            out[n] = ("", -1, "on" if at == n else "below")
    return parent, out


def check(spark, pairs, types=None):
    rows = [(p, c, "Contains " if i % 2 else "DEFINES") for i, (p, c) in enumerate(pairs)]
    tree = h.links(frame(spark, rows))
    got = {r.node_id: r for r in h.hierarchy(tree).collect()}
    parent, want = brute(pairs)
    assert {n: (r.root_id, r.depth, r.loop_state) for n, r in got.items()} == want
    good = {n for n, w in want.items() if w[2] == "none"}
    above = {n: [] for n in good}
    for n in good:
        at = parent[n]
        while at is not None:
            above[n].append(at)
            at = parent[at]
    for a in good:
        below = {n for n in good if a in above[n]}
        r = got[a]
        assert r.size == len(below) + 1 and r.last == r.pre + len(below)
        assert {n for n in good if got[n].root_id == r.root_id and r.pre < got[n].pre <= r.last} == below
    paths = {r.node_id: r.path for r in h.node_paths(tree).collect()}
    assert paths == {n: "/".join([*reversed(above[n]), n]) for n in good}
    return tree, got, above


def test_random_forest_with_loops(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None, f"n{i}") for i in range(120)]
    pairs += [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("s", "s"), ("s", "t")]
    tree, got, above = check(spark, pairs)
    nodes = h.hierarchy(tree)
    asked = nodes.where("node_id in ('n0', 'n1', 'a')")
    found = {(r.ancestor_id, r.node_id, r.levels) for r in h.descendants(nodes, asked).collect()}
    assert found == {(a, n, above[n].index(a) + 1) for n in above for a in above[n] if a in ("n0", "n1")}
    every = [tuple(r) for r in h.descendants(nodes).collect()]
    assert sorted(every) == sorted((a, n, i + 1) for n in above for i, a in enumerate(above[n]))


def test_deep_chain_and_broad_parent(spark):
    check(spark, [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)])
    check(spark, [("root", f"k{i}") for i in range(150)])


def test_pointers_that_are_not_broadcast(spark, monkeypatch):
    """Beyond the broadcast bound pointers are joined, shared ones apart; the result is the same."""
    from graphloom import session

    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    check(spark, [(f"n{rng.randrange(max(1, i // 3))}", f"n{i}") for i in range(1, 60)] + [("a", "b"), ("b", "a"), ("b", "q")])


def test_only_loops_two_parents_repeats_and_null_ends(spark):
    check(spark, [("x", "y"), ("y", "x")])
    check(spark, [("p2", "c"), ("p1", "c"), ("p1", "c"), (None, "lone"), ("top", None), (None, None)])


def test_ids_compare_without_case_and_other_types_are_left_out(spark):
    rows = [(" A", "b ", "contains"), ("a", "B", "CONTAINS"), ("a", "z", "CALLS"), ("q", "  ", "defines"), ("a", "n", None)]
    assert {(r.node_id, r.parent_id) for r in h.links(frame(spark, rows)).collect()} == {("a", None), ("b", "a"), ("q", None)}


def test_empty(spark):
    tree = h.links(frame(spark, []))
    assert h.hierarchy(tree).count() == 0 and h.node_paths(tree).count() == 0
