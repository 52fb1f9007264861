import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators import orphans

T0 = datetime(2025, 1, 1)
EDGE = "id string, source_id string, target_id string, scanned_at timestamp_ntz, node_id string, at long, pid int, reason string"
NODE = "id string, scanned_at timestamp_ntz, removed_at timestamp_ntz, row_kind int, best_end long"


def at(n):
    return None if n is None else T0 + timedelta(hours=n)


def expected(edges, nodes, shared=()):
    rows = [(i.strip().lower(), s, e if e is not None else 10**9) for i, s, e in nodes if i and s is not None] + [(i.strip().lower(), s, 10**9) for i, s in shared]
    out = set()
    for i, a, b, t in edges:
        if not i or t is None:
            continue
        for end, x in (("source", a), ("target", b)):
            x = x.strip().lower() if x else None
            if not x:
                continue
            own = [(s, e) for n, s, e in rows if n == x]
            if any(s <= t < e for s, e in own):
                continue
            reason = "missing" if not own else "late" if all(s > t for s, _ in own) else "deleted"
            out.add((i.strip().lower(), end, x, reason, at(t).strftime("%Y-%m")))
    return out


def run(spark, edges, nodes, shared=()):
    e = spark.createDataFrame([(i, a, b, at(t), "x", 1, 2, "y") for i, a, b, t in edges], EDGE)
    n = spark.createDataFrame([(i, at(s), at(x), 0, 0) for i, s, x in nodes], NODE)
    s = spark.createDataFrame([(i, at(x)) for i, x in shared], "id string, scanned_at timestamp_ntz")
    got = [tuple(r) for r in orphans.orphan_edges(e, n, s).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_reasons_nulls_and_spelling(spark):
    edges = [("e1", "A ", "b", 5), ("e1", " a", "B", 5), ("e2", None, "c", 5), ("e3", "d", "", 5), ("e4", "a", "b", None), (None, "a", "zz", 5), ("e5", "a", "gone", 9), ("E6", "back", "late", 3)]
    nodes = [("a", 0, None), ("B", 6, None), ("gone", 0, 9), ("back", 0, 2), ("back", 5, None), ("late", 4, 5), (None, 0, None), ("d", None, None), ("never", 5, 5)]
    assert run(spark, edges, nodes) == expected(edges, nodes) == {
        ("e1", "target", "b", "late", "2025-01"), ("e2", "target", "c", "missing", "2025-01"), ("e3", "source", "d", "missing", "2025-01"),
        ("e5", "target", "gone", "deleted", "2025-01"), ("e6", "source", "back", "deleted", "2025-01"), ("e6", "target", "late", "late", "2025-01"),
    }


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_like_brute_force_with_a_hot_key(spark, hot):
    rng = random.Random(7)
    key = lambda: "hot" if rng.random() < hot else f"n{rng.randrange(40)}"
    edges = [(f"e{i}", key(), key(), rng.randrange(3000)) for i in range(600)]
    nodes = [(key(), s := rng.randrange(3000), rng.choice([None, s + rng.randrange(400)])) for _ in range(60)]
    nodes += [("hot", s, s + 3) for s in range(0, 1500, 9)]
    shared = [("n3", 100)]
    assert run(spark, edges, nodes, shared) == expected(edges, nodes, shared)


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [("a", 0, None)]) == set()
    assert run(spark, [("e", "a", "b", 1)], []) == {("e", "source", "a", "missing", "2025-01"), ("e", "target", "b", "missing", "2025-01")}


def test_states_carry_over_partitions_of_one_key():
    from types import SimpleNamespace as S

    states = [S(pid=0, node_id="a", best_end=5, known=True, alone=False), S(pid=1, node_id="a", best_end=3, known=False, alone=True), S(pid=2, node_id="b", best_end=1, known=True, alone=False), S(pid=3, node_id="c", best_end=1, known=True, alone=True)]
    assert orphans._carried(states) == [(1, "a", 5, True), (2, "a", 5, True), (3, "b", 1, True)]
