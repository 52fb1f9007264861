import random
from datetime import datetime

import pytest

from graphloom.operators import snapshots

SCHEMA = "snapshot_no int, taken_at timestamp_ntz, id string, certainty tinyint, display_name string, metadata map<string,string>, doc_pos long, loaded_at timestamp_ntz, row_id string, digest long"
T = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(s, T, i, c, n, m, p, T, x, 5) for p, (s, i, c, n, m, x) in enumerate(rows)], SCHEMA)


def run(spark, rows):
    got = [tuple(r) for r in snapshots.snapshot_changes({"node": frame(spark, rows)}).collect()]
    assert len(got) == len(set(got))
    return {r[1:] for r in got}


def brute(rows):
    by = {}
    for s, i, c, n, m, x in rows:
        if s is not None and i and i.strip():
            by.setdefault(s, {})[i.strip().lower()] = (c, n.strip().lower() if n is not None else None, None if m is None else tuple(sorted(m.items())), x)
    out = set()
    order = sorted(by)
    for a, b in zip(order, order[1:]):
        for i in by[a].keys() | by[b].keys():
            if i not in by[a]:
                out.add((i, b, "added"))
            elif i not in by[b]:
                out.add((i, b, "removed"))
            elif by[a][i] != by[b][i]:
                out.add((i, b, "changed"))
    return out


@pytest.mark.parametrize("block", [40, 200_000])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(snapshots, "BLOCK_ROWS", block)
    rng = random.Random(1)
    rows, state = [], {f"id{i}": 0 for i in range(300)}
    for s in (1, 2, 5, 9):
        for i in rng.sample(sorted(state), 8):
            state[i] += 1
        for i in rng.sample(sorted(state), 5):
            del state[i]
        for _ in range(6):
            state[f"new{rng.randrange(10**6)}"] = 0
        for i, v in state.items():
            rows.append((s, rng.choice([i, i.upper(), f" {i}"]), v % 4, rng.choice(["Name", "name "]), {"a": "1", "b": None}, "x"))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_nulls_maps_repeats_and_extra_columns(spark):
    base = [(1, "a", 3, None, None, "x"), (1, "b", None, "n", {}, "x"), (1, "c", 1, "n", {"k": "1", "l": "2"}, "x"), (1, "c", 1, "n", {"l": "2", "k": "1"}, "x"), (1, "d", 1, "n", {"k": None}, "x"), (1, None, 1, "n", None, "x"), (None, "z", 1, "n", None, "x"), (1, "e", 1, "n", None, "x"), (1, "f", 1, "null", None, None)]
    later = [(4, "A ", 3, "", None, "x"), (4, "b", 0, "n", {}, "x"), (4, "c", 1, "N", {"l": "2", "k": "1"}, "x"), (4, "d", 1, "n", {}, "x"), (4, "e", 1, "n", None, "other"), (4, "f", 1, "null", None, None)]
    assert run(spark, base + later) == {("a", 4, "changed"), ("b", 4, "changed"), ("d", 4, "changed"), ("e", 4, "changed")}


def test_one_snapshot_and_none(spark):
    assert run(spark, [(1, "a", 1, "n", None, "x")]) == set()
    assert run(spark, []) == set()
