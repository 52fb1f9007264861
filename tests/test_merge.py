import random

from pyspark.sql import functions as F

from graphloom.functions import ids
from graphloom.operators import merge

ROW = "id string, type string, display_name string, source_location struct<file_path:string,line:int,column:int>, repository_name string, project_name string, certainty tinyint, metadata map<string,string>, seq long, node_key string, mark long"


def node(seq, id_="n", type_="Method", name="m", place=None, repo=None, project=None, sure=3, meta=None):
    return (id_, type_, name, place, repo, project, sure, meta, seq, "x", 1)


def fold(maps):
    acc = {}
    for m in maps:
        if m is None:
            continue
        if not acc:
            acc = dict(m)
            continue
        low = {k.lower(): k for k in acc}
        for k, v in m.items():
            if not k.strip():
                continue
            old = low.get(k.lower())
            if old is None:
                acc[k] = v
                low[k.lower()] = k
            elif not (acc[old] or "").strip():
                acc[old] = v
            elif (v or "").strip() and acc[old].lower() != v.lower():
                acc[old] = f"{acc[old]} | {v}"
    return acc


def merged(spark, rows):
    return {r.id: r for r in merge.merge_nodes(spark.createDataFrame(rows, ROW)).collect()}


def test_fold_is_ordered_and_repeats(spark):
    r = merged(spark, [node(1, meta={"k": "a"}), node(2, meta={"K": "b"}), node(3, meta={"k": "b"})])["n"]
    assert r.metadata == {"k": "a | b | b"}


def test_fold_like_brute_force(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for n in range(40):
        maps = []
        for s in range(rng.randrange(1, 6)):
            m = rng.choice([None, {}, {rng.choice(["a", "A", "b", " "]): rng.choice(["x", "X", "", None, "y"]) for _ in range(rng.randrange(1, 4))}])
            if m is not None and len({k.lower() for k in m}) < len(m):
                m = {"a": "x"}
            maps.append(m)
            rows.append(node(n * 10 + s, f"n{n}", meta=m))
        want[f"n{n}"] = fold(maps)
    rng.shuffle(rows)
    assert {i: r.metadata for i, r in merged(spark, rows).items()} == want


def test_first_and_most_specific(spark):
    rows = [node(1, " N", "Implementation", " ", None, None, "p1", 0), node(2, "n", " service", "", ("f", 1, 2), "r1", "p2", 2), node(3, "n", "SERVICE", "named", ("g", 1, 2), "r2", None, None), node(4, None), node(5, " ")]
    r = merged(spark, rows)
    assert set(r) == {"n"}
    r = r["n"]
    assert (r.type, r.display_name, r.source_location.file_path, r.repository_name, r.project_name, r.certainty, r.seq) == ("Service", "named", "f", "r1", "p1", 2, 1)
    tie = merged(spark, [node(2, type_="Method", name=None), node(1, type_="method ", name=None)])["n"]
    assert tie.type == "Method" and tie.display_name is None


def test_order_by_upper_case_and_statistics(spark):
    rows = [node(1, "b", "Method", "a_b"), node(2, "a", "Method", "aZb"), node(3, "c", "Workspace", "z"), node(4, "d", "Odd", "a")]
    n = merge.build_order(merge.merge_nodes(spark.createDataFrame(rows, ROW)), ids.NODE_TYPES)
    assert [r.id for r in n.orderBy("doc_pos").collect()] == ["c", "a", "b", "d"]
    assert [r.doc_pos for r in n.orderBy("doc_pos").collect()] == [0, 1, 2, 3]


def test_ids(spark):
    df = spark.createDataFrame([(" a ", None, "", "b")], "a string, b string, c string, d string")
    got = df.select(ids.graph_id("p", *(F.col(c) for c in "abcd")).alias("i")).first().i
    import hashlib

    assert got == "p:" + hashlib.sha256(b"a|b").hexdigest()[:16]


def test_empty(spark):
    n = merge.build_order(merge.merge_nodes(spark.createDataFrame([], ROW)), ids.NODE_TYPES)
    assert n.count() == 0
