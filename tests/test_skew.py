import random
from collections import Counter
from datetime import datetime, timedelta

from graphloom.operators import skew

T0 = datetime(2025, 1, 1)
SCHEMA = "k string, p long, t timestamp_ntz, part_no int, key_value string, chunk_no long, tie int"


def table(spark, rows, parts=5):
    """(key, place, time) rows, laid into partitions in any order."""
    return spark.createDataFrame([(k, p, None if t is None else T0 + timedelta(microseconds=t), 1, "x", 2, 3) for k, p, t in rows], SCHEMA).repartition(parts)


def profile(df, chunk=None):
    return skew.key_profile([(df, "k", "p", "t", "f")], chunk)


def expected(rows):
    by = {}
    for k, p, t in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or 0))):
        if k and k.strip():
            by.setdefault(k.strip().lower(), []).append(t)
    out = {}
    for k, ts in by.items():
        steps = [b - a for a, b in zip(ts, ts[1:]) if a is not None and b is not None]
        out[k] = (len(ts), ts[0], ts[-1], sum(s < 0 for s in steps), max(steps, default=None))
    return out


def found(df, chunk=None):
    zero = int((T0 - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    back = lambda t: None if t is None else t - zero
    return {r.key_value: (r.key_rows, back(r.first_at), back(r.last_at), r.steps_back, r.widest_step) for r in profile(df, chunk).collect()}


def test_profile_like_brute_force(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["b", "C ", "c", None, " ", "d"]), n, rng.randrange(1000)) for n in range(500)]
    for chunk in (1, 7, 1000):
        assert found(table(spark, rows), chunk) == expected(rows)
    got = {r.key_value: r for r in profile(table(spark, rows), 7).collect()}
    assert all(r.chunks == -(-r.key_rows // 7) and abs(r.share - r.key_rows / 500) < 1e-12 for r in got.values())


def test_order_is_the_delivered_one_whatever_the_files(spark, tmp_path):
    """Spark reads large files first; the early rows lie in a small one."""
    early, late = [("a", n, n) for n in range(10)], [("a", n, n) for n in range(10, 4010)]
    for name, rows in (("1", early), ("2", late)):
        table(spark, rows, 1).write.parquet(str(tmp_path / "t" / name))
    df = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "t"))
    for chunk in (100, 100_000):
        assert found(df, chunk) == {"a": (4010, 0, 4009, 0, 1)}


def test_null_and_equal_places(spark):
    rows = [("a", None, t) for t in (5, 3, None)] + [("a", 1, 9)] * 20 + [("a", 1, None), ("b", None, None)]
    for chunk in (1, 4, 100):
        assert found(table(spark, rows), chunk) == expected(rows)


def test_chunks_are_whole_and_full(spark):
    df = table(spark, [("a", i, i) for i in range(100)] + [("b", 1, 1)]).select("k", "p")
    sizes = Counter((r.k, r.chunk_no) for r in skew.chunked(df, ["k"], ["p"], 30).collect())
    assert sizes == {("a", 0): 30, ("a", 1): 30, ("a", 2): 30, ("a", 3): 10, ("b", 0): 1}


def test_hot_keys_and_empty(spark):
    rows = [("Hot ", 1, None)] * 6 + [("hot", 1, 1)] * 3 + [(None, 1, 1)] * 190 + [(f"k{i}", 1, 1) for i in range(101)]
    both = skew.key_profile([(table(spark, rows), "k", "p", "t", "f"), (table(spark, []), "k", "p", "t", "none")])
    assert [tuple(r) for r in skew.hot_keys(both).collect()] == [("f", "hot")]  # 9 of 300 is 3 %
    assert profile(table(spark, [])).count() == 0
