import json
import random
import time

from graphloom.streaming import watch


def fold(times, delay):
    out, end = [], None
    for t in sorted(times):
        if end is None or t >= end:
            out.append([t, 0])
            end = t + delay
        out[-1][1] += 1
    return [(n, t, c) for n, (t, c) in enumerate(out)]


def test_batches_like_a_fold(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["u", "v", None]), i, rng.choice([None, rng.randrange(5000)])) for i in range(400)]
    got = watch.batches(spark.createDataFrame(rows, "user_id string, event_id long, at_us long"), "user_id", 300).collect()
    for k in ("u", "v"):
        assert sorted((r.batch_no, r.opened_us, r.events) for r in got if r.user_id == k) == fold([t for u, _, t in rows if u == k and t is not None], 300)
    assert {r.user_id for r in got} == {"u", "v"}


def test_relevance_and_digest(spark):
    from pyspark.sql import functions as F

    rows = [("Changed", "/w/a.cs", None), ("Renamed", "/w/b.cs", "/w/old.cs"), ("Changed", "/w/bin.txt", None), ("Created", "/w/.graphignore", None), ("Changed", "/w/skip/c.cs", None), ("Deleted", "/v/a.cs", None)]
    df = spark.createDataFrame(rows, "kind string, path string, old_path string")
    assert {r.reason for r in watch.relevant(df, "/w", ["skip"]).collect()} == {"Changed: a.cs", "Renamed: b.cs", "Renamed: old.cs", "Created: .graphignore"}
    d = spark.createDataFrame([(["a", "A", "b", "c", "d", "e", "f", "g"],), (["x"],), ([],)], "r array<string>")
    assert [r.d for r in d.select(watch.digest(F.col("r")).alias("d")).collect()] == ["a, b, c, d, e, +2 more", "x", ""]


def test_stream_closes_a_batch_after_its_delay(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("workspace string, reason string").json(str(source))
    calls, lines = [], []
    query = watch.watch(watch.batched_stream(stream, 1000), lambda: calls.append(1), lines.append, str(tmp_path / "check"))
    try:
        (source / "1.json").write_text("\n".join(json.dumps({"workspace": "w", "reason": r}) for r in ("Changed: a", "changed: A", "Changed: b")))
        for _ in range(120):
            if lines:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert lines == ["Rescanning because: Changed: a, Changed: b"] and len(calls) == 2
