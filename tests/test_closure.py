from pyspark.sql import functions as F

from graphloom.plans import fact_queries


def brute_force(links):
    found = {}
    for start in {x for link in links for x in link}:
        level, depth = {start}, 0
        while level:
            found |= {(start, x): depth for x in level}
            level, depth = {b for a, b in links if a in level and a != b and (start, b) not in found}, depth + 1
    return found


def test_closure_starts_at_every_kind_of_node(spark, tmp_path):
    chain = ["solution:s", "project:p", "type:a", "interface:b", "controller:c", "service:d", "dbcontext:e", "repository:f", "type:g", "type:h", "type:i"]
    links = set(zip(chain, chain[1:])) | {("type:g", "interface:b"), ("project:p", "service:d"), ("type:i", "type:i"), ("workspace:w", "solution:s")}
    rows = [(f" {a.upper()}", b, ("Defines", " contains ")[n % 2]) for n, (a, b) in enumerate(sorted(links))]
    rows += [*rows[:3], (None, "type:a", "DEFINES"), ("type:a", None, "DEFINES"), ("type:a", "type:z", "CALLS")]
    spark.createDataFrame(rows, "source_id string, target_id string, type string").withColumn("doc_pos", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/edges.parquet")
    got = [tuple(r) for r in fact_queries.inherits_closure(spark, str(tmp_path)).select("type_name", "base_name", "depth").collect()]
    assert len(got) == len({x[:2] for x in got})
    assert {(a, b): n for a, b, n in got} == brute_force(links)
    assert max(n for *_, n in got) > 3
