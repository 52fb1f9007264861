from pyspark.sql import functions as F

from graphloom.plans import fact_queries


def test_every_contributor_gets_table_data(spark, data):
    rows = fact_queries.scan_graph(spark, data).collect()
    total = lambda kind, of, *sure: sum(r.rows for r in rows if (r.kind, r.type) == (kind, of) and (not sure or r.certainty in sure))
    assert {r.type for r in rows if r.kind == "edge"} >= {"CONTAINS", "DEFINES", "IMPLEMENTS", "INJECTS", "CALLS", "DISPATCHES", "HANDLED_BY", "EXPOSES", "USES_HTTP_CLIENT", "CALLS_HTTP", "QUERIES_ENTITY", "USES_DBCONTEXT", "MAPS_TO_TABLE"}
    key = lambda x: F.lower(F.trim(x))
    n = spark.read.parquet(f"{data}/nodes.parquet").where("trim(id) != '' and trim(display_name) != ''")
    e = spark.read.parquet(f"{data}/edges.parquet").where("trim(source_id) != '' and trim(target_id) != ''")
    ends = lambda of: e.where(key("type") == of).select(key("source_id"), key("target_id")).distinct().count()
    assert total("edge", "DISPATCHES") == ends("dispatches") > 0
    assert total("edge", "IMPLEMENTS") == ends("implements") > 0
    assert total("edge", "USES_DBCONTEXT") == ends("uses_dbcontext") > 0
    assert total("node", "Entity") == n.where(key("type") == "entity").select(key("id")).distinct().count()


def test_references_between_projects(spark, tmp_path):
    node = "doc_pos long, id string, type string, display_name string, source_location struct<file_path:string,line:int,column:int>, repository_name string, project_name string, metadata map<string,string>"
    p = lambda i, repo: (i, f" PROJECT:{i}", "Project", f"P{i}", None, repo, None, {})
    spark.createDataFrame([p(1, "a"), p(2, "a"), p(3, "b")], node).write.parquet(f"{tmp_path}/nodes.parquet")
    edge = "doc_pos long, source_id string, target_id string, type string, display_name string, source_location struct<file_path:string,line:int,column:int>, repository_name string, project_name string, metadata map<string,string>"
    spark.createDataFrame([(1, "project:1", "Project:2 ", "depends_on", "x", None, None, None, {}), (2, "project:1", "project:3", "DEPENDS_ON", "x", None, None, None, {}), (3, "project:1", "project:9", "DEPENDS_ON", "x", None, None, None, {})], edge).write.parquet(f"{tmp_path}/edges.parquet")
    text = "select o.item from orders join"
    spark.createDataFrame([(7, text + " lines")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.kind, r.type, r.certainty): r.rows for r in fact_queries.scan_graph(spark, str(tmp_path)).collect()}
    assert got["edge", "DEPENDS_ON", 3] == 2 and got["edge", "CROSSES_REPO_BOUNDARY", 3] == 1
    assert got["edge", "DEPENDS_ON", 1] == got["node", "Table", 1] == 2 and got["node", "Project", 3] == 3
