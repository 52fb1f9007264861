import pytest

import __spark_entry__ as entry

ID = "Repository:4089EDBB95623AC5"
ROW = "id string, type string, display_name string, source_location struct<file_path:string,line:int,column:int>, repository_name string, project_name string, certainty tinyint, metadata map<string,string>, doc_pos long"


def tables(spark, at, ids):
    rows = [(i, "Repository", f"r{n}", None, None, None, 3, {}, n) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, ROW).write.parquet(f"{at}/nodes.parquet")
    spark.createDataFrame([("repository:shared", *rows[0][1:])], ROW).drop("doc_pos").write.parquet(f"{at}/shared_nodes.parquet")
    return str(at)


@pytest.mark.parametrize("ids,want", [(["repository:other"], []), (["repository:other", f" {ID}"], [(ID.lower(), "Repository", "r1")])])
def test_query_gives_no_row_for_an_absent_id_as_its_sql(spark, tmp_path, ids, want):
    got = entry.queries()["resolve_by_id"](spark, tables(spark, tmp_path, ids))
    assert got.dtypes == [("id", "string"), ("type", "string"), ("display_name", "string")]
    assert [tuple(r) for r in got.collect()] == want
