from graphloom.plans import fact_queries


def test_every_client_counts_with_its_whole_name(spark, tmp_path):
    rows = [
        (1, "HttpClient", "OrderBilling", "r1"),
        (2, "httpclient ", "Orders", "r1"),
        (3, "HttpClient", "Api", "r1"),
        (4, "HttpClient", None, "r3"),
        (5, "HttpClient", " ", "r1"),
        (6, "HttpClient", "OrderQueue", "r9"),
        (11, "ConfigurationKey", "Order:Url", "r1"),
        (13, "ConfigurationKey", "OrderBilling:Url", "r1"),
        (14, "ConfigurationKey", "MyApi:Url", "r1"),
        (15, "ConfigurationKey", "OrderQueue:Host", "r2"),
    ]
    spark.createDataFrame(rows, "doc_pos long, type string, display_name string, repository_name string").write.parquet(f"{tmp_path}/nodes.parquet")
    settings = {r.key: r.seq for r in fact_queries.fact(spark, str(tmp_path), "settings").collect()}
    assert settings == {"Order:Url": 11, "OrderBilling:Url": 13, "MyApi:Url": 14, "OrderQueue:Host": 15}
    # values name the repository alone, so the place of a setting is told by naming it in the value
    config = fact_queries.fact(spark, str(tmp_path), "settings").selectExpr("seq", "key", "concat('http://h', seq) as value", "repository_path")
    clients = fact_queries.fact(spark, str(tmp_path), "http_clients")
    got = {r.client_no: r.base_url for r in fact_queries.extract.base_urls(clients, config).collect()}
    assert got == {1: "http://h13", 2: "http://h11", 3: "http://h14", 4: "http://h11", 5: "http://h11", 6: "http://h15"}
    assert {r.client_no for r in fact_queries.base_url_tiers(spark, str(tmp_path)).collect()} == {1, 2, 3, 4, 5, 6}
