import __spark_entry__ as entry


def test_every_query_is_callable_and_sql_belongs_to_one():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert all(callable(q) for q in queries.values())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_text_package():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['graphloom.llm'] = None\nimport __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p7_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
