import __spark_entry__


def test_names_and_sql():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
