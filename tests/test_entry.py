"""The registry: names, SQL twins, and the flagship query."""

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0].tp + rows[0].fn > 0
