"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest

from corpuscube.plans import registry
from oracle import connect, rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tiny, name):
    got = registry.queries()[name](spark, tiny).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        want = connect(tiny).sql(sql).df()
        assert rows(got) == rows(want)


def test_flagship(spark, tiny):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["rank", "doc_id", "matched", "score", "fallback"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
