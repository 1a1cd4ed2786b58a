"""Every registered query against its SQL, on the smallest tables."""

import pytest

from helpers import rows
from textloom import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, small, duck, name):
    got = plans.QUERIES[name](spark, small).toPandas()
    if name in plans.SQL:
        assert rows(got) == rows(duck.sql(plans.SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(plans.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
