import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if not n[1].isdigit() or n.startswith("p1_")]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, sf, name):
    rows = entry.queries()[name](spark, sf)
    assert len(set(rows.columns)) == len(rows.columns)
    assert rows.count() >= 0
