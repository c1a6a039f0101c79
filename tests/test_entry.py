"""The entry point names every query once and gives twins only for those."""

import __spark_entry__ as entry


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
