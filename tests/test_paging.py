"""Pages from ranges of the order against slices of the whole order."""

import pytest
from pyspark.sql import functions as F

from aqspark.operators.alerts import page


def by_score():
    return [F.col("score").desc_nulls_last(), "id"]


@pytest.fixture(scope="module")
def rows(spark):
    # a third of all rows share one score, some have none
    scores = [None if i % 50 == 0 else 7 if i % 3 == 0 else (i * 37) % 101 for i in range(2000)]
    listed = [(i, s) for i, s in enumerate(scores)]
    ordered = sorted(listed, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    return spark.createDataFrame(listed, "id long, score int").repartition(5), ordered


@pytest.mark.parametrize("number, size", [(1, 20), (2, 20), (17, 100), (100, 20), (101, 20), (667, 3), (0, 0), (-4, 1000)])
def test_equals_slice(rows, number, size):
    df, ordered = rows
    got = [tuple(r) for r in page(df, by_score(), number, size).collect()]
    n, k = max(1, number), min(100, max(1, size))
    assert got == [(*r, len(ordered)) for r in ordered[(n - 1) * k : n * k]]


def test_pages_hold_every_copy_once(spark):
    df = spark.createDataFrame([(1, "same")] * 250 + [(2, "other")] * 30, "a int, b string")
    sizes = [page(df, ["a"], n, 100).groupBy("a").count().collect() for n in (1, 2, 3, 4)]
    assert [{r["a"]: r["count"] for r in s} for s in sizes] == [{1: 100}, {1: 100}, {1: 50, 2: 30}, {}]


def test_empty_table(spark):
    assert page(spark.createDataFrame([], "a int"), ["a"]).collect() == []


def test_only_ranges_that_hold_the_page_are_sorted(rows):
    df, _ = rows
    plan = page(df, by_score(), 90, 20)._jdf.queryExecution().optimizedPlan().toString()
    # the rows are joined with the ranges of the page before they are numbered
    assert plan.index("row_number(") < plan.index("Join Inner")
