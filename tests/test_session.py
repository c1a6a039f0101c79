"""Where stored steps go."""

import pytest

from aqspark.session import settle, stored_folder


def test_checkpoint_folder_comes_first():
    assert stored_folder("spark://m:7077", "hdfs://c", "hdfs://w", True) == "hdfs://c"


def test_shared_warehouse_or_local_master_will_do():
    assert stored_folder("spark://m:7077", None, "hdfs://w", True) == "hdfs://w/_stored"
    assert stored_folder("local[8]", None, "file:/w", False) == "file:/w/_stored"


def test_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored_folder("spark://m:7077", None, "file:/w", False)


def test_settle_keeps_rows_and_types(spark):
    df = spark.range(10).selectExpr("id", "CAST(id AS DECIMAL(9, 2)) AS d", "IF(id > 3, id, NULL) AS n")
    out = settle(df)
    assert out.dtypes == df.dtypes and sorted(out.collect(), key=lambda r: r.id) == df.collect()
