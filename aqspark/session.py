"""Session settings and stored steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("aqspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def stored_folder(master: str, checkpoint_dir: str | None, warehouse_dir: str, warehouse_is_set: bool) -> str:
    """Folder for stored steps that all executors share: the checkpoint folder, else one beside the warehouse's tables.

    Raises on a cluster with neither set, whose default warehouse is a folder of the driver's machine.
    """
    if checkpoint_dir:
        return checkpoint_dir
    if warehouse_is_set or master.startswith("local"):
        return f"{warehouse_dir}/_stored"
    raise ValueError("set spark.checkpoint.dir or spark.sql.warehouse.dir to a folder that all executors share")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Set the checkpoint folder where it is unset.

    What is stored there is the cluster's to clean, since a returned frame may
    still read it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    warehouse = "spark.sql.warehouse.dir"
    sc.setCheckpointDir(stored_folder(
        sc.master, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get(warehouse), sc.getConf().contains(warehouse)
    ))


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and store it as a table in the shared checkpoint folder.

    Used where a later step must see the very same rows, even after an executor
    is lost, and where several steps read them. Columnar files let each of
    those steps read only its columns, and their size tells Spark whether a
    side is small enough to broadcast.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
