"""Session helpers: settings the operators rely on, and where lineage may be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "attestry", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; a temporary folder is made (and recorded
    in the session) only where that is unset, which is the case in local tests.
    """
    where = spark.conf.get(CHECKPOINT_CONF, None)
    if where is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_CONF, where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: for wide rows that are read several times, column by column."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, most: int = 100_000) -> DataFrame:
    """Deals the rows of a scan over all cores, and over more tasks where one would get more than about ``most`` rows.

    For work that is heavy per row over small or unsplittable files. Splits are cut by bytes, but a columnar file is read by whole
    row groups: of many splits a few may hold all rows, so that tasks grow with the table. A table with enough splits for its
    rows is returned as it is, unshuffled. Pass a plain scan with the columns needed and nothing computed yet: it is counted.
    """
    tasks = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // most))
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan
