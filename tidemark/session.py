"""Session helpers.

The library never creates a cluster session on its own; it only reads what the
cluster configured.  ``local_session`` exists for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests / bench: UI off, AQE on, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` must name a shared file system and is
    used as it is; a missing setting is an error there, because a folder of one
    machine would hold only that machine's part of a table.  Only a ``local``
    master (tests, the bench), where driver and executors are one process, gets
    a fresh folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tidemark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a lineage-cutting table, inside the shared checkpoint folder.

    Every call gives a new one, so that two jobs (or two runs of one job)
    sharing the folder never write to the same place.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: cuts the lineage (a lost executor re-reads files instead of
    recomputing the inputs) and lets several result tables share one scan.
    ``files``: write at most so many, for tables that are small beside the
    shuffle they come from."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if files is not None:
        df = df.coalesce(max(1, files))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
