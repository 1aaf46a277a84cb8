"""Session settings that results depend on, and the shared folder for written state."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings: UTC dates, and adaptive plans that split skewed partitions."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def local_session(app: str, cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder every executor can reach, below the cluster's ``spark.checkpoint.dir``."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set; pass an explicit shared folder")
    return f"{root.rstrip('/')}/{name}"


def durable(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``: written to the folder that ``spark.checkpoint.dir`` names, so it is computed
    once and outlives its executors. Where the setting is missing, a local session gets a temporary
    folder; a cluster has none that all executors reach.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = context.getConf().get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; nothing can be kept for all executors")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="sitrep-"))
    return df.checkpoint()


def importable(spark: SparkSession) -> SparkSession:
    """Let the Python workers of this session import the library from where the driver has it.

    Enough where executors see the driver's folders; elsewhere install it or pass ``--py-files``.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return spark
