"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key's partition even where that costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rank limits of up to this size act before the shuffle; the text tail needs 1,201 lines of a run.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: str = "8", app: str = "capsieve", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        # Small local files: one task per file rather than a few tasks for all.
        "spark.sql.files.openCostInBytes": "65536",
        "spark.driver.memory": "16g",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else started."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="capsieve-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, for results that several branches read.

    Unlike a checkpoint of rows it is columnar: readers prune columns and the planner knows its size.
    It outlives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/capsieve-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
