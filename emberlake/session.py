"""Session settings and the shared scratch area."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Geometry and parsing cost far more per byte than AQE assumes, so small stages keep more tasks.
RUNTIME_CONF = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "emberlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; cluster sizing is left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on (UTC timestamps above all)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage cuts are written to.

    A cluster names a shared one in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="emberlake-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the checkpoint folder, reachable by every executor."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialised(df: DataFrame, label: str = "step", codec: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    This cuts the lineage of iterative operators on reliable storage: a lost executor costs a
    re-read, and the planner sees the real size. Without ``codec`` the session's compression is used.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
