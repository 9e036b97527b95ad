"""Session settings and lineage control."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "hazardframe", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    scratch folder of its own; on a cluster a missing setting is an error, because a machine-local folder would be
    lost together with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="hazardframe-ckpt-")
    context.setCheckpointDir(configured)
    return configured


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table that several jobs read, in memory or on disk, until the block ends."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back. ``options`` are those of the writer.

    What follows starts from files that outlive any executor, reads only the columns it needs, and does not repeat the
    work behind ``df`` for each of its branches.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/hazardframe-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
