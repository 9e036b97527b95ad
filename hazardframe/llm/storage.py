"""Files in the shared folder, reached from Spark tasks, and tables kept there for a while."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from hazardframe.session import ensure_checkpoint_dir


ARROW_BATCH_BYTES = 4 << 20
ARROW_BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Texts differ in length by orders of magnitude: batches for Python are bounded by bytes, and by rows where Spark
    bounds rows only."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder named by spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a URI as Spark writes it (``file:/x``, ``hdfs://…``, ``s3://…``) or a plain path."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: later steps start from files that outlive any executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table whose last reader is done."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
