"""Tables written to the cluster's shared folder, used to cut lineage.

The folder is the one named by ``spark.checkpoint.dir``. Only a local session
that names none gets a folder of its own; on a cluster a missing setting is an
error, because a machine-local folder would vanish with its machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tideframe-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tideframe/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove the tables this application wrote. Frames built on them stop working."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(conf).delete(path, True)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the stored table.

    Parquet, not an RDD checkpoint: later readers still prune columns and push
    filters, and an executor lost afterwards costs nothing.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
