"""Tables written between two steps, so that what follows reads them instead of deriving them anew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine; on a cluster, where executors
    would not see it, RuntimeError."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="drivelake-"))
        found = sc.getCheckpointDir()
    return found


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"


def staged(df: DataFrame, partition_by: str | None = None, path: str | None = None) -> DataFrame:
    """df, written as Parquet to path or a new folder of the shared one, and read again. A lost executor loses nothing of it."""
    path = path or new_folder(df.sparkSession)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
