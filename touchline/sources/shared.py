"""Tables written once to the session's shared checkpoint folder, to cut a lineage that is read often."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, for the driver and all executors.

    Where it is unset a session of one machine (master local) gets a folder of its own; on a cluster that
    would be another disk for every executor, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialised(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet, with the options of the writer, and read back; executors that are lost later cost nothing but their tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialised` wrote, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
