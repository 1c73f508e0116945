"""Intermediate tables that end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a local one in local mode, else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))  # the setting itself is fixed once a session runs
        folder = context.getCheckpointDir()
    return folder


#: Spark deletes the shuffle files of a write as soon as it is done; otherwise they stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *instead: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back. instead: tables of stored() that nothing reads any more; they are deleted then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    for old in instead:
        gone = spark._jvm.org.apache.hadoop.fs.Path(old._stored)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return out
