"""The folder that all of a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where none is set and Spark is local."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that what is used more than once is computed once."""
    path = f"{shared_dir(df.sparkSession)}/kept/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)  # digests as text take half of what they do by default
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._kept_at = path
    return found


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by kept() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
