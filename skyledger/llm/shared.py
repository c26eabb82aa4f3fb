"""The cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a local folder in local mode, as in tests, and an error on a
    cluster, whose machines wouldn't share one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage and outlives lost executors. It is deleted when the
    application ends, since results are read from it only then."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Hadoop deletes it as the driver's virtual machine ends.
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return df.sparkSession.read.parquet(path)
