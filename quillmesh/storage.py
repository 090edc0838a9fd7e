"""Tables in the cluster's shared folder, to cut lineage in a way that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; set here only where it is unset.

    Unset on a local master: a fresh temporary folder. Unset on a cluster: a folder under the
    warehouse, if that lies in a store that every executor reaches; a warehouse in a local folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local["):
        own = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    else:
        own = cluster_folder(_qualified(spark, spark.conf.get("spark.sql.warehouse.dir")))
    spark.conf.set("spark.checkpoint.dir", own)
    context.setCheckpointDir(own)
    return own


def _qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, as the default file system completes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def cluster_folder(warehouse: str) -> str:
    """A folder for written tables under a cluster's warehouse, given with its scheme."""
    if warehouse.startswith("file:"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is local")
    return warehouse.rstrip("/") + "/_checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later plans start from files of known size.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
