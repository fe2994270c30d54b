"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the driver ends; only a local master may run without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="framelink-")
    path = f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"
    file_system(spark, path).deleteOnExit(hadoop_path(spark, path))
    return path


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(hadoop_path(spark, path))


def size_of(spark: SparkSession, path: str) -> int:
    return file_system(spark, path).getContentSummary(hadoop_path(spark, path)).getLength()


def stored(df: DataFrame, path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet and read again, which cuts its lineage and survives lost executors."""
    path = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
