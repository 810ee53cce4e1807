"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local master may go without that setting: it then gets a temporary folder that goes at exit.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        own = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, none if there is no such folder."""
    jvm, p = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def create_empty(spark: SparkSession, path: str) -> bool:
    """Create an empty file, in one step; False if there is one already."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(p)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_forget, spark, path)


def materialize(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``codec`` is the files' compression, if not the session's.

    This cuts the lineage: later jobs read files that outlive any executor. The files go when the driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete the files of tables from :func:`materialize` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored", None):
            delete_path(t.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        delete_path(spark, path)


def spread(df: DataFrame, most: float = 0) -> DataFrame:
    """``df`` over all cores if it comes in fewer pieces than there are: a small file may be one piece. A table of more pieces stays as it is, without a shuffle.

    So does one whose largest piece has at most ``most`` times a core's share of the rows; the rows of each piece are counted for that, without their columns.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > cores:
        return df
    if most:
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # at most one row for each core
        if max(sizes, default=0) * cores <= most * sum(sizes):
            return df
    return df.repartition(cores)
