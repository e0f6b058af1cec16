"""Tables in the folder that all executors see."""

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a session within one process may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return _own_dir(spark.sparkContext.applicationId)


def folder(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for table in tables:
        fs, at = folder(table.sparkSession, table.stored_at)
        fs.delete(at, True)


def materialise(df: DataFrame, *instead: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, which ends its lineage: a lost executor costs no recomputation.

    instead: materialised tables that nothing reads once df is written; they are deleted. All others stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    discard(*instead)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out
