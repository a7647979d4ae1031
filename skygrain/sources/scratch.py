"""Written intermediate tables.

Iterative and multi-pass operators cut their lineage by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``. All executors share it, so a lost executor loses nothing. Only where that setting is absent and all
tasks run on the driver's machine, as in tests, a temporary folder takes its place; without it a cluster is an error.

An application's tables lie in one folder, which goes when the driver's Python ends: frames that were handed out read them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at:
            _FOLDERS[app] = f"{at.rstrip('/')}/skygrain/{app}"
            atexit.register(_remove, spark, _FOLDERS[app])
        elif spark.sparkContext.master.split("[")[0] == "local":
            own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            _FOLDERS[app] = f"file://{own}"
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _FOLDERS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM is gone: the folder stays until the shared one is cleared
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table on shared storage, read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
