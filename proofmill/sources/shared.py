"""Tables that cut a plan's lineage, in the folder that ``spark.checkpoint.dir`` names.

A temporary folder is used only where all runs in one JVM and none is named.
The driver's JVM removes what a session has written when it ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    key = spark.sparkContext.applicationId
    if key not in _FOLDERS:
        named, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
        if not named and not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        _FOLDERS[key] = f"{(named or 'file://' + tempfile.mkdtemp(prefix='proofmill-')).rstrip('/')}/proofmill-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[key])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return _FOLDERS[key]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` and read it back.

    The driver then collects its garbage: plans and metrics of tables that are
    written fill its heap to the limit otherwise, and the shuffle files of
    those before stay on the executors' disks until it does.
    """
    at = f"{folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(at)
