"""Tables and files in the folder that all executors and the driver share.

``spark.checkpoint.dir`` names it. A plan that is needed twice, or whose
lineage is to be cut, is written there and read again, so that a lost executor
costs only the tasks it ran.

Each session writes to a folder of its own, which goes with the session;
``scope`` makes one that goes with a block of code. Operators drop what only
they read; what their lazy result reads stays as long as its folder.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_OWN: dict[tuple[str, str], str] = {}
_SCOPE: contextvars.ContextVar[str | None] = contextvars.ContextVar("scope", default=None)


def base(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where all runs in one JVM and none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="proofmill-")
    return _LOCAL["dir"]


def folder(spark: SparkSession) -> str:
    """The folder of the scope, or else of the session, which the driver's JVM removes when it ends."""
    if inside := _SCOPE.get():
        return inside
    key = (spark.sparkContext.applicationId, base(spark))
    if key not in _OWN:
        _OWN[key] = f"{key[1]}/proofmill-{uuid.uuid4().hex}"
        store, where = _store(spark, _OWN[key])
        store.deleteOnExit(where)
        if "dir" in _LOCAL and key[1] == _LOCAL["dir"]:
            store.deleteOnExit(_store(spark, key[1])[1])
    return _OWN[key]


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go at the end: by then all results that read them must be written elsewhere."""
    at = f"{base(spark)}/proofmill-{uuid.uuid4().hex}"
    token = _SCOPE.set(at)
    try:
        yield at
    finally:
        _SCOPE.reset(token)
        remove(spark, at)


def path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    at = path(spark, tag)
    df.write.parquet(at)
    made = spark.read.schema(df.schema).parquet(at)
    made._stored_at = at
    return made


def drop(*made: DataFrame) -> None:
    """Remove tables that ``stored`` has returned and nothing reads any more."""
    for df in made:
        remove(df.sparkSession, df._stored_at)


def sampled(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About ``rows`` distinct values of ``by`` at most, those whose hash is in the share that makes as many.

    What is drawn depends on the values alone; repeated rows count once, so
    that a value that many rows hold does not fill the sample.
    """
    share = min(1.0, rows / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates([*by])


def _store(spark: SparkSession, at: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def make_dirs(spark: SparkSession, at: str) -> str:
    store, where = _store(spark, at)
    store.mkdirs(where)
    return at


def remove(spark: SparkSession, at: str) -> None:
    store, where = _store(spark, at)
    store.delete(where, True)
