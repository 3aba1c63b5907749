"""Tables on disk: the folder that a cluster shares, tables that cut lineage, and keyed merges into Parquet."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Rows that a task of a step gets whose results outgrow its input.
_ROWS = 400_000
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, n_rows: int) -> int:
    """The number of partitions for so many rows: it grows with them, so that a task's memory does not."""
    return max(spark.sparkContext.defaultParallelism, n_rows // _ROWS + 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the setting is absent on a single machine (``local[*]``, as in tests) a temporary folder takes its
    place; on a cluster its absence is an error, for executors would write where nobody else can read.
    """
    found = spark.conf.get(_SETTING, None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="faintline-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/faintline/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has already gone, and its folder with it
        pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # nothing refers to the shuffle files behind the tables before this one any more: let Spark's cleaner delete them
    # now, not at some later collection of the driver's garbage (Python's handles of Java objects are cyclic)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _PATHS[kept] = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` made; no plan that still is to run may read them."""
    for kept in tables:
        _drop(kept.sparkSession, _PATHS.pop(kept))
