"""Intermediate tables in the shared folder: a lost executor repeats no lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme and authority that Spark gives it: those of its default file system, if it has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only where that is unset, one of our own: in the warehouse, or, if all
    runs on this machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local"):
            folder = f"file://{tempfile.mkdtemp(prefix='arborlens-')}"
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        else:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return qualified(spark, folder)


_written: dict[str, list[str]] = defaultdict(list)


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def new_path(spark: SparkSession, what: str) -> str:
    """A path that no other run uses; release() removes what is there."""
    path = f"{shared_dir(spark)}/arborlens/{what}-{uuid.uuid4().hex[:12]}"
    _written[_session(spark)].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables and files of this session; call it when the results that rest on them are written."""
    for path in _written.pop(_session(spark), []):
        remove(spark, path)


#: Whether what an execution has shuffled goes with its end, rather than when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and a lost executor costs no recomputation. options: the writer's."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Remove what stored() wrote for df: nothing that is still to be computed may read it."""
    spark, path = df.sparkSession, df._stored_at
    _written[_session(spark)].remove(path)
    remove(spark, path)
