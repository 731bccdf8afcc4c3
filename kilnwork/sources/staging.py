"""Tables written to the folder all executors share, to cut lineage between the steps of an operator.

A staged table survives the loss of executors, unlike a cached or locally checkpointed one, and a step that reads it does
not repeat the steps before it. Files go below ``spark.checkpoint.dir`` and are deleted when the JVM ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, on one machine a temporary one, on a cluster an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = getattr(shared_dir, "own", None)
        if own is None:
            own = shared_dir.own = tempfile.mkdtemp(prefix="kilnwork-")
            delete_on_exit(spark, own)
        known = own
    return known.rstrip("/")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete what is at a path when the JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def stage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more, as those of a loop's step before the last."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def mounted_dir(spark: SparkSession, label: str) -> str:
    """Name of a folder below the shared one for tasks' own scratch files, as a path; the shared folder must be mounted. Tasks make it."""
    scheme, _, rest = shared_dir(spark).rpartition("://") if "://" in shared_dir(spark) else ("file", "", shared_dir(spark).removeprefix("file:"))
    if scheme not in ("", "file"):
        raise ValueError("scratch files need a shared folder that is mounted as a path")
    path = f"{rest}/{label}-{uuid.uuid4().hex}"
    delete_on_exit(spark, f"file:{path}")
    return path
