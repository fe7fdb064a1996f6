"""Tables that cut lineage, in the folder that the cluster shares.

Intermediate results go as Parquet below ``spark.checkpoint.dir`` (read from the session), so that a lost executor
costs a reread and never a recomputation of everything before. Where the setting is missing, a folder below the
system's temporary one is used, which is right only for a local master; on any other master that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file:///tmp/checkpoints"
        _roots[app] = f"{base.rstrip('/')}/tilewise-{app}-{uuid.uuid4().hex[:8]}"
        if _roots[app].startswith("file:"):
            atexit.register(shutil.rmtree, "/" + _roots[app].removeprefix("file:").lstrip("/"), True)
        else:  # the driver's JVM removes it when it ends
            where = spark._jvm.org.apache.hadoop.fs.Path(_roots[app])
            where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return _roots[app]


def folder(spark: SparkSession, name: str) -> str:
    """A new path; nothing is there yet."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df and return it as read back, with the same schema."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tilewise_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove what ``save`` wrote. Only for tables that no later plan reads."""
    path = getattr(df, "_tilewise_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
