"""Intermediate tables in the folder that driver and executors share.

Long lineages are cut by writing a Parquet table under ``spark.checkpoint.dir``
and reading it back: the files outlive any executor, and a lost task re-reads
them instead of repeating the stages before.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "/tmp/checkpoints"
_roots: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _FALLBACK
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _roots[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the written table.

    The table is removed when the driver's Python process ends, since the
    returned frame, and any made from it, read it lazily.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(paths: list[str] | None = None) -> None:
    """Remove staged tables (all of this process by default)."""
    for path in list(_roots if paths is None else paths):
        spark = _roots.pop(path, None)
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already; the folder is scratch space
            pass


atexit.register(drop)
