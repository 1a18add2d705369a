"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's intermediate tables that aren't removed yet, by session.
_made: dict[SparkSession, set[str]] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may leave that setting out; it gets a temporary folder.
    What ``release`` doesn't remove before goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sumweave-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: [release(s, set()) for s in list(_made)])
    _made.setdefault(spark, set()).add(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held(spark: SparkSession) -> set[str]:
    return set(_made.get(spark, ()))


def remove(spark: SparkSession, paths: set[str]) -> None:
    """Remove these intermediate tables; nothing may read them any more."""
    for path in paths:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone; its folder goes with it
            return
        _made.get(spark, set()).discard(path)


def release(spark: SparkSession, but: set[str]) -> None:
    """Remove all intermediate tables but these (what ``held`` gave before a step, say)."""
    remove(spark, held(spark) - but)
