"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where the session names no folder, one is made on this machine, which only a local master may use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


#: bytes of a row group that a task holds while it writes a table of ``stored``
ROW_GROUP = 32 << 20


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files behind it are given up with the write, not when the driver happens to collect garbage.
    """
    path = shared_folder(df.sparkSession)
    write = df.write.option("parquet.block.size", str(ROW_GROUP))
    with _setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        write.partitionBy(*partition_by).parquet(path) if partition_by else write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session was tuned to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
