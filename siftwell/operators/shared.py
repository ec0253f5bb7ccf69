"""Tables that one job writes and a later one reads, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; a folder of our own only in local mode without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/siftwell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table, read again, and its path: computed once, and its lineage cut."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        system, where = _at(spark, path)
        system.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What stands in a folder, in order."""
    system, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where))


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    system, where = _at(spark, path)
    system.create(where, True).close()


def rename(spark: SparkSession, path: str, to: str) -> None:
    system, where = _at(spark, path)
    if not system.rename(where, _at(spark, to)[1]):
        raise OSError(f"{path} can't be renamed to {to}")


def streamed(spark: SparkSession, paths: list[str], to: str) -> None:
    """Files put together in order as one, through a buffer; they may stand in another store."""
    system, where = _at(spark, to)
    out = system.create(where, True)
    try:
        for path in paths:
            source, part = _at(spark, path)
            given = source.open(part)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(given, out, 1 << 20, False)
            finally:
                given.close()
    finally:
        out.close()
