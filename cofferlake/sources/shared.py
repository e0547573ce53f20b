"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the setting is absent, a session in one process (tests) gets a temporary folder; on a cluster it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cofferlake.shared.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cofferlake-")
        spark.conf.set("cofferlake.shared.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its content goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/cofferlake/{name}-{uuid.uuid4().hex}"
    store, jpath = file_system(spark, path)
    store.deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and every reader sees the same rows.

    Rows lie apart by the columns ``by``; who filters on them reads the others not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_apart(df: DataFrame, path: str, by: list[str], folders: int) -> None:
    """Write ``df`` in folders by the columns ``by``, at most ``folders`` of them, which a task has open side by side.

    So rows need not be sorted by folder; and what was shuffled is deleted when all is written, not when Java next clears its memory.
    """
    conf = df.sparkSession.conf
    wanted = {"spark.sql.maxConcurrentOutputFileWriters": str(folders), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: conf.get(k, None) for k in wanted}
    for k, x in wanted.items():
        conf.set(k, x)
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        for k, x in before.items():
            conf.unset(k) if x is None else conf.set(k, x)


def file_system(spark: SparkSession, path: str):
    """The store of ``path`` and the path itself, as Hadoop's objects."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def delete_path(spark: SparkSession, path: str) -> None:
    store, jpath = file_system(spark, path)
    store.delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, jpath = file_system(spark, path)
    return store.exists(jpath)


def move_path(spark: SparkSession, path: str, target: str) -> None:
    store, jpath = file_system(spark, path)
    if not store.rename(jpath, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"{path} could not be moved to {target}")


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small file that appears whole: written beside its place and moved there."""
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)
    beside = f"{path}.{uuid.uuid4().hex}"
    store, jpath = file_system(spark, beside)
    out = store.create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    delete_path(spark, path)
    move_path(spark, beside, path)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return "\n".join(r.value for r in spark.read.text(path).collect())
