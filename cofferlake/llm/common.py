"""Shared folders, materialised stages and bounded samples."""

from __future__ import annotations

import gc
import threading
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cofferlake.sources.shared import delete_path, scratch_path

#: Where the files of materialised stages are.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LOCAL = threading.local()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _PATHS[read] = path
    _written().append(path)
    return read


def stages_so_far() -> int:
    """How many stages this thread has materialised."""
    return len(_written())


def discard_since(spark: SparkSession, start: int, *keep: DataFrame) -> None:
    """Delete what this thread has materialised from ``start`` on, but for the stages to ``keep``."""
    kept = {_PATHS[stage] for stage in keep}
    for path in _written()[start:]:
        if path not in kept:
            delete_path(spark, path)


def discard(*stages: DataFrame) -> None:
    """Delete the files of materialised stages whose results nothing will read again."""
    for stage in stages:
        delete_path(stage.sparkSession, _PATHS.pop(stage))


def _written() -> list[str]:
    if not hasattr(_LOCAL, "paths"):
        _LOCAL.paths = []
    return _LOCAL.paths


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished jobs now, not when the driver's memory happens to run low."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones on every run: those whose key hashes lowest."""
    return df.orderBy(F.xxhash64(F.lit(11), F.col(key)), key).limit(rows)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores in front, so that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
