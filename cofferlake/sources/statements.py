"""Statement files in a folder, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(reader, path: str) -> DataFrame:
    """Unnumbered lines: (file, block, line), block being where the part of the file that was read begins."""
    rows = reader.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))


def numbered(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) from lines (file, block, line) as they were read; only a count for each block is shuffled.

    Spark reads a block of a file in one go, so that the places of its lines follow each other.
    """
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    blocks = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line_no"), "line")


def statement_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all text files below ``path``; large files are read by several tasks."""
    return numbered(_read(spark.read, path))


def statement_source(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, value) for each text file below ``path``, for files that fit in a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def statement_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines (file, block, line) of files that land in ``path``; a micro-batch numbers them."""
    return _read(spark.readStream, path)


def _unbundled(lines: DataFrame) -> DataFrame:
    """The statements' own lines of bundles: what stands before the first tab of a line names its statement.

    The lines of a statement follow each other in one bundle, so its part of a block is numbered like that of a file.
    """
    return lines.select(F.substring_index("line", "\t", 1).alias("file"), "block", F.expr("substr(line, instr(line, '\t') + 1)").alias("line"))


def bundled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of all bundles below ``path``.

    A small statement costs a store as much as a large file does; so very many are landed in bundles.
    """
    return numbered(_unbundled(_read(spark.read, path)))


def bundled_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines (file, block, line) of bundles that land in ``path``; a micro-batch numbers them."""
    return _unbundled(_read(spark.readStream, path))
