"""Sources of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_captures(spark: SparkSession, path: str, pattern: str | None = None, glob: str = "*.txt") -> DataFrame:
    """One row (doc_id, path, text, at) for each text file whose name fits `glob`, in no order (sort by path where order matters, after the texts are gone); `pattern` is a substring that the name must have. Ids are hashes of paths, `at` is when the file was written."""
    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(path).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    if pattern:
        rows = rows.where(F.contains(F.element_at(F.split("file_path", "/"), -1), F.lit(pattern)))
    return _captures(rows)


def _captures(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("file_path").alias("doc_id"), F.col("file_path").alias("path"), F.col("value").alias("text"), F.col("file_modification_time").alias("at"))


def stream_captures(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """As read_captures, for files as they appear in a folder; in no order."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(path)
    return _captures(rows.select("value", "_metadata.file_path", "_metadata.file_modification_time"))


def capture_source(text: str | Column, changed: str | Column, fallback: str | Column) -> Column:
    """selection if the copy changed the clipboard; else its old text counts if falling back is allowed and there is one; else empty."""
    text, changed, fallback = (F.col(x) if isinstance(x, str) else x for x in (text, changed, fallback))
    return F.when(changed & (text != ""), F.lit("selection")).when(fallback & (text != ""), F.lit("clipboardFallback")).otherwise(F.lit("empty"))
