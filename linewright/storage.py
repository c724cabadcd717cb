"""Intermediate relations as tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet under spark.checkpoint.dir (where that is unset, under the warehouse) and read again: what is used several times is computed once, and survives lost executors."""
    spark = frame.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def shuffled(frame: DataFrame) -> DataFrame:
    """The frame as a side of a join that must be a merge. Spark takes a stored relation for no larger than its files, of which rows take many times as much, and what is exploded or joined from it too; a broadcast of it would fill the driver."""
    return frame.hint("merge")
