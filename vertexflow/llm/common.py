"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_crc32(key: str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(key).cast("string").cast("binary"))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z alone; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(batch, rows: int = 256):
    """Slices of an Arrow batch, so that Python holds few long texts at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only for a table counted at no more than ``most`` rows."""
    return F.broadcast(df) if rows <= most else df
