"""Parquet partitions that are written once, and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Refuses to replace what is there."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def load_partition(spark, path: str, by: str, key) -> DataFrame:
    """One partition; the others are pruned."""
    return spark.read.parquet(path).where(F.col(by) == key)


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)))
