"""Snapshots: nested profiles, written in order, read by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S


def unit(metric: Column) -> Column:
    return F.when(metric.isin(S.PERCENTAGES), "percent").when(metric.isin(S.MEANS), "mean").otherwise("per90")


def nested_profiles(spells: DataFrame, percentiles: DataFrame) -> DataFrame:
    """spells with `metrics`, an array of all fields of each metric in the configured order.

    percentiles: player, team, metric, value, per90, coverage, status, percentile, peer_count.
    """
    place = F.array_position(F.array(*map(F.lit, S.METRICS)), F.col("metric"))
    fields = F.struct(place.alias("place"), "metric", "value", "per90", unit(F.col("metric")).alias("unit"), "coverage", "status", "percentile", "peer_count")
    each = percentiles.groupBy("player_id", "team_id").agg(F.array_sort(F.collect_list(fields)).alias("m"))
    each = each.withColumn("metrics", F.transform("m", lambda x: x.dropFields("place"))).drop("m")
    return spells.join(each, ["player_id", "team_id"], "left")


def write_snapshot(df: DataFrame, path: str, by: str, order: list[str]) -> None:
    """Partitions by `by`, each file sorted by `order`; ranges of both are dealt over tasks. Refuses to replace what is there.

    A partition's files cover ranges that follow each other, so their names are in the order of their rows.
    """
    dealt = df.repartitionByRange(F.col(by), *[F.col(c) for c in order]).sortWithinPartitions(by, *order)
    dealt.write.mode("errorifexists").partitionBy(by).parquet(path)


def load_partitions(spark: SparkSession, path: str, by: str, wanted: DataFrame) -> DataFrame:
    """Rows of the partitions that `wanted` (a column `by`) names; the scan reads no others."""
    return spark.read.parquet(path).join(F.broadcast(wanted.select(by).distinct()), by, "left_semi")
