"""Reference sets as bitmaps: who belongs to the complete reference of a role for a set of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_key(role: Column, metrics: Column) -> Column:
    """ROLE:m1+m2, with metrics in alphabetical order."""
    return F.concat(role, F.lit(":"), F.array_join(F.array_sort(metrics), "+"))


def members(long: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, entity) of the complete reference of each role and set. long: player_id, team_id, role, metric, v, is_ref; sets: set, metric."""
    names = sets.groupBy("set").agg(F.collect_set("metric").alias("metrics")).withColumn("parts", F.size("metrics"))
    rows = long.where("is_ref and v is not null and role is not null").join(F.broadcast(sets.select("set", "metric").distinct()), "metric")
    rows = rows.groupBy("set", "role", "player_id").agg(F.count("*").alias("has"))
    rows = rows.join(F.broadcast(names), "set").where("has = parts")
    return rows.select(set_key(F.col("role"), F.col("metrics")).alias("key"), "player_id").distinct()


def bitmaps(rows: DataFrame) -> DataFrame:
    """(key, bucket, bitmap): 32,768 ids in a bucket, so that no row grows with the set."""
    keyed = rows.select("key", F.bitmap_bucket_number("player_id").alias("bucket"), F.bitmap_bit_position("player_id").alias("bit"))
    return keyed.groupBy("key", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def counted(maps: DataFrame) -> DataFrame:
    return maps.groupBy("key").agg(F.sum(F.bitmap_count("bitmap")).alias("peer_count"))


def listed(maps: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (key, player_id) that are members, by a test of their bit."""
    rows = candidates.withColumns({"bucket": F.bitmap_bucket_number("player_id"), "bit": F.bitmap_bit_position("player_id")}).join(maps, ["key", "bucket"])
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumn("byte", byte).where("shiftright(byte, cast(bit % 8 as int)) & 1 = 1")
    return rows.drop("bucket", "bit", "bitmap", "byte")
