"""Interval operators: every range condition stands behind equality keys, sweeps need no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, edge: float = 0, how: str = "left_semi") -> DataFrame:
    """points inside (left_semi) or outside (left_anti) any span of their keys, edges included."""
    s = spans.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    on = (F.col(at) >= F.col("s_start") - edge) & (F.col(at) <= F.col("s_end") + edge)
    for k in keys:
        on = on & (F.col(k) == F.col(f"s_{k}"))
    return points.join(s, on, how)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Positive intersections of spans of the same keys."""
    r = right.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    out = left.join(r, keys).withColumns({"from": F.greatest("start", "r_start"), "to": F.least("end", "r_end")})
    return out.where(F.col("from") < F.col("to"))


def nearest_anchor(points: DataFrame, anchors: DataFrame, keys: list[str], point_id: str, at: str, tolerance: float) -> DataFrame:
    """point_id, at and snapped: the nearest anchor within the tolerance (the smaller of two), else the point."""
    a = anchors.select(*keys, F.col("at").alias("anchor")).distinct()
    near = points.join(a, keys).where(F.abs(F.col(at) - F.col("anchor")) <= tolerance)
    best = near.groupBy(point_id).agg(F.min_by("anchor", F.struct(F.abs(F.col(at) - F.col("anchor")), F.col("anchor"))).alias("anchor"))
    return points.join(best, point_id, "left").withColumn("snapped", F.coalesce("anchor", at)).drop("anchor")


def steps(spans: DataFrame, keys: list[str], tag: str | None = None) -> DataFrame:
    """+1 at each start and -1 at each end, summed for equal places."""
    column = F.lit(1) if tag is None else F.lit(1).alias(tag)
    plus = spans.select(*keys, F.col("start").alias("t"), column.alias("change"))
    minus = spans.select(*keys, F.col("end").alias("t"), F.lit(-1).alias("change"))
    return plus.unionByName(minus).groupBy(*keys, "t", "change").agg(F.sum("change").alias("delta"))


def capacity(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest and least number of open spans; at one place ends come before starts."""
    w = Window.partitionBy(*keys).orderBy("t", "change").rowsBetween(Window.unboundedPreceding, 0)
    return steps(spans, keys).withColumn("open", F.sum("delta").over(w)).groupBy(*keys).agg(F.max("open").alias("most"), F.min("open").alias("least"))


def overlapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that start before the end of an earlier one of the same keys."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("before", F.max("end").over(w)).where(F.col("start") < F.col("before")).drop("before")


def union_length(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Length covered by at least one span."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(w)
    own = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.col("reach"), F.col("start"))))
    return spans.withColumn("reach", reach).groupBy(*keys).agg(F.sum(own).alias("covered"))


def disagreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Length where exactly one of the two tables has a span: one sweep over both."""
    a = steps(left, keys).select(*keys, "t", F.col("delta").alias("da"), F.lit(0).cast("long").alias("db"))
    b = steps(right, keys).select(*keys, "t", F.lit(0).cast("long").alias("da"), F.col("delta").alias("db"))
    at = a.unionByName(b).groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*keys).orderBy("t")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = at.select(*keys, "t", F.lead("t").over(order).alias("next"), F.sum("da").over(run).alias("na"), F.sum("db").over(run).alias("nb"))
    return swept.groupBy(*keys).agg(F.coalesce(F.sum(F.when((F.col("na") > 0) != (F.col("nb") > 0), F.col("next") - F.col("t"))), F.lit(0)).alias("differs"))


def by_period(spans: DataFrame, length: int) -> DataFrame:
    """One row per period of spans (p0, start, p1, end); inner edges are 0 and the period's length."""
    rows = spans.withColumn("period", F.explode(F.sequence("p0", "p1")))
    a = F.when(F.col("period") == F.col("p0"), F.col("start")).otherwise(F.lit(0))
    b = F.when(F.col("period") == F.col("p1"), F.col("end")).otherwise(F.lit(length))
    return rows.withColumns({"from": a, "to": b}).where(F.col("from") < F.col("to"))
