"""Order statistics and ranks of whole populations without a window over a population.

Both deal the rows of a group into buckets by value, so that a bucket holds about as many rows as any other, count the
buckets, and look closer only where it is needed. A value that many rows share is one row here, so ties make no bucket large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialised

#: Buckets of a group; tables of a row for each group or bucket are sent with the tasks.
BUCKETS = 64


def bucketed(rows: DataFrame, group: list[str], value: str, weight: Column, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct values with __n rows and bucket __b, groups with n rows and lo, hi, buckets with __before rows before them).

    NULL values are left out. Groups are as many as the configuration has.
    """
    v = F.col(value)
    # written once, as are the cuts: these are approximate, and must be the same wherever values are dealt by them
    counted = materialised(rows.where(v.isNotNull()).groupBy(*group, value).agg(weight.alias("__n")), "values")
    inside = F.when(F.col("__n") > 0, v)
    cuts = F.percentile_approx(value, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10 * buckets))
    span = counted.groupBy(*group).agg(cuts.alias("__cuts"), F.sum("__n").alias("n"), F.min(inside).alias("lo"), F.max(inside).alias("hi"))
    span = materialised(span, "cuts")
    dealt = counted.join(F.broadcast(span.select(*group, "__cuts")), group).withColumn("__b", F.size(F.filter("__cuts", lambda c: c <= v))).drop("__cuts")
    total = dealt.groupBy(*group, "__b").agg(F.sum("__n").alias("__t"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0)))
    return dealt, span.drop("__cuts"), total


def order_statistics(rows: DataFrame, group: list[str], value: str, wanted) -> DataFrame:
    """(group, n, at): the values at the wanted ranks (from 0) of each group, as a map from rank to value.

    wanted(n) is an array column of ranks for a group of n rows; ranks outside the group are left out. Only buckets that
    hold a wanted rank are sorted.
    """
    dealt, span, total = bucketed(rows, group, value, F.count("*"))
    hit = total.join(F.broadcast(span.select(*group, "n")), group)
    hit = hit.withColumn("__want", F.filter(wanted(F.col("n")), lambda i: (i >= F.col("__before")) & (i < F.col("__before") + F.col("__t")))).where(F.size("__want") > 0)
    near = dealt.join(F.broadcast(hit.select(*group, "__b", "n", "__before", "__want")), [*group, "__b"])
    inside = Window.partitionBy(*group, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("__less", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    found = near.withColumn("__i", F.explode(F.array_distinct(F.filter("__want", lambda i: (i >= F.col("__less")) & (i < F.col("__less") + F.col("__n"))))))
    # as many entries as ranks are wanted
    return found.groupBy(*group).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("__i").cast("int"), F.col(value)))).alias("at"))


def ranked(rows: DataFrame, group: list[str], value: str, ties: list[str], rank: str = "rank", limit: Column | None = None) -> DataFrame:
    """rows with the rank (from 1) by falling value, then by ties, which must make the order total.

    limit: only ranks up to it (a column of the group) are kept; whole buckets beyond it go before any sort. The rows of
    one value are one bucket's at most; equal values are told apart by ties inside it.
    """
    dealt, span, total = bucketed(rows, group, value, F.count("*"))
    # buckets count from the largest value here
    total = total.join(F.broadcast(span.select(*group, "n")), group).withColumn("__ahead", F.col("n") - F.col("__before") - F.col("__t"))
    cuts = dealt.groupBy(*group, "__b").agg(F.min(value).alias("__from"))
    edges = total.join(cuts, [*group, "__b"]).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__from", "__ahead"))).alias("__edges"))
    place = F.element_at(F.filter("__edges", lambda e: e["__from"] <= F.col(value)), -1)
    rows = rows.where(F.col(value).isNotNull()).join(F.broadcast(edges), group).withColumn("__p", place).drop("__edges")
    rows = rows.withColumns({"__ahead": F.col("__p.__ahead")}).drop("__p")
    if limit is not None:
        rows = rows.where(F.col("__ahead") < limit)
    inside = Window.partitionBy(*group, "__ahead").orderBy(F.desc(value), *ties)
    rows = rows.withColumn(rank, (F.col("__ahead") + F.row_number().over(inside)).cast("int")).drop("__ahead")
    return rows if limit is None else rows.where(F.col(rank) <= limit)
