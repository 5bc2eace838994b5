"""Profiles: dominant role, eligibility, longest spell, mid-rank percentiles, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalars import eligibility
from ..sources.shared import materialised

#: Buckets of a group; two tables of a row for each group or bucket are sent with the tasks.
BUCKETS = 64


def dominant_role(role_time: DataFrame, keys: list[str], at_least: float = S.MIN_SHARE) -> DataFrame:
    """keys, largest role by (time, name), its share, and role where the share is large enough."""
    total = role_time.groupBy(*keys).agg(F.max_by("role", F.struct("time", "role")).alias("largest"), F.max("time").alias("most"), F.sum("time").alias("whole"))
    share = F.try_divide(F.col("most").cast("double"), F.col("whole").cast("double"))
    return total.select(*keys, "largest", F.coalesce(share, F.lit(0.0)).alias("share")).withColumn("role", F.when(F.col("share") >= at_least, F.col("largest")))


def with_eligibility(spells: DataFrame, at_least: float = S.MIN_MINUTES) -> DataFrame:
    """spells with reasons, eligible, and is_ref for the longest eligible spell of each entity and role."""
    out = spells.withColumn("reasons", eligibility(F.col("minutes"), F.col("partial"), F.col("role"), at_least))
    return longest_spell(out.withColumn("eligible", F.size("reasons") == 0))


def longest_spell(spells: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """is_ref: most minutes, then the smallest group, among the eligible spells of an entity in a role."""
    order = Window.partitionBy(*within, "role", "player_id").orderBy(F.desc("eligible"), F.desc("minutes"), "team_id")
    return spells.withColumn("is_ref", F.col("eligible") & (F.row_number().over(order) == 1))


def mid_rank(rows: DataFrame, group: list[str], value: str = "v", ref: str = "in_ref") -> DataFrame:
    """rows with n (size of the reference) and pct = 100 (less + equal / 2) / n within the group.

    Only rows flagged ref form the reference; others are ranked against it. Distinct values are
    counted first and dealt into buckets at quantiles of the group, so that skewed values fill them
    evenly; bucket totals are summed in order, then values within each bucket. So no window holds more
    than the distinct values of one bucket, and a group with most rows is dealt over many tasks.

    Rows meet the rank of their value by the value itself, which must not depend on how it is computed:
    values come from sums of whole numbers (see `statistics`).

    Cuts are approximate and depend on the order in which parts are merged, so they are written once: totals and places
    of values that were dealt by unlike cuts would not fit together.
    """
    v, r = F.col(value), F.col(ref) & F.col(value).isNotNull()
    counted = materialised(rows.where(v.isNotNull()).groupBy(*group, value).agg(F.count_if(r).alias("__eq")), "values")
    # a row for each group, which are as many as roles, metrics and sets of the configuration
    span = counted.groupBy(*group).agg(
        F.percentile_approx(value, F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)]), F.lit(10 * BUCKETS)).alias("__cuts"),
        F.sum("__eq").alias("n"),
        F.min(F.when(F.col("__eq") > 0, v)).alias("ref_lo"), F.max(F.when(F.col("__eq") > 0, v)).alias("ref_hi"),
    )
    span = materialised(span, "cuts")
    dealt = counted.join(F.broadcast(span), group).withColumn("__b", F.size(F.filter("__cuts", lambda c: c <= v))).drop("__cuts")
    total = dealt.groupBy(*group, "__b").agg(F.sum("__eq").alias("__t"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy(*group, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.join(F.broadcast(total), [*group, "__b"]).withColumn("__less", F.col("__before") + F.coalesce(F.sum("__eq").over(inside), F.lit(0)))
    pct = F.when((F.col("n") > 0) & (F.col("ref_lo") < F.col("ref_hi")), (F.col("__less") + F.col("__eq") * 0.5) * 100 / F.col("n"))
    ranked = ranked.select(*group, value, "n", pct.alias("pct"))
    return rows.join(ranked, [*group, value], "left")


def directed(metric: Column, pct: Column) -> Column:
    return F.when(metric.isin(S.LOWER_IS_BETTER), 100 - pct).otherwise(pct)


def metric_percentiles(long: DataFrame, min_peers: int = S.MIN_PEERS) -> DataFrame:
    """long (spell columns, metric, v, eligible, is_ref, role) with n, pct and status."""
    keeper_only = (F.col("role") == "GK") & ~F.col("metric").isin(S.KEEPER_METRICS)
    ranked = mid_rank(long.withColumn("in_ref", F.col("is_ref")), ["role", "metric"])
    described = F.col("metric").isin(S.MEANS) | F.coalesce(keeper_only, F.lit(False))
    status = (
        F.when(described, "DESCRIPTIVE_ONLY")
        .when(~F.col("eligible"), "INELIGIBLE_PROFILE")
        .when(F.col("v").isNull(), "MISSING_METRIC")
        .when(F.coalesce("n", F.lit(0)) < min_peers, "INSUFFICIENT_PEERS")
        .when(F.col("pct").isNull(), "CONSTANT_METRIC")
        .otherwise("AVAILABLE")
    )
    out = ranked.withColumn("status", status)
    peers = F.when(F.col("status").isin("AVAILABLE", "CONSTANT_METRIC", "INSUFFICIENT_PEERS"), F.coalesce("n", F.lit(0))).otherwise(0)
    return out.withColumns({"peer_count": peers, "percentile": F.when(F.col("status") == "AVAILABLE", directed(F.col("metric"), F.col("pct")))}).drop("n", "pct", "in_ref")


def common_percentiles(long: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Percentiles of each set's metrics on the set's own population, complete in all of its metrics.

    sets: columns `set`, `metric` (a few rows of configuration) and optionally `set_role`, or `keeper` for sets
    of keepers (true) or of all others.
    Result: keys, set, metric, v, is_ref, complete, in_ref, n, pct.
    """
    on = long["metric"] == sets["metric"]
    if "set_role" in sets.columns:
        on = on & (long["role"] == sets["set_role"])
    if "keeper" in sets.columns:
        on = on & (F.coalesce(long["role"] == "GK", F.lit(False)) == sets["keeper"])
    rows = long.join(F.broadcast(sets), on).drop(sets["metric"])
    whole = rows.groupBy(*keys, "set").agg((F.count("v") == F.count("*")).alias("complete"))
    rows = rows.join(whole, [*keys, "set"])
    rows = rows.withColumn("in_ref", F.col("is_ref") & F.col("complete"))
    return mid_rank(rows, ["role", "set", "metric"])


def category_scores(long: DataFrame, spark, min_peers: int = S.MIN_PEERS) -> DataFrame:
    """player, team, category, score, peer_count, status; keepers have categories of their own.

    A category without metrics has no data for it (UNSUPPORTED_DATA), whoever it is asked for.
    """
    keys = ["player_id", "team_id"]
    both = [(c, ms, k) for group, k in ((S.CATEGORIES, False), (S.KEEPER_CATEGORIES, True)) for c, ms in group.items()]
    sets = spark.createDataFrame([(c, m, len(ms), k) for c, ms, k in both for m in ms], "set string, metric string, parts int, keeper boolean")
    rows = common_percentiles(long, sets, keys)
    pct = directed(F.col("metric"), F.col("pct"))
    # components are added in their configured order, which fixes the float sum
    order = F.coalesce(*[F.when(F.col("set") == c, F.array_position(F.array(*map(F.lit, ms)), F.col("metric"))) for c, ms, _ in both if ms])
    agg = rows.groupBy("player_id", "team_id", "set").agg(
        F.first("role").alias("role"),
        F.first("eligible").alias("eligible"),
        F.first("complete").alias("complete"),
        F.max("n").alias("n"),
        F.count(pct).alias("known"),
        F.first("parts").alias("parts"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), pct.alias("p")))).alias("ps"),
    )
    total = F.aggregate("ps", F.lit(0.0), lambda acc, x: acc + x["p"])
    status = (
        F.when(~F.col("eligible"), "INELIGIBLE_PROFILE")
        .when(~F.col("complete"), "MISSING_COMPONENT")
        .when(F.coalesce("n", F.lit(0)) < min_peers, "INSUFFICIENT_PEERS")
        .when(F.col("known") < F.col("parts"), "CONSTANT_COMPONENT")
        .otherwise("AVAILABLE")
    )
    agg = agg.withColumn("status", status)
    scored = agg.select(
        "player_id",
        "team_id",
        F.col("set").alias("category"),
        F.when(F.col("status") == "AVAILABLE", total / F.col("parts")).alias("score"),
        F.when(F.col("status").isin("INELIGIBLE_PROFILE", "MISSING_COMPONENT"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("peer_count"),
        "status",
    )
    spells = long.select(*keys, (F.coalesce(F.col("role") == "GK", F.lit(False))).alias("keeper")).distinct()
    names = spark.createDataFrame([(c, k) for c, ms, k in both if not ms], "category string, keeper boolean")
    without = spells.join(F.broadcast(names), "keeper")
    empty = without.select(*keys, "category", F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("peer_count"), F.lit("UNSUPPORTED_DATA").alias("status"))
    return scored.unionByName(empty)


def top_of_each(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order; Spark cuts each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
