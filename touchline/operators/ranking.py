"""Weighted requirement rankings over a common complete population, with contributions and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..sources.shared import materialised
from .order import ranked as by_order
from .profiles import common_percentiles, directed

REQUIREMENT_SCHEMA = "set string, set_role string, metric string, weight double, place int, parts int, min_minutes double, top_k int, excluded array<long>"


def requirement_rows(name: str, role: str, weights: dict[str, float], min_minutes: float = S.MIN_MINUTES, top_k: int = S.TOP_K, excluded: tuple[int, ...] = ()) -> list[tuple]:
    w = S.normalized(weights)
    return [(name, role, m, x, i, len(w), float(min_minutes), top_k, list(excluded)) for i, (m, x) in enumerate(w.items())]


def requirement_table(spark, requirements: list[list[tuple]]) -> DataFrame:
    """Configuration rows of all requirements: a few dozen."""
    return spark.createDataFrame([r for rows in requirements for r in rows], REQUIREMENT_SCHEMA)


def components(long: DataFrame, requirements: DataFrame) -> DataFrame:
    """A row per reference spell, requirement and metric: v, percentile, weight, contribution."""
    rows = common_percentiles(long.where("is_ref"), requirements, ["player_id", "team_id"])
    pct = directed(F.col("metric"), F.col("pct"))
    return rows.withColumn("percentile", pct).withColumn("contribution", F.col("weight") * F.col("percentile"))


def check_requirement(requirement: dict) -> None:
    """Errors of a requirement: weights, minutes and top_k that cannot be meant, unknown metrics or role."""
    S.normalized(requirement["weights"])
    role, metrics = requirement["role"], set(requirement["weights"])
    if role not in S.ROLES:
        raise ValueError(f"there is no role {role}")
    if wrong := sorted(metrics - set(rankable(role))):
        raise ValueError(f"not ranked for {role}: {', '.join(wrong)}")
    if not 0 <= requirement.get("min_minutes", S.MIN_MINUTES) < float("inf"):
        raise ValueError("minutes must be finite and not negative")
    top_k = requirement.get("top_k", S.TOP_K)
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 100:
        raise ValueError("top_k must be an integer from 1 to 100")


def rankable(role: str) -> list[str]:
    """Metrics that a role can be ranked by: no mean positions, and for keepers only their own."""
    return [m for m in S.METRICS if m not in S.MEANS and (role != "GK" or m in S.KEEPER_METRICS)]


def ranked(long: DataFrame, requirements: DataFrame, min_peers: int = S.MIN_PEERS, cut: bool = False) -> tuple[DataFrame, DataFrame]:
    """(status of each requirement, candidates with score and rank; with cut only the first top_k of each).

    Percentiles come from the reference; minutes and teams filter candidates afterwards. Ranks come from buckets of scores
    with counts before them, so no window holds the candidates of a requirement; with cut, buckets that begin behind the
    top_k of their requirement are left out before anything is sorted.
    """
    parts = components(long, requirements)
    each = parts.groupBy("set", "player_id", "team_id").agg(
        F.first("role").alias("role"),
        F.first("complete").alias("complete"),
        F.first("minutes").alias("minutes"),
        F.first("min_minutes").alias("min_minutes"),
        F.first("excluded").alias("excluded"),
        F.first("top_k").alias("top_k"),
        F.first("parts").alias("parts"),
        F.count("percentile").alias("known"),
        F.array_sort(F.collect_list(F.struct("place", "contribution"))).alias("cs"),
    )
    score = F.aggregate("cs", F.lit(0.0), lambda acc, x: acc + x["contribution"])
    each = each.withColumns({"score": score, "candidate": F.col("complete") & (F.col("minutes") >= F.col("min_minutes")) & ~F.array_contains("excluded", F.col("team_id"))})
    each = materialised(each.drop("cs"), "scores")
    summary = each.groupBy("set").agg(
        F.count_if("complete").alias("peer_count"),
        F.count_if(F.col("complete") & (F.col("known") < F.col("parts"))).alias("unranked"),
        F.count_if("candidate").alias("passing"),
    )
    names = requirements.select(F.col("set"), F.col("set_role").alias("role"), "top_k").distinct()
    summary = names.join(summary, "set", "left").fillna(0, ["peer_count", "unranked", "passing"])
    status = F.when(F.col("peer_count") < min_peers, "INSUFFICIENT_PEERS").when(F.col("unranked") > 0, "CONSTANT_COMPONENT").when(F.col("passing") > 0, "AVAILABLE").otherwise("NO_CANDIDATES")
    summary = summary.withColumn("status", status)
    summary = summary.withColumn("candidate_count", F.when(F.col("status") == "AVAILABLE", F.col("passing")).otherwise(0))
    summary = summary.withColumn("warnings", F.array_compact(F.array(F.when((F.col("candidate_count") < F.col("top_k")) & F.col("status").isin("AVAILABLE", "NO_CANDIDATES"), F.lit("FEWER_CANDIDATES_THAN_REQUESTED")))))
    good = summary.where("status = 'AVAILABLE'").select("set")
    rows = each.where("candidate").join(F.broadcast(good), "set")
    rows = by_order(rows, ["set"], "score", ["player_id", "team_id"], limit=F.col("top_k") if cut else None)
    return summary.select("set", "role", "status", "peer_count", "candidate_count", "top_k", "warnings"), rows.select("set", "player_id", "team_id", "minutes", "score", "rank", "top_k")


def exclusions(spells: DataFrame, long: DataFrame, requirements: DataFrame) -> DataFrame:
    """set, player, team, reasons, missing_metrics for every spell that is no candidate."""
    names = requirements.select("set", "set_role", "min_minutes", "excluded").distinct()
    all_rows = spells.select("player_id", "team_id", "role", "minutes", "eligible", "is_ref", "reasons").join(F.broadcast(names))
    miss = long.where("is_ref and v is null").join(F.broadcast(requirements.select("set", "set_role", "metric")), "metric").where("role = set_role")
    miss = miss.groupBy("set", "player_id", "team_id").agg(F.array_sort(F.collect_set("metric")).alias("missing_metrics"))
    rows = all_rows.join(miss, ["set", "player_id", "team_id"], "left")
    wrong = ~F.coalesce(F.col("role") == F.col("set_role"), F.lit(False))
    late = F.array_compact(F.array(F.when(F.col("minutes") < F.col("min_minutes"), F.lit("BELOW_REQUIREMENT_MINUTES")), F.when(F.array_contains("excluded", F.col("team_id")), F.lit("EXCLUDED_TEAM"))))
    why = (
        F.when(wrong, F.array(F.lit("NOT_REQUESTED_POSITION")))
        .when(~F.col("eligible"), F.col("reasons"))
        .when(~F.col("is_ref"), F.array(F.lit("SHORTER_OR_TIED_TEAM_SPELL")))
        .when(F.col("missing_metrics").isNotNull(), F.array(F.lit("MISSING_REQUIRED_METRICS")))
        .otherwise(late)
    )
    shown = F.when(~wrong & F.col("eligible") & F.col("is_ref"), F.col("missing_metrics"))
    return rows.withColumn("why", why).where(F.size("why") > 0).select("set", "player_id", "team_id", F.array_join("why", ",").alias("reasons"), F.array_join(shown, ",").alias("missing_metrics"))
