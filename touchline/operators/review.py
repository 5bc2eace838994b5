"""Audit of human review records against a frozen list of cases and fixtures.

reviews: a row for each case: case, kind (pair or candidate), review_status, ratings
(pair_similarity, requirement_fit, agreement), reviewer, summary, review_date, seen_model, confidence,
disagreement_reason. sources: a row for each watched source of a case: case, source_id, player_id, team_id, match_id,
content_kind, reference, intervals (array of start, end), points (array of timestamp, replay_seconds).
cases: case, player_id, team_id of the players in question. fixtures: player_id, team_id, match_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import codes
from .contracts import empty
from .intervals import union_length

STATUSES = ["NOT_PERFORMED", "NOT_ASSESSABLE", "LIMITED", "COMPLETED"]
RATINGS = ["pair_similarity", "requirement_fit", "agreement"]
#: Fixtures of so many minutes, and how many of them make a review substantial.
MINUTES, FIXTURES = 60, 2


def replay_seconds(timestamp: Column) -> Column:
    """Seconds of H:MM:SS or M:SS; NULL for anything else and for minutes or seconds from 60 on."""
    part = F.split(timestamp, ":")
    ok = timestamp.rlike(r"^\d+:[0-5]\d(:[0-5]\d)?$")
    return F.when(ok, F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc * 60 + x.try_cast("long")))


def record_issues(reviews: DataFrame) -> DataFrame:
    """case and the codes of what is wrong with its record."""
    c = F.col
    rated = F.coalesce(*[F.when(c(r).isNotNull(), F.lit(True)) for r in RATINGS], F.lit(False))
    done = c("review_status") != "NOT_PERFORMED"
    active = c("review_status").isin("LIMITED", "COMPLETED") | rated
    other = F.when(c("kind") == "pair", c("requirement_fit")).otherwise(c("pair_similarity"))
    found = [
        (~F.coalesce(c("review_status").isin(STATUSES), F.lit(False)), "UNKNOWN_STATUS"),
        (F.coalesce(*[F.when(~c(r).between(1, 5), F.lit(True)) for r in RATINGS], F.lit(False)), "RATING_OUT_OF_RANGE"),
        (other.isNotNull(), "RATING_OF_ANOTHER_KIND"),
        (rated & c("review_status").isin("NOT_PERFORMED", "NOT_ASSESSABLE"), "RATING_WITHOUT_REVIEW"),
        (done & (empty("reviewer") | empty("summary")), "TEXT_MISSING"),
        (done & F.coalesce(F.date_format(c("review_date").try_cast("date"), "yyyy-MM-dd") != c("review_date"), F.lit(True)), "BAD_DATE"),
        (done & c("seen_model").isNull(), "DISCLOSURE_MISSING"),
        (active & ~F.coalesce(c("confidence").isin("low", "medium", "high"), F.lit(False)), "BAD_CONFIDENCE"),
        (c("agreement").isNotNull() & empty("disagreement_reason"), "REASON_MISSING"),
    ]
    return reviews.select("case", codes([(F.coalesce(bad, F.lit(False)), code) for bad, code in found]).alias("issues"))


def source_issues(sources: DataFrame, cases: DataFrame, fixtures: DataFrame) -> DataFrame:
    """case, source_id and the codes of what is wrong with a watched source."""
    own = cases.select("case", "player_id", "team_id").distinct().withColumn("belongs", F.lit(True))
    frozen = fixtures.select("player_id", "team_id", "match_id").distinct().withColumn("frozen", F.lit(True))
    twice = sources.groupBy("case", "source_id").agg((F.count("*") > 1).alias("twice"))
    rows = sources.join(own, ["case", "player_id", "team_id"], "left").join(frozen, ["player_id", "team_id", "match_id"], "left").join(twice, ["case", "source_id"], "left")
    none = F.lit(False)
    backward = F.exists("intervals", lambda i: ~F.coalesce((i["start"] >= 0) & (i["end"] > i["start"]), none))
    clocks = F.exists(F.coalesce("points", F.array().cast("array<struct<timestamp:string,replay_seconds:bigint>>")), lambda p: ~F.coalesce(replay_seconds(p["timestamp"]) == p["replay_seconds"], none))
    found = [
        (empty("source_id") | F.col("twice"), "SOURCE_ID_NOT_UNIQUE"),
        (F.col("belongs").isNull(), "PLAYER_OF_ANOTHER_CASE"),
        (F.col("frozen").isNull(), "FIXTURE_NOT_IN_THE_PACK"),
        (empty("reference"), "TEXT_MISSING"),
        (~F.coalesce(F.col("content_kind").isin("full_match", "highlights"), none), "BAD_CONTENT_KIND"),
        (F.coalesce(F.size("intervals") == 0, F.lit(True)) & (F.coalesce(F.size("points"), F.lit(0)) <= 0), "INTERVALS_MISSING"),
        (backward, "BAD_INTERVAL"),
        (clocks, "CLOCK_DISAGREES"),
    ]
    return rows.select("case", "source_id", codes([(F.coalesce(bad, none), code) for bad, code in found]).alias("issues"))


def coverage(sources: DataFrame, cases: DataFrame, fixtures: DataFrame) -> DataFrame:
    """case, player_id, team_id, fixtures (of MINUTES and more), substantial: watched time without overlaps.

    Editions of one fixture are not added up, the longest counts; highlights count as nothing.
    """
    keys = ["case", "player_id", "team_id", "match_id"]
    good = sources.join(cases, ["case", "player_id", "team_id"], "left_semi").join(fixtures, ["player_id", "team_id", "match_id"], "left_semi").where("content_kind = 'full_match'")
    spans = good.select(*keys, "source_id", F.explode("intervals").alias("i")).select(*keys, "source_id", "i.start", "i.end").where("start >= 0 and end > start")
    each = union_length(spans, [*keys, "source_id"]).groupBy(*keys).agg(F.max("covered").alias("seconds"))
    total = each.groupBy("case", "player_id", "team_id").agg(F.count_if(F.col("seconds") >= 60 * MINUTES).alias("fixtures"), F.sum(F.col("seconds") / 60).alias("minutes"))
    rows = cases.select("case", "player_id", "team_id").distinct().join(total, ["case", "player_id", "team_id"], "left").fillna(0, ["fixtures", "minutes"])
    return rows.withColumn("substantial", F.col("fixtures") >= FIXTURES)


def case_coverage(reviews: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases without a record, and records of no case."""
    a, b = reviews.select("case").distinct().withColumn("record", F.lit(1)), cases.select("case").distinct().withColumn("known", F.lit(1))
    rows = a.join(b, "case", "full")
    return rows.where("record is null or known is null").select("case", F.when(F.col("record").isNull(), "MISSING_RECORD").otherwise("UNEXPECTED_CASE").alias("code"))
