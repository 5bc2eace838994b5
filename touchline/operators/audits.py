"""Audits as expectations: every rule of a table is evaluated in one pass over the table.

A rule is a code and the condition of a violation; a condition that is unknown is none. What a rule needs to know from other
rows or tables is joined or counted before, as columns. The counts of all rules are observed over all rows in the pass that
writes the rows that violate something, with their codes; no others are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalars import codes
from ..sources.shared import materialised
from . import intervals as I

C = F.col


@dataclass
class Audited:
    """violations: the rows that violate something, with codes; counts: rows, and violations by code, as observed."""

    name: str
    violations: DataFrame
    counts: dict[str, int]


def audited(df: DataFrame, rules: list[tuple[str, Column]], name: str) -> Audited:
    """One pass over df that counts all rules and writes what violates them."""
    found = [(code, F.coalesce(bad, F.lit(False))) for code, bad in rules]
    seen = Observation(name)
    rows = df.withColumn("violations", codes([(bad, code) for code, bad in found]))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(code) for code, bad in found])
    return Audited(name, materialised(rows.where(F.size("violations") > 0), name), dict(seen.get))


def census(spark, audits: list[Audited]) -> DataFrame:
    """audit, rule, rows, violations: a row for each rule."""
    rows = [(a.name, code, a.counts["rows"], n) for a in audits for code, n in a.counts.items() if code != "rows"]
    return spark.createDataFrame(rows, "audit string, rule string, rows long, violations long")


def require(audits: list[Audited]) -> None:
    """Raise where any rule is violated, naming rules and numbers of rows."""
    wrong = [f"{a.name}: {code} {n}" for a in audits for code, n in a.counts.items() if code != "rows" and n]
    if wrong:
        raise ValueError("; ".join(wrong))


def apart(a: Column, b: Column, by: float = 1e-6) -> Column:
    """Unequal by more than a tolerance, or known on one side only."""
    return (a.isNull() != b.isNull()) | (F.abs(a - b) > by)


def copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `copies`, the number of rows of its key: counted first, so that a repeated key is no window.

    There are as many counts as keys, and the size of rows made by an explode is estimated as that of the rows before, so
    the counts are merged by a shuffle and never gathered on the driver to be sent with the tasks.
    """
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("copies")).hint("merge"), keys, "left")


def copies_in_place(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same for rows that are dealt by some of the keys already: they are counted where they are and cross no shuffle.

    A key that is repeated often is a long run of one sort, which goes to disk where it doesn't fit.
    """
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(*keys)))


def canonical(events: DataFrame, roster: DataFrame, matches: DataFrame) -> list[Audited]:
    """events: match_id, event_id, index, player_id, team_id; roster: match_id, team_id, player_id; matches: match_id and both teams."""
    teams = matches.select("match_id", F.explode(F.array_distinct(F.array("home_team_id", "away_team_id"))).alias("team_id"), F.lit(True).alias("of_match"))
    seats = roster.select("match_id", "player_id", "team_id").distinct().withColumn("listed", F.lit(True))
    known = matches.select("match_id").distinct().withColumn("known", F.lit(True))
    rows = copies(events, ["event_id"]).join(known, "match_id", "left").join(teams, ["match_id", "team_id"], "left").join(seats, ["match_id", "player_id", "team_id"], "left")
    # a match is a bounded session
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("match_id").orderBy("index", "event_id")))
    least = events.groupBy("match_id").agg(F.min("index").alias("least"))
    rows = rows.join(least, "match_id", "left")
    yes = lambda name: F.coalesce(C(name), F.lit(False))
    ours = audited(rows, [
        ("DUPLICATE_EVENT", C("copies") > 1), ("UNKNOWN_MATCH", ~yes("known")), ("FOREIGN_TEAM", C("team_id").isNotNull() & yes("known") & ~yes("of_match")),
        ("PLAYER_NOT_LISTED", C("player_id").isNotNull() & ~yes("listed")), ("BROKEN_INDEX", C("index") != C("least") + C("place") - 1),
    ], "canonical events")
    keys = events.select("match_id", F.lit(1).alias("e"), F.lit(0).alias("r")).unionByName(roster.select("match_id", F.lit(0).alias("e"), F.lit(1).alias("r")))
    keys = keys.groupBy("match_id").agg(F.max("e").alias("e"), F.max("r").alias("r"))
    return [ours, audited(keys, [("EVENTS_WITHOUT_SHEET", (C("e") == 1) & (C("r") == 0)), ("SHEET_WITHOUT_EVENTS", (C("e") == 0) & (C("r") == 1))], "canonical coverage")]


def minutes(appearances: DataFrame, periods: DataFrame, presence: DataFrame, positions: DataFrame, edge: float = S.EDGE, capacity: int = 11) -> list[Audited]:
    """appearances: match_id, player_id, team_id, quality_status, playing_seconds, nominal_minutes; periods: match_id, period, duration.

    presence and positions: match_id, team_id, player_id, period, start, end.
    """
    person, half = ["match_id", "player_id"], ["match_id", "player_id", "period"]
    own = ["match_id", "team_id", "player_id", "period", "start", "end"]
    spans = presence.select(F.lit("presence").alias("kind"), *own).unionByName(positions.select(F.lit("positions").alias("kind"), *own))
    app = appearances.groupBy(*person).agg(F.min("team_id").alias("app_team"), F.min("quality_status").alias("app_status"))
    before = Window.partitionBy("kind", *half).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.join(app, person, "left").join(periods, ["match_id", "period"], "left").withColumn("reach", F.max("end").over(before))
    good = F.coalesce(C("app_status") == "VALIDATED", F.lit(False))
    first = audited(rows, [
        ("UNVALIDATED_INTERVAL", ~good), ("OTHER_TEAM", C("app_team") != C("team_id")),
        ("OUTSIDE_PERIOD", C("duration").isNull() | (C("start") < 0) | (C("end") > C("duration"))), ("NOT_POSITIVE", C("end") <= C("start")),
        ("OVERLAP", C("start") < C("reach") - edge),
    ], "minutes intervals")
    total = lambda df, name: df.groupBy(*person).agg(F.sum(C("end") - C("start")).alias(name))
    base = F.coalesce(*[F.when(C("period") == p, F.lit(x)) for p, x in S.NOMINAL_SECONDS.items()])
    nominal = presence.groupBy(*person).agg((F.sum(F.greatest(F.lit(0.0), F.least("end", base) - F.least("start", base))) / 60).alias("nominal"))
    gap = I.disagreement(presence, positions, half).groupBy(*person).agg(F.sum("differs").alias("gap"))
    rows = copies(appearances, person).join(total(presence, "present"), person, "left").join(total(positions, "placed"), person, "left").join(nominal, person, "left").join(gap, person, "left")
    valid = C("quality_status") == "VALIDATED"
    zero = lambda name: F.coalesce(C(name).cast("double"), F.lit(0.0))
    second = audited(rows, [
        ("DUPLICATE_APPEARANCE", C("copies") > 1), ("PRESENCE_TOTAL", valid & apart(C("playing_seconds").cast("double"), zero("present"), edge)),
        ("POSITION_TOTAL", valid & apart(C("playing_seconds").cast("double"), zero("placed"), edge)), ("NOMINAL_TOTAL", valid & apart(C("nominal_minutes"), zero("nominal"), edge)),
        ("TIMELINE", valid & (zero("gap") > edge)), ("QUARANTINED_MINUTES", ~valid & (C("playing_seconds").isNotNull() | C("nominal_minutes").isNotNull())),
    ], "minutes appearances")
    rows = I.capacity(presence, ["match_id", "team_id", "period"])
    return [first, second, audited(rows, [("OVER_CAPACITY", (C("most") > capacity) | (C("least") < 0))], "minutes capacity")]


def features(sessions: DataFrame, exposure: DataFrame, seasons: DataFrame, min_minutes: float = S.MIN_MINUTES) -> list[Audited]:
    """sessions: player, team, match, metric, numerator, samples, missing, seconds; exposure: player, team, match, seconds of validated ones.

    seasons: player, team, metric, numerator, samples, missing, minutes, value, per90, enough (is the threshold met?).
    """
    spell, session = ["player_id", "team_id"], ["player_id", "team_id", "match_id"]
    rows = copies_in_place(sessions, [*session, "metric"]).join(exposure.select(*session, C("seconds").alias("validated")), session, "full")
    first = audited(rows, [
        ("DUPLICATE_ROW", C("copies") > 1), ("NOT_VALIDATED", C("metric").isNotNull() & C("validated").isNull()), ("WITHOUT_FEATURES", C("metric").isNull()),
        ("EXPOSURE", apart(C("seconds"), C("validated"), 0) & C("metric").isNotNull() & C("validated").isNotNull()),
        ("MISSING_ABOVE_SAMPLES", C("missing") > C("samples")), ("UNKNOWN_METRIC", ~C("metric").isin(S.METRICS)),
    ], "features of sessions")
    again = sessions.groupBy(*spell, "metric").agg(F.sum("numerator").alias("n_sum"), F.sum("samples").alias("s_sum"), F.sum("missing").alias("m_sum"), (F.sum("seconds") / 60).alias("t_sum"))
    rows = copies(seasons, [*spell, "metric"]).join(again, [*spell, "metric"], "full")
    ratio, whole = C("metric").isin(S.MEANS + S.PERCENTAGES), C("missing") == 0
    percent = F.when(C("metric").isin(S.PERCENTAGES), 100.0).otherwise(1.0)
    value = F.when(whole, F.when(ratio, F.when(C("samples") > 0, C("numerator") * percent / C("samples"))).otherwise(C("numerator")))
    per90 = F.when(whole & ~ratio & (C("minutes") > 0), C("numerator") * 90 / C("minutes"))
    given = C("copies").isNotNull() & C("s_sum").isNotNull()
    second = audited(rows, [
        ("DUPLICATE_ROW", C("copies") > 1), ("COVERAGE", C("copies").isNull() | C("s_sum").isNull()), ("MISSING_ABOVE_SAMPLES", C("missing") > C("samples")),
        ("AGGREGATION", given & (apart(C("numerator"), C("n_sum")) | (C("samples") != C("s_sum")) | (C("missing") != C("m_sum")))),
        ("MINUTES", given & apart(C("minutes"), C("t_sum"))), ("VALUE", apart(C("value"), value)), ("RATE", apart(C("per90"), per90)),
        ("THRESHOLD", C("enough") != (C("minutes") >= min_minutes)),
    ], "features of seasons")
    return [first, second]


def profile_inputs(rows: DataFrame, role_seconds: DataFrame, convention: str, edge: float = S.EDGE) -> list[Audited]:
    """What profiles are built from. rows: player, team, playing_seconds, minutes_convention; role_seconds: player, team, role, seconds."""
    keys = ["player_id", "team_id"]
    bad = ~F.coalesce((C("seconds") >= 0) & (C("seconds") < float("inf")), F.lit(False))
    each = role_seconds.groupBy(*keys).agg(F.sum("seconds").alias("whole"), F.count_if(bad).alias("bad"), F.count_if(~F.coalesce(C("role").isin(list(S.ROLES)), F.lit(False))).alias("foreign"))
    found = copies(rows, keys).join(each, keys, "left")
    return [audited(found, [
        ("DUPLICATE_IDENTITY", C("copies") > 1), ("ROLE_SECONDS", apart(F.coalesce("whole", F.lit(0.0)), C("playing_seconds"), edge)), ("INVALID_SECONDS", C("bad") > 0),
        ("UNKNOWN_ROLE", C("foreign") > 0), ("NO_EXPOSURE", ~F.coalesce(C("playing_seconds") > 0, F.lit(False))), ("CONVENTION", ~C("minutes_convention").eqNullSafe(F.lit(convention))),
    ], "profile inputs")]


def profiles(spells: DataFrame, percentiles: DataFrame, min_minutes: float = S.MIN_MINUTES, min_share: float = S.MIN_SHARE, min_peers: int = S.MIN_PEERS) -> list[Audited]:
    """spells: player, team, role, largest, share, minutes, partial, reasons, eligible, is_ref; percentiles: player, team, role, metric, v, status, percentile, peer_count."""
    keys = ["player_id", "team_id"]
    double = spells.where("is_ref").groupBy("role", "player_id").agg(F.count("*").alias("refs"))
    rows = copies(spells, keys).join(double, ["role", "player_id"], "left")
    says = lambda code: F.array_contains("reasons", code)
    first = audited(rows, [
        ("DUPLICATE_PROFILE", C("copies") > 1), ("UNKNOWN_ROLE", C("role").isNotNull() & ~C("role").isin(list(S.ROLES))), ("ROLE_SHARE", C("role").isNotNull() & (C("share") < min_share)),
        ("ROLE_LEFT_OUT", C("role").isNull() & (C("share") >= min_share)), ("PARTIAL_FLAG", C("partial") != says("PARTIAL_PLAYER_SEASON")),
        ("MINUTES_FLAG", (C("minutes") < min_minutes) != says("BELOW_MINIMUM_MINUTES")), ("ROLE_FLAG", C("role").isNull() != says("MIXED_POSITION_USAGE")),
        ("ELIGIBLE_FLAG", C("eligible") != (F.size("reasons") == 0)), ("REFERENCE_NOT_ELIGIBLE", C("is_ref") & ~C("eligible")), ("DOUBLE_REFERENCE", C("is_ref") & (C("refs") > 1)),
    ], "profiles")
    peers = spells.where("is_ref").select(*keys, F.lit(True).alias("ref")).join(percentiles.where("v is not null").select(*keys, "role", "metric"), keys)
    peers = peers.groupBy("role", "metric").agg(F.count("*").alias("peers"))
    rows = percentiles.join(peers, ["role", "metric"], "left")
    shown = C("status") == "AVAILABLE"
    second = audited(rows, [
        ("OUTSIDE", (C("percentile") < 0) | (C("percentile") > 100)), ("STATUS", shown != C("percentile").isNotNull()), ("FEW_PEERS", shown & (C("peer_count") < min_peers)),
        ("PEER_COUNT", shown & (C("peer_count") != F.coalesce("peers", F.lit(0)))), ("VALUE", shown & C("v").isNull()),
    ], "percentiles")
    return [first, second]


def neighbours(found, spells: DataFrame) -> list[Audited]:
    """found: a `similarity.Search`; spells: player, team, role, eligible."""
    who = [*("scenario", "role"), "player_id", "team_id"]
    parts = found.explained().groupBy(*who, "rank").agg(F.sum("contribution").alias("parts"), F.count_if(C("peer_value").isNull()).alias("holes"))
    peer = spells.select(C("player_id").alias("peer_id"), C("team_id").alias("peer_team"), C("role").alias("peer_role"), C("eligible").alias("peer_ok"))
    order = Window.partitionBy(*who).orderBy("rank")  # at most top_k rows
    rows = found.near.join(parts, [*who, "rank"], "left").join(peer, ["peer_id", "peer_team"], "left")
    rows = rows.withColumns({"last": F.lag("distance").over(order), "place": F.row_number().over(order), "twice": F.count("*").over(Window.partitionBy(*who, "peer_id"))})
    square = C("distance") * C("distance")
    return [audited(rows, [
        ("DUPLICATE_NEIGHBOUR", C("twice") > 1), ("ORDER", (C("distance") < C("last")) | (C("rank") != C("place"))), ("COHORT", ~F.coalesce(C("peer_ok") & (C("peer_role") == C("role")), F.lit(False))),
        ("SELF", C("peer_id") == C("player_id")), ("INCOMPLETE", C("holes") > 0), ("CONTRIBUTIONS", F.abs(C("parts") - square) > 1e-12 + 1e-9 * square),
    ], "neighbours")]


def rankings(rows: DataFrame, parts: DataFrame, requirements: DataFrame, spells: DataFrame) -> list[Audited]:
    """rows: set, player, team, minutes, score, rank; parts: set, player, team, metric, weight, contribution; requirements as in `ranking`."""
    keys = ["set", "player_id", "team_id"]
    whole = parts.groupBy(*keys).agg(F.sum("contribution").alias("parts_sum"), F.sum("weight").alias("weights"), F.count_distinct("metric").alias("metrics"))
    asked = requirements.groupBy("set").agg(F.first("set_role").alias("set_role"), F.first("min_minutes").alias("least"), F.first("excluded").alias("excluded"), F.count_distinct("metric").alias("wanted"), F.first("top_k").alias("k"))
    order = Window.partitionBy("set").orderBy("rank")  # at most top_k rows
    found = rows.select(*keys, "minutes", "score", "rank").join(whole, keys, "left").join(F.broadcast(asked), "set").join(spells.select("player_id", "team_id", "role", "eligible"), ["player_id", "team_id"], "left")
    found = found.where(C("rank") <= C("k")).withColumns({"last": F.lag("score").over(order), "place": F.row_number().over(order), "twice": F.count("*").over(Window.partitionBy("set", "player_id"))})
    return [audited(found, [
        ("DUPLICATE_CANDIDATE", C("twice") > 1), ("ORDER", (C("score") > C("last")) | (C("rank") != C("place"))), ("COHORT", ~F.coalesce(C("eligible") & (C("role") == C("set_role")), F.lit(False))),
        ("MINUTES", C("minutes") < C("least")), ("EXCLUDED_TEAM", F.array_contains("excluded", C("team_id"))), ("COMPONENTS", F.coalesce(C("metrics"), F.lit(0)) != C("wanted")),
        ("CONTRIBUTIONS", F.abs(C("parts_sum") - C("score")) > 1e-9), ("WEIGHTS", F.abs(C("weights") - 1) > 1e-9), ("SCORE_OUTSIDE", (C("score") < 0) | (C("score") > 100)),
    ], "rankings")]
