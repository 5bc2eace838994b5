"""Quality of appearances: match records are checked, presence is rebuilt and held against three other sources.

All steps are DataFrames keyed by match (and team, player or period) and give rows (match_id, team_id,
player_id, period, event_id, code, severity). An error without a player is fatal for its match.

events: match_id, event_id, index, period, elapsed, event_type, team_id, player_id, replacement_id, card,
permanent, boundary_flags, quality_flags, tactical (array of player_id, position_name).
roster: match_id, team_id, player_id. positions: match_id, team_id, player_id, position_id,
position_name, start, end (period, elapsed; end may be null), quality_flags. cards: match_id, player_id,
card_type, time (period, elapsed; null when unknown).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..sources.shared import materialised
from . import intervals as I
from .presence import CAPACITY_CODE, move_of, presence

ISSUE = ["match_id", "team_id", "player_id", "period", "event_id", "code", "severity"]
PLAYER = ["match_id", "player_id"]
BY_PERIOD = [*PLAYER, "period"]


def _issues(rows: DataFrame, code: str | Column, severity: str | Column = "error") -> DataFrame:
    """Issue rows with NULL for the keys that rows lacks."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    kind = {"match_id": "string", "team_id": "long", "player_id": "long", "period": "int", "event_id": "string"}
    own = [(F.col(k) if k in rows.columns else F.lit(None)).cast(t).alias(k) for k, t in kind.items()]
    return rows.select(*own, as_column(code).alias("code"), as_column(severity).alias("severity"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def boundaries(events: DataFrame, roster: DataFrame) -> DataFrame:
    """match_id, period, duration (null when the period's ends are unreliable), late: an event after the end."""
    teams = roster.groupBy("match_id").agg(F.collect_set("team_id").alias("teams"))
    start, end = F.col("event_type") == "Half Start", F.col("event_type") == "Half End"
    plain = F.size(F.coalesce("boundary_flags", F.array())) == 0
    each = events.where("period < 5").groupBy("match_id", "period").agg(
        F.count_if(start).alias("starts"),
        F.count_if(end).alias("ends"),
        F.collect_set(F.when(start, F.col("team_id"))).alias("start_teams"),
        F.collect_set(F.when(end, F.col("team_id"))).alias("end_teams"),
        F.bool_and(F.when(start, (F.col("elapsed") == 0) & plain).when(end, plain).otherwise(True)).alias("clean"),
        F.min(F.when(end, F.col("elapsed"))).alias("first_end"),
        F.max(F.when(end, F.col("elapsed"))).alias("last_end"),
        F.max("elapsed").alias("latest"),
    )
    same = lambda a: F.array_sort(a) == F.array_sort(F.col("teams"))
    good = (F.col("starts") == 2) & (F.col("ends") == 2) & same(F.col("start_teams")) & same(F.col("end_teams")) & F.col("clean") & (F.col("first_end") == F.col("last_end")) & (F.col("first_end") > 0)
    out = each.join(teams, "match_id").withColumn("duration", F.when(F.coalesce(good, F.lit(False)), F.col("first_end")))
    return out.select("match_id", "period", "duration", (F.col("latest") > F.col("duration") + S.EDGE).alias("late"))


def line_ups(events: DataFrame, roster: DataFrame) -> DataFrame:
    """match_id, team_id, xis (line-ups at the start), players, code (null when there are eleven)."""
    xi = events.where(F.col("event_type") == "Starting XI").groupBy("match_id", "team_id").agg(
        F.count("*").alias("xis"),
        F.bool_and((F.col("period") == 1) & (F.col("elapsed") == 0)).alias("at_start"),
        F.first("tactical").alias("players"),
    )
    rows = roster.select("match_id", "team_id").distinct().join(xi, ["match_id", "team_id"], "left")
    ids = F.transform("players", lambda p: p["player_id"])
    code = F.when(~F.coalesce((F.col("xis") == 1) & F.col("at_start"), F.lit(False)), "MISSING_OR_DUPLICATE_STARTING_XI").when(
        (F.size(ids) != 11) | (F.size(F.array_distinct(ids)) != 11), "STARTING_XI_NOT_ELEVEN_UNIQUE"
    )
    return rows.select("match_id", "team_id", "players", code.alias("code"))


def match_issues(events: DataFrame, roster: DataFrame, halves: DataFrame, xis: DataFrame) -> DataFrame:
    """Fatal issues of whole matches."""
    known = roster.select("match_id").distinct()
    foreign = events.join(known, "match_id", "left_anti").select("match_id").distinct()
    teams = roster.groupBy("match_id").agg(F.count_distinct("team_id").alias("n")).where("n <> 2")
    stranger = events.where("player_id is not null").join(roster, ["match_id", "team_id", "player_id"], "left_anti").join(known, "match_id", "left_semi")
    twice = roster.groupBy(*PLAYER).agg(F.count_distinct("team_id").alias("n")).where("n > 1").select("match_id").distinct()
    odd = events.where(F.array_contains("quality_flags", "UNREVIEWED_EVENT_TYPE")).select("match_id").distinct()
    played = events.where("period < 5").groupBy("match_id").agg(F.array_sort(F.collect_set("period")).alias("periods"))
    short = played.where(~F.array_join("periods", ",").isin("1,2", "1,2,3,4"))
    return _all(
        [
            _issues(foreign, "FOREIGN_MATCH_RECORD"),
            _issues(teams.select("match_id").union(stranger.select("match_id")).distinct(), "CANONICAL_IDENTITY_FAILURE"),
            _issues(twice, "CROSS_TEAM_PLAYER_ID_COLLISION"),
            _issues(odd, "UNREVIEWED_EVENT_TYPE"),
            _issues(short, "INCOMPLETE_PLAYABLE_PERIODS"),
            _issues(halves.where("duration is null"), "UNRELIABLE_PERIOD_BOUNDARY"),
            _issues(halves.where("late"), "EVENT_AFTER_PERIOD_END"),
            _issues(xis.where("code is not null"), F.col("code")),
        ]
    )


def transitions(events: DataFrame, halves: DataFrame, xis: DataFrame) -> DataFrame:
    """Rows for `presence`, a session (team|match) for each team of a match."""
    none = F.lit(None)
    session = F.concat_ws("|", "team_id", "match_id").alias("session")
    head = lambda kind, player, period, at: [session, F.lit(kind).alias("kind"), player.alias("player_id"), none.cast("long").alias("other_id"), period.alias("period"), at.alias("at"), F.lit(0).cast("long").alias("index"), F.lit(False).alias("permanent"), none.cast("string").alias("card")]
    starters = xis.where("code is null").select("match_id", "team_id", F.explode("players").alias("p")).select(*head("Starter", F.col("p.player_id"), F.lit(1), F.lit(0.0)))
    ends = halves.join(xis.select("match_id", "team_id"), "match_id").select(*head("Period End", F.lit(-1).cast("long"), F.col("period"), F.col("duration")))
    moves = events.where(move_of(F.col("event_type"), F.col("permanent"), F.col("card")).isNotNull() & F.col("player_id").isNotNull())
    moves = moves.select(session, F.col("event_type").alias("kind"), "player_id", F.col("replacement_id").alias("other_id"), "period", F.col("elapsed").alias("at"), F.col("index").cast("long").alias("index"), "permanent", "card")
    return moves.unionByName(starters).unionByName(ends)


def anchors(events: DataFrame, roster: DataFrame, halves: DataFrame) -> DataFrame:
    """match_id, player_id, period, at: clock times at which a player's position can change."""
    shifts = events.where(F.col("event_type").isin("Tactical Shift", "Starting XI")).select("match_id", "team_id", "period", F.col("elapsed").alias("at"))
    team = shifts.join(roster, ["match_id", "team_id"]).select(*BY_PERIOD, "at")
    moving = events.where(F.col("event_type").isin("Substitution", "Player Off", "Player On") | F.col("card").isNotNull())
    own = moving.select("match_id", F.explode(F.array("player_id", "replacement_id")).alias("player_id"), "period", F.col("elapsed").alias("at")).where("player_id is not null")
    ends = halves.select("match_id", "period", F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("at")).join(roster.select(*PLAYER), "match_id").select(*BY_PERIOD, "at")
    return team.unionByName(own).unionByName(ends).distinct()


def source_spans(positions: DataFrame, halves: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans of usable observations by period, issues). Ends snap to the nearest anchor within CLOCK_TOLERANCE."""
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    zero = F.array_contains(flags, "ZERO_DURATION_POSITION_OBSERVATION")
    bad = (F.size(flags) > 0) | F.col("start").isNull()
    last = halves.groupBy("match_id").agg(F.max_by(F.struct("period", F.col("duration").alias("elapsed")), "period").alias("over"), F.collect_set("period").alias("periods"))
    # observations get a key of their own, written once, as several branches read it
    rows = materialised(positions.withColumn("obs", F.monotonically_increasing_id()), "observations").join(last, "match_id")
    rows = rows.withColumn("end", F.coalesce("end", "over"))
    outside = ~F.array_contains("periods", F.col("start.period")) | ~F.array_contains("periods", F.col("end.period"))
    first = [_issues(rows.where(zero), "ZERO_DURATION_POSITION_OBSERVATION", "warning"), _issues(rows.where(~zero & bad), "INVALID_SOURCE_POSITION")]
    used = rows.where(~zero & ~bad)
    first.append(_issues(used.where(outside), "POSITION_PERIOD_OUTSIDE_MATCH"))
    used = used.where(~outside & (F.col("start.period") <= F.col("end.period")))
    each = used.withColumn("period", F.explode(F.sequence(F.col("start.period"), F.col("end.period")))).join(halves.select("match_id", "period", "duration"), ["match_id", "period"])
    ends = each.select("obs", *BY_PERIOD, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.when(F.col("period") == F.col("start.period"), F.col("start.elapsed")).alias("t")), F.struct(F.lit("b").alias("side"), F.when(F.col("period") == F.col("end.period"), F.col("end.elapsed")).alias("t")))).alias("e")).select("obs", *BY_PERIOD, "e.*")
    ends = ends.where("t is not null").withColumn("point", F.concat_ws(":", "obs", "period", "side"))
    snapped = I.nearest_anchor(ends, at, BY_PERIOD, "point", "t", S.CLOCK_TOLERANCE)
    side = snapped.groupBy("obs", "period").agg(F.max(F.when(F.col("side") == "a", F.col("snapped"))).alias("a"), F.max(F.when(F.col("side") == "b", F.col("snapped"))).alias("b"))
    each = materialised(each.join(side, ["obs", "period"], "left"), "sides").withColumns({"a": F.coalesce("a", F.lit(0.0)), "b": F.coalesce("b", "duration")})
    inside = (F.col("a") >= 0) & (F.col("a") <= F.col("b")) & (F.col("b") <= F.col("duration"))
    first.append(_issues(each.where(~inside), "POSITION_BOUNDARY_OUTSIDE_PERIOD"))
    spans = each.where(inside & (F.col("b") > F.col("a"))).select("match_id", "team_id", "player_id", "period", F.col("a").alias("start"), F.col("b").alias("end"), "position_id", "position_name")
    return spans, _all(first)


def position_issues(spans: DataFrame, present: DataFrame, positions: DataFrame, people: DataFrame) -> DataFrame:
    """Starters' positions, overlaps, and time at which only one of position and presence is there."""
    initial = (F.col("start.period") == 1) & (F.col("start.elapsed") == 0) & ~(F.coalesce((F.col("end.period") == 1) & (F.col("end.elapsed") == 0), F.lit(False)))
    seen = positions.groupBy(*PLAYER).agg(F.count("*").alias("observed"), F.collect_list(F.when(initial, F.col("position_name"))).alias("first"))
    rows = people.where("introduced or observed > 0").drop("observed").join(seen, PLAYER, "left")
    without = rows.where("observed is null")
    wrong = rows.where(F.col("observed").isNotNull() & F.col("starter") & ~F.coalesce((F.size("first") == 1) & (F.element_at("first", 1) == F.col("starting_position")), F.lit(False)))
    # a later span that begins before the end of an earlier one, beyond the tolerance of sums
    w = Window.partitionBy(*BY_PERIOD).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    over = spans.withColumn("reach", F.max("end").over(w)).where(F.col("start") < F.col("reach") - S.EDGE)
    apart = I.disagreement(spans.select(*BY_PERIOD, "start", "end"), present.select(*BY_PERIOD, "start", "end"), BY_PERIOD).where(F.col("differs") > S.EDGE)
    return _all(
        [
            _issues(without, "APPEARANCE_WITHOUT_POSITION_EVIDENCE"),
            _issues(wrong, "STARTING_POSITION_DISAGREEMENT"),
            _issues(over, "OVERLAPPING_SOURCE_POSITIONS"),
            _issues(apart.join(people.where("introduced or observed > 0").select(*PLAYER), PLAYER, "left_semi"), "POSITION_PRESENCE_DISAGREEMENT"),
        ]
    )


def evidence_issues(events: DataFrame, present: DataFrame, people: DataFrame) -> DataFrame:
    """Actions of a player outside of his presence, or of a player who never appeared."""
    acts = events.where(F.col("player_id").isNotNull() & ~F.col("event_type").isin(S.PRESENCE_ADMINISTRATIVE) & (F.col("period") < 5))
    idle = people.where("not introduced and observed = 0").select(*PLAYER)
    unused = acts.join(idle, PLAYER, "left_semi").select(*PLAYER).distinct()
    outside = I.within(acts.join(idle, PLAYER, "left_anti"), present, BY_PERIOD, "elapsed", S.EDGE, "left_anti")
    return _issues(unused, "EVENT_FOR_UNUSED_ROSTER_PLAYER").unionByName(_issues(outside, "ACTION_OUTSIDE_RECONSTRUCTED_PRESENCE"))


def card_issues(cards: DataFrame, events: DataFrame) -> DataFrame:
    """Cards of the line-up held against card events of the same player and card."""
    found = events.where("card is not null and player_id is not null").select(*PLAYER, F.col("card").alias("card_type"), F.struct("period", "elapsed").alias("e"))
    rows = materialised(cards.withColumn("n", F.monotonically_increasing_id()), "cards").join(found, [*PLAYER, "card_type"], "left")
    near = (F.col("e.period") == F.col("time.period")) & (F.abs(F.col("e.elapsed") - F.col("time.elapsed")) <= S.CLOCK_TOLERANCE)
    rows = rows.groupBy("n", *PLAYER, "card_type", "time").agg(F.count("e").alias("events"), F.count_if(near).alias("near"))
    hard = F.when(F.col("card_type").isin(S.DISMISSALS), "error").otherwise("warning")
    code = (
        F.when(F.col("events") == 0, "LINEUP_CARD_WITHOUT_EVENT")
        .when(F.col("time").isNull(), F.when(F.col("events") == 1, "CARD_CLOCK_RESOLVED_FROM_EVENT").otherwise("AMBIGUOUS_SOURCE_CARD"))
        .when(F.col("near") == 0, "CARD_EVENT_CLOCK_DISAGREEMENT")
    )
    rows = rows.withColumn("what", code).where("what is not null")
    severity = F.when(F.col("what") == "CARD_CLOCK_RESOLVED_FROM_EVENT", "warning").when(F.col("what") == "AMBIGUOUS_SOURCE_CARD", "error").otherwise(hard)
    return _issues(rows, F.col("what"), severity)


@dataclass
class Reconciled:
    appearances: DataFrame
    presence: DataFrame
    positions: DataFrame
    periods: DataFrame
    issues: DataFrame


def decided(people: DataFrame, issues: DataFrame, present: DataFrame) -> DataFrame:
    """people (match_id, team_id, player_id, introduced, observed, ...) with seconds, flags and quality_status."""
    total = present.groupBy(*PLAYER).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))
    errors = issues.where("severity = 'error'")
    own = errors.where("player_id is not null").groupBy(*PLAYER).agg(F.collect_set("code").alias("own"))
    fatal = errors.where("player_id is null").groupBy("match_id").agg(F.collect_set("code").alias("fatal"))
    empty = F.array().cast("array<string>")
    rows = people.join(total, PLAYER, "left").join(own, PLAYER, "left").join(fatal, "match_id", "left")
    used = F.col("introduced") | (F.col("observed") > 0)
    flags = F.array_sort(F.array_union(F.coalesce("own", empty), F.when(used, F.coalesce("fatal", empty)).otherwise(empty)))
    rows = rows.withColumns({"quality_flags": flags, "seconds": F.coalesce("seconds", F.lit(0.0))})
    status = F.when(F.size("quality_flags") > 0, "NEEDS_REVIEW").when(~used | (F.col("seconds") <= 0), "EXCLUDED").otherwise("VALIDATED")
    rows = rows.withColumns({"quality_status": status, "used": used})
    return rows.withColumn("playing_seconds", F.when(F.col("quality_status") == "VALIDATED", F.col("seconds"))).drop("own", "fatal", "seconds")


def reconcile(events: DataFrame, roster: DataFrame, positions: DataFrame, cards: DataFrame) -> Reconciled:
    """All steps; only validated appearances expose seconds, presence and positions."""
    # tables that several rules read are written once
    halves, xis = materialised(boundaries(events, roster), "halves"), materialised(line_ups(events, roster), "line-ups")
    whole = materialised(match_issues(events, roster, halves, xis), "fatal")
    broken = whole.select("match_id").distinct()
    good = lambda rows: rows.join(broken, "match_id", "left_anti")
    starters = xis.where("code is null").select("match_id", F.explode("players").alias("p")).select("match_id", F.col("p.player_id").alias("player_id"), F.col("p.position_name").alias("starting_position"))
    seen = positions.groupBy(*PLAYER).agg(F.count("*").alias("observed"))
    folded = materialised(presence(transitions(good(events), good(halves), good(xis))), "folded")
    cut = F.instr("session", "|")
    folded = folded.withColumns({"team_id": F.substring("session", F.lit(1), cut - 1).cast("long"), "match_id": F.substring("session", cut + 1, F.length("session"))}).drop("session")
    rows = folded.where("issue is null")
    came = folded.where("issue is null and player_id >= 0").select(*PLAYER).distinct().withColumn("on", F.lit(True))
    people = roster.join(starters, PLAYER, "left").join(seen, PLAYER, "left").join(came, PLAYER, "left")
    people = people.withColumns({"starter": F.col("starting_position").isNotNull(), "observed": F.coalesce("observed", F.lit(0))})
    people = materialised(people.withColumn("introduced", F.col("starter") | F.coalesce("on", F.lit(False))).drop("on"), "people")
    team = roster.select(*PLAYER, "team_id")
    refused = folded.where("issue is not null")
    severity = F.when(F.col("issue") == "BENCH_OR_POST_EXIT_DISMISSAL", "warning").otherwise("error")
    moves = _issues(refused.withColumn("player_id", F.when(F.col("issue") != CAPACITY_CODE, F.col("player_id"))), F.col("issue"), severity)
    spans, odd = source_spans(good(positions), good(halves), anchors(good(events), good(roster), good(halves)))
    spans = materialised(spans, "spans")
    idle = people.where("introduced or observed > 0").join(rows.select(*PLAYER).distinct(), PLAYER, "left_anti")
    duration = good(halves).groupBy("match_id").agg(F.sum("duration").alias("whole"))
    long = rows.groupBy(*PLAYER).agg(F.sum(F.col("end") - F.col("start")).alias("s")).join(duration, "match_id").where(F.col("s") > F.col("whole") + S.EDGE)
    roles = {i: role for role, ids in S.ROLES.items() for i in ids}
    both = I.overlaps(spans, rows.select(*BY_PERIOD, "start", "end"), BY_PERIOD)
    unmapped = both.where(~F.col("position_id").isin(list(roles)))
    issues = _all(
        [
            whole, moves, odd,
            _issues(good(idle), "NO_POSITIVE_PLAYING_TIME"),
            position_issues(spans, rows, good(positions), good(people)),
            _issues(unmapped.select("match_id", "player_id").distinct(), "UNMAPPED_POSITION"),
            evidence_issues(good(events), rows, good(people)),
            _issues(long, "IMPOSSIBLE_PLAYING_SECONDS"),
            card_issues(good(cards), good(events)),
        ]
    )
    issues = materialised(issues.withColumnRenamed("team_id", "of_team").join(team, PLAYER, "left").withColumn("team_id", F.coalesce("of_team", "team_id")).select(ISSUE), "issues")
    apps = materialised(decided(people, issues, rows), "decided")
    valid = apps.where("quality_status = 'VALIDATED'").select(*PLAYER)
    base = F.coalesce(*[F.when(F.col("period") == p, F.lit(x)) for p, x in S.NOMINAL_SECONDS.items()])
    nominal = rows.groupBy(*PLAYER).agg((F.sum(F.greatest(F.lit(0.0), F.least("end", base) - F.least("start", base))) / 60).alias("nominal"))
    apps = apps.join(nominal, PLAYER, "left").withColumn("nominal_minutes", F.when(F.col("playing_seconds").isNotNull(), F.col("nominal"))).drop("nominal")
    role = F.coalesce(*[F.when(F.col("position_id").isin(ids), F.lit(name)) for name, ids in S.ROLES.items()])
    placed = both.where(F.col("position_id").isin(list(roles))).select("match_id", "team_id", "player_id", "period", F.col("from").alias("start"), F.col("to").alias("end"), "position_id", "position_name", role.alias("role"))
    shown = lambda x: x.join(valid, PLAYER, "left_semi")
    return Reconciled(apps, shown(rows.drop("issue")), shown(placed), good(halves).select("match_id", "period", "duration"), issues)


def report(r: Reconciled) -> DataFrame:
    """quality_status, n, seconds: the census of a cohort; unused players are rows without evidence of play."""
    return r.appearances.groupBy("quality_status", "used").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("playing_seconds"), F.lit(0.0)), 6).alias("seconds"))


def cohort_report(r: Reconciled, roster: DataFrame) -> DataFrame:
    """(kind, name, n): appearances by status with unused players apart, issues by code, and the roster they must add up to.

    Raises where appearances and unused players are not the roster.
    """
    unused = ~F.col("used") & (F.col("quality_status") == "EXCLUDED")
    status = r.appearances.groupBy(F.when(unused, "unused_roster").otherwise(F.col("quality_status")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("appearances").alias("kind"), "name", "n")
    issues = r.issues.groupBy(F.col("code").alias("name")).agg(F.count("*").alias("n")).select(F.lit("issues").alias("kind"), "name", "n")
    whole = roster.agg(F.count("*").alias("n")).select(F.lit("roster").alias("kind"), F.lit("entries").alias("name"), "n")
    out = materialised(status.unionByName(issues).unionByName(whole), "cohort-report")
    n = out.groupBy("kind").agg(F.sum("n").alias("n")).collect()
    got = {x["kind"]: x["n"] for x in n}
    if got.get("appearances", 0) != got["roster"]:
        raise ValueError(f"{got.get('appearances', 0)} appearances and unused players for a roster of {got['roster']}")
    return out
