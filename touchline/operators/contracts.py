"""Row checks of the canonical tables: each contract is a table of (code, condition of a violation).

A check sees one row and gives the codes that it violates; rows with codes go to quarantine, with them.
A condition that is unknown is no violation. Missing columns are NULL. Keys that must be unique in a table
are checked by `repeated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ID_PATTERN, codes

C = F.col


def empty(name: str) -> Column:
    """Not a text with something in it."""
    return C(name).isNull() | (F.length(F.trim(C(name).cast("string"))) == 0)


def foreign_id(name: str) -> Column:
    return C(name).isNull() | ~C(name).cast("string").rlike(ID_PATTERN)


def not_number(name: str, least: float, above: bool = False) -> Column:
    """A number that is given but not finite, or below its least value."""
    v = C(name).cast("double")
    low = v <= least if above else v < least
    return C(name).isNotNull() & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | low)


def half(a: str, b: str) -> Column:
    return C(a).isNull() != C(b).isNull()


def has(flag: str) -> Column:
    return F.coalesce(F.array_contains("quality_flags", flag), F.lit(False))


def before(a: str, b: str) -> Column:
    """Whether point a is before point b, by period and then by seconds."""
    return (C(f"{a}.period") < C(f"{b}.period")) | ((C(f"{a}.period") == C(f"{b}.period")) & (C(f"{a}.elapsed") < C(f"{b}.elapsed")))


def same(a: str, b: str) -> Column:
    return (C(f"{a}.period") == C(f"{b}.period")) & (C(f"{a}.elapsed") == C(f"{b}.elapsed"))


def bad_point(name: str) -> Column:
    at = C(f"{name}.elapsed")
    return C(name).isNotNull() & (~C(f"{name}.period").between(1, 4) | (at < 0) | F.isnan(at) | (at == float("inf")))


def outside(name: str) -> Column:
    """A location with a coordinate outside of the pitch or without one."""
    x, y = C(f"{name}.x"), C(f"{name}.y")
    return C(name).isNotNull() & ~F.coalesce(x.between(0, 1) & y.between(0, 1) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


STATUSES = ["VALIDATED", "NEEDS_REVIEW", "EXCLUDED", "UNVALIDATED"]
_DETAILS = {"Pass": "pass_detail", "Carry": "carry_detail", "Shot": "shot_detail"}


def _interval() -> list:
    return [("END_NOT_AFTER_START", ~before("start", "end")), ("BAD_POINT", bad_point("start") | bad_point("end")), ("EMPTY_REASON", empty("start_reason") | empty("end_reason"))]


def rules(contract: str) -> list[tuple[str, Column]]:
    """(code, violation) of a contract."""
    return {
        "snapshot": lambda: [("EMPTY_TEXT", empty("snapshot_id") | empty("provider") | empty("revision")), ("BAD_HASH", ~C("sha256").rlike("^[0-9a-f]{64}$")), ("NO_RETRIEVAL_TIME", C("retrieved_at").isNull())],
        "competition": lambda: [("BAD_ID", foreign_id("competition_id")), ("EMPTY_TEXT", empty("competition_name") | empty("country")), ("BAD_GENDER", ~C("gender").isin("female", "male", "mixed", "unknown"))],
        "player": lambda: [("BAD_ID", foreign_id("player_id")), ("EMPTY_TEXT", empty("player_name")), ("BIRTH_DATE_WITHOUT_EVIDENCE", half("birth_date", "birth_date_source"))],
        "match": lambda: [("BAD_ID", foreign_id("match_id")), ("SAME_TEAMS", C("home_team_id") == C("away_team_id")), ("HALF_A_SCORE", half("home_score", "away_score")), ("NEGATIVE_SCORE", (C("home_score") < 0) | (C("away_score") < 0))],
        "roster": lambda: [("BAD_STATUS", ~C("status").isin("starter", "substitute", "unused", "unknown")), ("BAD_JERSEY", C("jersey_number") <= 0)],
        "period": lambda: [("BAD_PERIOD", ~C("period").between(1, 4)), ("BAD_DURATION", not_number("duration", 0, above=True) | C("duration").isNull())],
        "presence": _interval,
        "position": lambda: [*_interval(), ("BAD_POSITION", C("position_id") <= 0), ("EMPTY_TEXT", empty("position_name"))],
        "observation": lambda: [
            ("START_WITHOUT_FLAG", C("start").isNull() & ~has("INVALID_SOURCE_POSITION_START")),
            ("REVERSED_WITHOUT_FLAG", before("end", "start") & ~has("REVERSED_SOURCE_POSITION_INTERVAL")),
            ("ZERO_LENGTH_WITHOUT_FLAG", same("start", "end") & ~has("ZERO_DURATION_POSITION_OBSERVATION")),
        ],
        "card": lambda: [("CLOCK_WITHOUT_FLAG", C("time").isNull() & ~has("INVALID_SOURCE_CARD_CLOCK")), ("EMPTY_TEXT", empty("card_type") | empty("reason"))],
        "appearance": lambda: [
            ("BAD_STATUS", ~C("quality_status").isin(STATUSES)),
            ("BAD_SECONDS", not_number("playing_seconds", 0) | not_number("nominal_minutes", 0)),
            ("VALIDATED_WITHOUT_SECONDS", (C("quality_status") == "VALIDATED") & ~F.coalesce(C("playing_seconds") > 0, F.lit(False))),
            ("VALIDATED_WITHOUT_METHOD", (C("quality_status") == "VALIDATED") & (empty("minutes_method") | empty("minutes_version"))),
        ],
        "event": lambda: [
            ("BAD_SECONDS", not_number("elapsed", 0) | C("elapsed").isNull()),
            ("BAD_INDEX", C("index") < 0),
            ("PLAYER_WITHOUT_TEAM", C("player_id").isNotNull() & C("team_id").isNull()),
            ("OUTSIDE_PITCH", outside("start_location")),
            *[(f"{kind.upper()}_DETAIL_MISMATCH", (C("event_type") == kind) != C(column).isNotNull()) for kind, column in _DETAILS.items()],
        ],
    }[contract]()


CONTRACTS = ("snapshot", "competition", "player", "match", "roster", "period", "presence", "position", "observation", "card", "appearance", "event")
#: Columns that make a row of a table unique.
UNIQUE = {"player": ["player_id"], "match": ["match_id"], "roster": ["match_id", "team_id", "player_id"], "period": ["match_id", "period"], "appearance": ["match_id", "player_id"], "event": ["event_id"]}


def checked(df: DataFrame, contract: str) -> DataFrame:
    """df with violations, the codes of a row in the order of the rules."""
    found = [(F.coalesce(bad, F.lit(False)), code) for code, bad in rules(contract)]
    return df.withColumn("violations", codes(found))


def split(df: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, rows in quarantine with their violations)."""
    rows = checked(df, contract)
    return rows.where(F.size("violations") == 0).drop("violations"), rows.where(F.size("violations") > 0)


def repeated(df: DataFrame, contract: str) -> DataFrame:
    """Keys that are in the table more than once, with their number."""
    return df.groupBy(*UNIQUE[contract]).agg(F.count("*").alias("n")).where("n > 1")
