"""Contracts, review records, keepers and events that contradict their sources: one planted violation of each kind."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import contracts as K
from touchline.operators import profiles as P
from touchline.operators import review as R
from touchline.operators import statistics as St

POINT = "struct<period:int,elapsed:double>"
ROWS = {
    "snapshot": ("snapshot_id string, provider string, revision string, sha256 string, retrieved_at timestamp", ("s", "p", "r", "a" * 64, None), {"NO_RETRIEVAL_TIME"}, {"sha256": "zz"}, {"NO_RETRIEVAL_TIME", "BAD_HASH"}),
    "competition": ("competition_id string, competition_name string, country string, gender string", ("a:competition:1", "L", "C", "female"), set(), {"gender": "none", "country": " "}, {"BAD_GENDER", "EMPTY_TEXT"}),
    "player": ("player_id string, player_name string, birth_date string, birth_date_source string", ("a:player:1", "P", None, None), set(), {"birth_date": "2000-01-01"}, {"BIRTH_DATE_WITHOUT_EVIDENCE"}),
    "match": ("match_id string, home_team_id string, away_team_id string, home_score int, away_score int", ("a:match:1", "x", "y", 1, 0), set(), {"away_team_id": "x", "home_score": None}, {"SAME_TEAMS", "HALF_A_SCORE"}),
    "roster": ("status string, jersey_number int", ("starter", 7), set(), {"status": "late", "jersey_number": 0}, {"BAD_STATUS", "BAD_JERSEY"}),
    "period": ("period int, duration double", (1, 3000.0), set(), {"period": 5, "duration": float("nan")}, {"BAD_PERIOD", "BAD_DURATION"}),
    "presence": (f"start {POINT}, end {POINT}, start_reason string, end_reason string", ((1, 0.0), (1, 5.0), "a", "b"), set(), {"end": (1, 0.0), "end_reason": ""}, {"END_NOT_AFTER_START", "EMPTY_REASON"}),
    "position": (f"start {POINT}, end {POINT}, start_reason string, end_reason string, position_id int, position_name string", ((1, 9.0), (2, 5.0), "a", "b", 3, "Back"), set(), {"position_id": -1}, {"BAD_POSITION"}),
    "observation": (f"start {POINT}, end {POINT}, quality_flags array<string>", ((1, 0.0), None, []), set(), {"end": (1, 0.0)}, {"ZERO_LENGTH_WITHOUT_FLAG"}),
    "card": (f"time {POINT}, card_type string, reason string, quality_flags array<string>", ((1, 0.0), "Yellow Card", "Foul", []), set(), {"time": None}, {"CLOCK_WITHOUT_FLAG"}),
    "appearance": (
        "quality_status string, playing_seconds double, nominal_minutes double, minutes_method string, minutes_version string",
        ("VALIDATED", 60.0, 1.0, "m", "v"), set(), {"playing_seconds": float("inf"), "minutes_version": None}, {"BAD_SECONDS", "VALIDATED_WITHOUT_METHOD"},
    ),
    "event": (
        "elapsed double, index int, player_id string, team_id string, start_location struct<x:double,y:double>, event_type string, pass_detail string, carry_detail string, shot_detail string",
        (1.0, 0, "p", "t", (0.5, 1.0), "Pass", "d", None, None), set(), {"team_id": None, "start_location": (1.2, 0.5), "shot_detail": "d"}, {"PLAYER_WITHOUT_TEAM", "OUTSIDE_PITCH", "SHOT_DETAIL_MISMATCH"},
    ),
}


@pytest.mark.parametrize("contract", K.CONTRACTS)
def test_contract(spark, contract):
    schema, good, own, change, codes = ROWS[contract]
    names = spark.createDataFrame([], schema).columns
    bad = tuple(change.get(n, v) for n, v in zip(names, good))
    got = [set(r.violations) for r in K.checked(spark.createDataFrame([good, bad], schema).coalesce(1), contract).collect()]
    assert got == [own, codes]


def test_split_and_repeated(spark):
    rows = spark.createDataFrame([("a:player:1", "P", None, None), ("a:player:1", "Q", None, None), ("a:player:2", "", None, None)], ROWS["player"][0])
    good, quarantine = K.split(rows, "player")
    assert good.count() == 2 and [r.violations for r in quarantine.collect()] == [["EMPTY_TEXT"]]
    assert [(r.player_id, r.n) for r in K.repeated(rows, "player").collect()] == [("a:player:1", 2)]


def test_keepers_have_their_own_categories(spark):
    roles = {p: "GK" if p < 12 else "CB" for p in range(24)}
    rows = [(p, 1, role, m, float(p + k), True, True) for p, role in roles.items() for k, m in enumerate(("passes_attempted", "long_passes", "passes_completed", "pass_completion_pct"))]
    long = spark.createDataFrame(rows, "player_id long, team_id long, role string, metric string, v double, eligible boolean, is_ref boolean")
    got = {(r.player_id, r.category): (r.status, r.score, r.peer_count) for r in P.category_scores(long, spark).collect()}
    assert {c for p, c in got if p < 12} == {"distribution_activity", "shot_stopping"} and "distribution_activity" not in {c for p, c in got if p >= 12}
    assert got[0, "shot_stopping"] == ("UNSUPPORTED_DATA", None, 0) and got[0, "distribution_activity"][0] == "AVAILABLE"
    assert got[11, "distribution_activity"][1] == pytest.approx(100 * 11.5 / 12) and got[12, "passing"][0] == "AVAILABLE"


def test_events_that_contradict_their_sources(spark):
    events = spark.createDataFrame(
        [("m", "good", 1, 7, 1, 5.0, ["UNMAPPED_PASS_OUTCOME"]), ("m", "team", 1, 8, 1, 5.0, []), ("m", "late", 1, 7, 1, 99.0, []), ("m", "odd", 1, 7, 1, 6.0, ["UNREVIEWED_EVENT_TYPE"])],
        "match_id string, event_id string, player_id long, team_id long, period int, elapsed double, quality_flags array<string>",
    ).withColumn("disposition", F.lit("included"))
    presence = spark.createDataFrame([("m", 1, 1, 0.0, 10.0)], "match_id string, player_id long, period int, start double, end double")
    apps = spark.createDataFrame([("m", 1, 7)], "match_id string, player_id long, team_id long")
    got = {(r.event_id, r.code) for r in St.disposition_errors(events, presence, apps).collect()}
    assert got == {("team", "WRONG_TEAM"), ("late", "OUTSIDE_PRESENCE"), ("odd", "UNREVIEWED_FLAGS")}


REVIEW = "case string, kind string, review_status string, pair_similarity int, requirement_fit int, agreement int, reviewer string, summary string, review_date string, seen_model boolean, confidence string, disagreement_reason string"
SOURCE = "case string, source_id string, player_id long, team_id long, match_id string, content_kind string, reference string, intervals array<struct<start:long,end:long>>, points array<struct<timestamp:string,replay_seconds:long>>"


def test_review_records(spark):
    good = ("A", "pair", "COMPLETED", 3, None, None, "me", "seen", "2024-05-01", False, "high", None)
    bad = ("B", "pair", "DONE", 9, 2, 4, " ", None, "1 May", None, "sure", "")
    idle = ("C", "candidate", "NOT_PERFORMED", None, None, None, None, None, None, None, None, None)
    got = {r.case: set(r.issues) for r in R.record_issues(spark.createDataFrame([good, bad, idle], REVIEW)).collect()}
    assert got["A"] == got["C"] == set()
    assert got["B"] == {"UNKNOWN_STATUS", "RATING_OUT_OF_RANGE", "RATING_OF_ANOTHER_KIND", "TEXT_MISSING", "BAD_DATE", "DISCLOSURE_MISSING", "BAD_CONFIDENCE", "REASON_MISSING"}


def test_review_sources_and_coverage(spark):
    cases = spark.createDataFrame([("A", 1, 10), ("A", 2, 20), ("Z", 9, 90)], "case string, player_id long, team_id long")
    fixtures = spark.createDataFrame([(1, 10, "m"), (1, 10, "n"), (2, 20, "m")], "player_id long, team_id long, match_id string")
    hour = [(0, 1800), (900, 2700), (0, 1800), (2700, 3600)]
    rows = [
        ("A", "s1", 1, 10, "m", "full_match", "r", hour, []), ("A", "s2", 1, 10, "m", "full_match", "r", [(0, 2700)], [("1:01:01", 3661)]), ("A", "s3", 1, 10, "n", "full_match", "r", [(0, 3600)], []),
        ("A", "s4", 2, 20, "m", "highlights", "r", [(0, 9000)], []), ("A", "s5", 3, 30, "m", "film", " ", [(9, 5)], [("0:61", 61)]), ("A", "s5", 2, 20, "q", "full_match", "r", None, []),
    ]
    sources = spark.createDataFrame(rows, SOURCE)
    got = {}
    for r in R.source_issues(sources, cases, fixtures).collect():
        got.setdefault(r.source_id, []).append(set(r.issues))
    assert got["s1"] == got["s2"] == got["s3"] == got["s4"] == [set()]
    assert sorted(got["s5"], key=len) == [{"SOURCE_ID_NOT_UNIQUE", "FIXTURE_NOT_IN_THE_PACK", "INTERVALS_MISSING"}, {"SOURCE_ID_NOT_UNIQUE", "PLAYER_OF_ANOTHER_CASE", "FIXTURE_NOT_IN_THE_PACK", "TEXT_MISSING", "BAD_CONTENT_KIND", "BAD_INTERVAL", "CLOCK_DISAGREES"}]
    seen = {(r.case, r.player_id): (r.fixtures, r.substantial) for r in R.coverage(sources, cases, fixtures).collect()}
    assert seen == {("A", 1): (2, True), ("A", 2): (0, False), ("Z", 9): (0, False)}
    reviews = spark.createDataFrame([("A",), ("X",)], "case string")
    assert {(r.case, r.code) for r in R.case_coverage(reviews, cases).collect()} == {("X", "UNEXPECTED_CASE"), ("Z", "MISSING_RECORD")}
