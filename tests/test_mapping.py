"""Raw JSON files to typed rows, and on to validated appearances."""

import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import quality as Q
from touchline.sources import json as J
from touchline.sources import mapping as M
from touchline.sources import sinks


def typed(i, name):
    return {"id": i, "name": name}


class Files:
    """A complete match of two teams of eleven and two periods of 3,000 s."""

    def __init__(self):
        self.events, n = [], 0
        people = {t: [{"player": typed(t * 100 + i, f"P{t}{i}"), "position": typed(14, "Centre"), "jersey_number": i} for i in range(1, 12)] for t in (1, 2)}
        for t in (1, 2):
            self.add("Starting XI", 35, 1, "00:00:00.000", t, tactics={"formation": 442, "lineup": people[t]})
        for p in (1, 2):
            for t in (1, 2):
                self.add("Half Start", 18, p, "00:00:00.000", t)
                self.add("Half End", 34, p, "00:50:00.000", t)
        entry = lambda t, i: {
            "player_id": t * 100 + i, "player_name": f"P{t}{i}", "player_nickname": None, "jersey_number": i, "country": typed(7, "Country"), "shoe": "left",
            "positions": [{"position_id": 14, "position": "Centre", "from": "00:00", "to": None, "from_period": 1, "to_period": None, "start_reason": "Starting XI", "end_reason": "Final Whistle"}], "cards": [],
        }
        self.sheets = [{"team_id": t, "team_name": f"T{t}", "lineup": [entry(t, i) for i in range(1, 12)]} for t in (1, 2)]

    def add(self, kind, type_id, period, clock, team=1, player=None, **more):
        n = len(self.events)
        row = {"id": f"e{n}", "index": n, "period": period, "timestamp": clock, "minute": 0, "second": 0, "type": typed(type_id, kind), "team": typed(team, f"T{team}")}
        self.events.append(row | ({"player": typed(player, "P")} if player else {}) | more)
        return row["id"]

    def write(self, path, name="77"):
        for kind, rows in (("events", self.events), ("lineups", self.sheets)):
            (path / kind).mkdir(exist_ok=True)
            (path / kind / f"{name}.json").write_text(json.dumps(rows))
        return path

    def read(self, spark, path):
        self.write(path)
        events = M.events(M.raw_records(spark, f"{path}/events"))
        return events, *M.line_ups(M.raw_records(spark, f"{path}/lineups"))


def test_details_of_events(spark, tmp_path):
    m = Files()
    m.add("Pass", 30, 1, "00:00:05.500", 1, 101, location=[60, 40], **{"pass": {"end_location": [120, 80], "length": 31.5, "outcome": typed(9, "Incomplete"), "switch": True, "recipient": typed(102, "Q")}})
    m.add("Pass", 30, 1, "00:00:06", 1, 101, **{"pass": {"end_location": [1, 2]}})
    m.add("Pass", 30, 1, "00:00:07", 1, 101, **{"pass": {"outcome": typed(1, "Unheard")}})
    m.add("Carry", 43, 1, "00:00:08", 1, 101, carry={"end_location": [30, 20]})
    m.add("Shot", 16, 1, "00:00:09", 1, 101, shot={"statsbomb_xg": 0.25, "outcome": typed(1, "Goal"), "end_location": [120, 40, 1.5], "key_pass_id": "e10"}, counterpress=True)
    m.add("Ball Recovery", 2, 1, "00:00:10", 1, 101, ball_recovery={"recovery_failure": True})
    m.add("Foul Committed", 22, 1, "00:00:11", 1, 101, foul_committed={"card": typed(5, "Yellow Card")})
    m.add("Player Off", 27, 1, "00:00:12", 1, 101, player_off={"permanent": True})
    m.add("Shot", 17, 1, "00:60:00", 1, 101, shot={"outcome": typed(1, "Saved")}, mystery={"a": 1})
    rows = {r.event_id: r for r in m.read(spark, tmp_path)[0].collect()}
    at = len(m.events) - 9
    first, plain, odd, carry, shot, recovery, foul, off, last = (rows[f"e{at + k}"] for k in range(9))
    assert (first.elapsed, first.start_location.x, first.pass_detail.end_location.y, first.pass_detail.outcome, first.pass_detail.switch, first.pass_detail.cross, first.pass_detail.recipient_id) == (5.5, 0.5, 1.0, "incomplete", True, False, 102)
    assert plain.pass_detail.outcome == "complete" and odd.pass_detail.outcome == "unknown" and odd.quality_flags == ["UNMAPPED_PASS_OUTCOME"]
    assert carry.carry_detail.end_location.x == 0.25 and carry.pass_detail is None and shot.shot_detail.xg == 0.25 and shot.shot_detail.end_location == [120, 40, 1.5] and shot.counterpress
    assert recovery.defensive_detail.recovery_failure is True and recovery.defensive_detail.offensive is False
    assert (foul.card, foul.source_card_id, off.permanent, foul.permanent) == ("Yellow Card", 5, True, None)
    assert last.elapsed is None and last.quality_flags == ["UNREVIEWED_EVENT_TYPE", "UNREVIEWED_SOURCE_FIELDS"] and json.loads(last.source_attributes["mystery"]) == {"a": 1}
    assert first.player_key == "statsbomb:player:101" and rows["e0"].tactical[0].position_name == "Centre" and rows["e0"].formation == "442"


@pytest.mark.parametrize("more", [{"under_pressure": "yes"}, {"location": [1, 2, 3]}, {"location": [1, "x"]}, {"player": {"id": -4, "name": "P"}}])
def test_broken_records_stop_the_job(spark, tmp_path, more):
    m = Files()
    m.add("Pressure", 17, 1, "00:00:01", 1, 101)
    m.events[-1] |= more
    with pytest.raises(Exception, match="not a|not an"):
        m.read(spark, tmp_path)[0].collect()


@pytest.mark.parametrize("text", ["[]", "{}", "nonsense"])
def test_lists_of_records_only(spark, tmp_path, text):
    (tmp_path / "1.json").write_text(text)
    with pytest.raises(Exception, match="not a list of records"):
        M.raw_records(spark, str(tmp_path)).collect()


def test_line_ups(spark, tmp_path):
    m = Files()
    sheet = m.sheets[0]["lineup"][0]
    place = sheet["positions"][0]
    sheet["positions"] += [place | {"from": "50:00", "from_period": 2, "to": "50:00", "to_period": 2}, place | {"from": "60:00", "from_period": 2, "to": "50:00", "to_period": 2}, place | {"from": "40:00", "from_period": 2}, place | {"from": "00:61", "from_period": 1}]
    sheet["cards"] = [{"time": "46:10", "period": 2, "card_type": "Yellow Card", "reason": "Foul"}, {"time": "10:00", "period": 2, "card_type": "Red Card", "reason": "Foul"}]
    _, roster, positions, cards = m.read(spark, tmp_path)
    own = positions.where("player_id = 101").collect()
    assert [r.quality_flags for r in own] == [[], ["ZERO_DURATION_POSITION_OBSERVATION"], ["REVERSED_SOURCE_POSITION_INTERVAL"], ["INVALID_SOURCE_POSITION_START"], ["INVALID_SOURCE_POSITION_START"]]
    assert [(r.time and r.time.elapsed, r.quality_flags) for r in cards.collect()] == [(70.0, []), (None, ["INVALID_SOURCE_CARD_CLOCK"])]
    assert roster.count() == 22 and roster.first().source_attributes == {"shoe": "left"} and roster.first().country == "Country"


def test_two_distinct_sheets(spark, tmp_path):
    m = Files()
    m.sheets[1]["team_id"] = 1
    with pytest.raises(Exception, match="two distinct team sheets"):
        m.read(spark, tmp_path)[1].collect()


def test_from_files_to_appearances(spark, tmp_path):
    """A whole match, and one whose halves end early in the source."""
    early, m = Files(), Files()
    for e in early.events:
        if e["type"]["name"] == "Half End":
            e["half_end"] = {"early_video_end": True}
    early.write(tmp_path, "78")
    events, roster, positions, cards = m.read(spark, tmp_path)
    r = Q.reconcile(events, roster.select("match_id", "team_id", "player_id"), positions, cards)
    apps = r.appearances.collect()
    assert [a.quality_status for a in apps if a.match_id == "78"] == ["NEEDS_REVIEW"] * 22
    assert {(a.quality_status, a.playing_seconds, a.nominal_minutes) for a in apps if a.match_id == "77"} == {("VALIDATED", 6000.0, 90.0)}
    assert {x.match_id for x in r.presence.collect()} == {"77"} and r.presence.count() == r.positions.count() == 44


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "matches").mkdir()
    match = {"match_id": 5, "competition": {"competition_id": 37}, "season": {"season_id": 281}, "match_date": "2024-01-02", "home_score": 1, "away_score": 0, "home_team": {"home_team_id": 1, "home_team_name": "A"}, "away_team": {"away_team_id": 2, "away_team_name": "B"}}
    (tmp_path / "matches" / "281.json").write_text(json.dumps([match, match | {"match_id": 4}]))
    assert [r.match_id for r in J.matches(spark, f"{tmp_path}/matches", 37, 281).collect()] == [4, 5]
    (tmp_path / "matches" / "282.json").write_text(json.dumps([match | {"match_id": 6, "season": {"season_id": 282}}]))
    with pytest.raises(ValueError, match="1 foreign"):
        J.matches(spark, f"{tmp_path}/matches", 37, 281)
    rows = spark.createDataFrame([(k, k % 3, f"x{k}") for k in range(9)], "b long, a long, c string")
    sinks.write_partitions(rows, f"{tmp_path}/out", "a")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_partitions(rows, f"{tmp_path}/out", "a")
    assert sorted(r.b for r in sinks.load_partition(spark, f"{tmp_path}/out", "a", 1).collect()) == [1, 4, 7]
    assert rows.where("b = 1").select(sinks.canonical_json(["b", "a", "c"]).alias("j")).first().j == '{"a":1,"b":1,"c":"x1"}'
    assert F is not None


def test_numbers_beyond_the_range(spark):
    raws = ["[" + "9" * 400 + "]", '{"a": -' + "1" * 310 + "}", "[" + "1" * 300 + "]"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(J.accepted(F.col("raw"))).collect()]
    assert got == [False, False, True]
