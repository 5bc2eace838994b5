"""Match reconciliation on a small match: two teams of eleven starters and one unused player, periods of 3,000 and 3,300 s."""

import pytest

from touchline.operators import quality as Q
from touchline.operators.presence import presence

EVENTS = (
    "match_id string, event_id string, index long, period int, elapsed double, event_type string, team_id long, player_id long, replacement_id long, card string, "
    "permanent boolean, boundary_flags array<string>, quality_flags array<string>, tactical array<struct<player_id:long,position_name:string>>"
)
POINT = "struct<period:int,elapsed:double>"
POSITIONS = f"match_id string, team_id long, player_id long, position_id int, position_name string, start {POINT}, end {POINT}, quality_flags array<string>"
CARDS = f"match_id string, player_id long, card_type string, time {POINT}"
ENDS = {1: 3000.0, 2: 3300.0}


class Match:
    """Rows of one match; its name is given when all matches are put together."""

    def __init__(self, ends=ENDS):
        self.ends = ends
        self.roster = [("m", t, t * 100 + i) for t in (1, 2) for i in range(12)]
        self.positions = [["m", t, t * 100 + i, 14, "Centre", (1, 0.0), None, []] for t in (1, 2) for i in range(11)]
        self.cards, self.events = [], []
        for t in (1, 2):
            self.event("Starting XI", 1, 0.0, t, tactical=[(t * 100 + i, "Centre") for i in range(11)])
            for p, end in ends.items():
                self.event("Half Start", p, 0.0, t)
                self.event("Half End", p, end, t)

    def event(self, kind, period, at, team=1, player=None, other=None, card=None, permanent=None, boundary=(), flags=(), tactical=None):
        n = len(self.events)
        self.events.append(["m", f"e{n}", n, period, at, kind, team, player, other, card, permanent, list(boundary), list(flags), tactical])
        return self


def fatal(code):
    m = Match()
    if code == "UNRELIABLE_PERIOD_BOUNDARY":
        m.events[2][11] = ["early_video_end"]
    elif code == "EVENT_AFTER_PERIOD_END":
        m.event("Pass", 2, 3300.5, 1, 100)
    elif code == "MISSING_OR_DUPLICATE_STARTING_XI":
        m.event("Starting XI", 1, 0.0, 1, tactical=[(100, "Centre")])
    elif code == "STARTING_XI_NOT_ELEVEN_UNIQUE":
        m.events[0][13] = m.events[0][13][:10]
    elif code == "INCOMPLETE_PLAYABLE_PERIODS":
        m.events = [e for e in m.events if e[3] == 1]
    elif code == "UNREVIEWED_EVENT_TYPE":
        m.event("Other", 1, 5.0, 1, 100, flags=["UNREVIEWED_EVENT_TYPE"])
    elif code == "CROSS_TEAM_PLAYER_ID_COLLISION":
        m.roster.append(("m", 2, 100))
    elif code == "CANONICAL_IDENTITY_FAILURE":
        m.event("Pass", 1, 5.0, 1, 999)
    return m


FATAL = ["UNRELIABLE_PERIOD_BOUNDARY", "EVENT_AFTER_PERIOD_END", "MISSING_OR_DUPLICATE_STARTING_XI", "STARTING_XI_NOT_ELEVEN_UNIQUE", "INCOMPLETE_PLAYABLE_PERIODS", "UNREVIEWED_EVENT_TYPE", "CROSS_TEAM_PLAYER_ID_COLLISION", "CANONICAL_IDENTITY_FAILURE"]


def local(code):
    m = Match()
    if code == "ACTION_OUTSIDE_RECONSTRUCTED_PRESENCE":
        m.event("Player Off", 1, 60.0, 1, 100, permanent=True).event("Pass", 1, 70.0, 1, 100)
        m.positions[0][6] = (1, 60.0)
    elif code == "POSITION_PRESENCE_DISAGREEMENT":
        m.positions[0][6] = (2, 100.0)
    elif code == "OVERLAPPING_SOURCE_POSITIONS":
        m.positions.append(["m", 1, 100, 15, "Left", (2, 100.0), None, []])
    elif code == "STARTING_POSITION_DISAGREEMENT":
        m.positions[0][4] = "Left"
    elif code == "INVALID_SOURCE_POSITION":
        m.positions.append(["m", 1, 100, 15, "Left", (2, 100.0), (1, 5.0), ["REVERSED"]])
    elif code == "UNMAPPED_POSITION":
        m.positions[0][3] = 99
    elif code == "APPEARANCE_WITHOUT_POSITION_EVIDENCE":
        m.positions.pop(0)
    elif code == "PLAYER_ON_WITHOUT_TEMPORARY_EXIT":
        m.event("Player On", 1, 30.0, 1, 100)
    elif code == "POSITION_PERIOD_OUTSIDE_MATCH":
        m.positions.append(["m", 1, 100, 15, "Left", (3, 0.0), None, []])
    elif code == "AMBIGUOUS_SOURCE_CARD":
        m.event("Foul Committed", 1, 5.0, 1, 100, card="Yellow Card").event("Foul Committed", 1, 9.0, 1, 100, card="Yellow Card")
        m.cards.append(("m", 100, "Yellow Card", None))
    return m


CODES = ["ACTION_OUTSIDE_RECONSTRUCTED_PRESENCE", "POSITION_PRESENCE_DISAGREEMENT", "OVERLAPPING_SOURCE_POSITIONS", "STARTING_POSITION_DISAGREEMENT", "INVALID_SOURCE_POSITION", "UNMAPPED_POSITION", "APPEARANCE_WITHOUT_POSITION_EVIDENCE", "PLAYER_ON_WITHOUT_TEMPORARY_EXIT", "POSITION_PERIOD_OUTSIDE_MATCH", "AMBIGUOUS_SOURCE_CARD"]



def substitution():
    m = Match().event("Substitution", 2, 1800.375, 1, 100, 111)
    m.positions[0][6] = (2, 1800.0)
    m.positions.append(["m", 1, 111, 14, "Centre", (2, 1800.0), None, []])
    return m.event("Pass", 2, 2000.0, 1, 111)


def dismissal():
    m = Match().event("Foul Committed", 2, 1234.567, 1, 100, card="Red Card")
    m.positions[0][6] = (2, 1234.0)
    m.cards = [("m", 100, "Red Card", (2, 1234.0)), ("m", 101, "Yellow Card", None), ("m", 102, "Second Yellow", (1, 5.0))]
    return m


def warnings():
    m = Match()
    m.positions.append(["m", 1, 100, 15, "Left", (1, 0.0), (1, 0.0), ["ZERO_DURATION_POSITION_OBSERVATION"]])
    m.event("Foul Committed", 1, 5.0, 1, 101, card="Yellow Card").event("Bad Behaviour", 1, 7.0, 1, 111, card="Red Card").event("Pass", 1, 8.0, 2, 211)
    m.cards.append(("m", 101, "Yellow Card", None))
    return m


@pytest.fixture(scope="module")
def matches(spark):
    """All cases as matches of one run: {name: (appearances by player, issues, presence, positions, periods)}."""
    cases = {"full": Match(), "substitution": substitution(), "dismissal": dismissal(), "extra time": Match(ENDS | {3: 1000.0, 4: 1100.0}), "warnings": warnings()}
    cases |= {c: fatal(c) for c in FATAL} | {c: local(c) for c in CODES}

    def table(part, schema):
        return spark.createDataFrame([(name, *row[1:]) for name, m in cases.items() for row in getattr(m, part)], schema)

    r = Q.reconcile(table("events", EVENTS), table("roster", "match_id string, team_id long, player_id long"), table("positions", POSITIONS), table("cards", CARDS))
    out = {name: ({}, set(), [], [], []) for name in cases}
    for a in r.appearances.collect():
        out[a.match_id][0][a.player_id] = a
    for i in r.issues.collect():
        out[i.match_id][1].add((i.player_id, i.code))
    for k, rows in ((2, r.presence), (3, r.positions), (4, r.periods)):
        for x in rows.collect():
            out[x.match_id][k].append(x)
    census = {(x.quality_status, x.used): (x.n, x.seconds) for x in Q.report(r).collect()}
    assert census["VALIDATED", True][0] == sum(a.quality_status == "VALIDATED" for m in out.values() for a in m[0].values())
    return out


def statuses(apps):
    return {s: sum(a.quality_status == s for a in apps.values()) for s in ("VALIDATED", "NEEDS_REVIEW", "EXCLUDED")}


def test_full_match(matches):
    apps, issues, present, placed, periods = matches["full"]
    assert statuses(apps) == {"VALIDATED": 22, "NEEDS_REVIEW": 0, "EXCLUDED": 2} and issues == set()
    assert {a.playing_seconds for a in apps.values() if a.used} == {6300.0} and {a.nominal_minutes for a in apps.values() if a.used} == {90.0}
    assert len(present) == len(placed) == 44 and len(periods) == 2


def test_substitution_with_snapped_position(matches):
    apps, issues, *_ = matches["substitution"]
    assert (apps[100].playing_seconds, apps[111].playing_seconds) == (4800.375, 1499.625) and issues == set()


def test_dismissal_and_cards(matches):
    apps, issues, *_ = matches["dismissal"]
    assert apps[100].playing_seconds == 4234.567
    assert issues == {(101, "LINEUP_CARD_WITHOUT_EVENT"), (102, "LINEUP_CARD_WITHOUT_EVENT")}
    assert apps[101].quality_status == "VALIDATED" and apps[102].quality_status == "NEEDS_REVIEW"


def test_extra_time(matches):
    apps = matches["extra time"][0]
    assert apps[100].playing_seconds == 8400.0 and apps[100].nominal_minutes == 120.0


@pytest.mark.parametrize("code", FATAL)
def test_fatal_issues(matches, code):
    apps, issues, *rows = matches[code]
    assert (None, code) in issues and all(a.playing_seconds is None for a in apps.values()) and rows == [[], [], []]
    assert all(a.quality_status == "NEEDS_REVIEW" for a in apps.values() if a.used)


@pytest.mark.parametrize("code", CODES)
def test_local_conflicts(matches, code):
    apps, issues, *_ = matches[code]
    assert (100, code) in issues and {p for p, _ in issues} == {100}
    assert apps[100].quality_status == "NEEDS_REVIEW" and apps[100].playing_seconds is None
    assert statuses(apps) == {"VALIDATED": 21, "NEEDS_REVIEW": 1, "EXCLUDED": 2}


def test_warnings_and_unused_players(matches):
    apps, issues, *_ = matches["warnings"]
    assert issues == {(100, "ZERO_DURATION_POSITION_OBSERVATION"), (101, "CARD_CLOCK_RESOLVED_FROM_EVENT"), (111, "BENCH_OR_POST_EXIT_DISMISSAL"), (211, "EVENT_FOR_UNUSED_ROSTER_PLAYER")}
    assert apps[100].playing_seconds == 6300.0 and apps[111].quality_status == "EXCLUDED" and apps[211].quality_status == "NEEDS_REVIEW"


def test_capacity(spark):
    rows = spark.createDataFrame([("s", "Starter", p, None, 1, 0.0, 0, False, None) for p in range(12)] + [("s", "Period End", -1, None, 1, 10.0, 0, False, None)], "session string, kind string, player_id long, other_id long, period int, at double, index long, permanent boolean, card string")
    assert [r.issue for r in presence(rows).collect() if r.issue] == ["TEAM_CAPACITY_EXCEEDED"]
