"""One planted violation for each rule of the audits; fingerprints, raw census, snapshots, reference bitmaps."""

import json
import random

import pytest
from pyspark.sql import functions as F

from touchline import settings as S
from touchline.operators import audits as A
from touchline.operators import fingerprint as Fp
from touchline.operators import reference as Ref
from touchline.sources import census, snapshot


def only(audits, code):
    """The one violated rule of some audits, and that its rows are set aside."""
    found = {k: n for a in audits for k, n in a.counts.items() if k != "rows" and n}
    aside = {c for a in audits for r in a.violations.collect() for c in r.violations}
    assert aside == set(found)
    return found if code is None else found == {code: found.get(code, 0)} and code in found


EVENT = "match_id string, event_id long, index long, player_id long, team_id long"


@pytest.mark.parametrize("code, change", [
    (None, {}),
    ("DUPLICATE_EVENT", {"events": [("m", 2, 3, 1, 10)]}),
    ("UNKNOWN_MATCH", {"events": [("x", 9, 1, 1, 10)], "roster": [("x", 10, 1)]}),
    ("FOREIGN_TEAM", {"events": [("m", 3, 3, 7, 30)], "roster": [("m", 30, 7)]}),
    ("PLAYER_NOT_LISTED", {"events": [("m", 3, 3, 5, 10)]}),
    ("BROKEN_INDEX", {"events": [("m", 3, 4, 1, 10)]}),
    ("EVENTS_WITHOUT_SHEET", {"events": [("n", 4, 1, None, 10)], "matches": [("n", 10, 20)]}),
    ("SHEET_WITHOUT_EVENTS", {"roster": [("n", 10, 1)]}),
])
def test_canonical(spark, code, change):
    events = spark.createDataFrame([("m", 1, 1, 1, 10), ("m", 2, 2, None, 20), *change.get("events", [])], EVENT)
    roster = spark.createDataFrame([("m", 10, 1), ("m", 20, 2), *change.get("roster", [])], "match_id string, team_id long, player_id long")
    matches = spark.createDataFrame([("m", 10, 20), *change.get("matches", [])], "match_id string, home_team_id long, away_team_id long")
    found = only(A.canonical(events, roster, matches), code)
    assert found if code else found == {}


APP = "match_id string, player_id long, team_id long, quality_status string, playing_seconds double, nominal_minutes double"
SPAN = "match_id string, team_id long, player_id long, period int, start double, end double"


@pytest.mark.parametrize("code, apps, presence, positions", [
    (set(), [], [], []),
    ({"UNVALIDATED_INTERVAL"}, [("m", 2, 10, "NEEDS_REVIEW", None, None)], [("m", 10, 2, 1, 0.0, 5.0)], []),
    ({"OTHER_TEAM"}, [("m", 2, 10, "VALIDATED", 60.0, 1.0)], [("m", 20, 2, 1, 0.0, 60.0)], [("m", 20, 2, 1, 0.0, 60.0)]),
    ({"OUTSIDE_PERIOD"}, [("m", 2, 10, "VALIDATED", 200.0, 0.0)], [("m", 10, 2, 1, 2900.0, 3100.0)], [("m", 10, 2, 1, 2900.0, 3100.0)]),
    ({"NOT_POSITIVE", "OVER_CAPACITY"}, [], [("m", 10, 1, 2, 5.0, 5.0)], []),
    ({"OVERLAP"}, [("m", 2, 10, "VALIDATED", 120.0, 2.0)], [("m", 10, 2, 1, 0.0, 60.0), ("m", 10, 2, 1, 0.0, 60.0)], [("m", 10, 2, 1, 0.0, 60.0), ("m", 10, 2, 1, 0.0, 60.0)]),
    ({"DUPLICATE_APPEARANCE"}, [("m", 1, 10, "VALIDATED", 600.0, 10.0)], [], []),
    ({"PRESENCE_TOTAL", "POSITION_TOTAL"}, [("m", 2, 10, "VALIDATED", 61.0, 1.0)], [("m", 10, 2, 1, 0.0, 60.0)], [("m", 10, 2, 1, 0.0, 60.0)]),
    ({"NOMINAL_TOTAL"}, [("m", 2, 10, "VALIDATED", 60.0, 1.5)], [("m", 10, 2, 1, 0.0, 60.0)], [("m", 10, 2, 1, 0.0, 60.0)]),
    ({"TIMELINE"}, [("m", 2, 10, "VALIDATED", 60.0, 1.0)], [("m", 10, 2, 1, 0.0, 60.0)], [("m", 10, 2, 1, 30.0, 90.0)]),
    ({"QUARANTINED_MINUTES"}, [("m", 2, 10, "NEEDS_REVIEW", 60.0, None)], [], []),
    ({"OVER_CAPACITY"}, [("m", p, 10, "VALIDATED", 60.0, 1.0) for p in range(2, 14)], [("m", 10, p, 2, 0.0, 60.0) for p in range(2, 14)], [("m", 10, p, 2, 0.0, 60.0) for p in range(2, 14)]),
])
def test_minutes(spark, code, apps, presence, positions):
    base = ("m", 10, 1, 1, 0.0, 600.0)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (([("m", 1, 10, "VALIDATED", 600.0, 10.0), *apps], APP), ([("m", 1, 3000.0), ("m", 2, 3000.0)], "match_id string, period int, duration double"), ([base, *presence], SPAN), ([base, *positions], SPAN))]
    assert set(only(A.minutes(*frames), None)) == code


SESS = "player_id long, team_id long, match_id string, metric string, numerator double, samples long, missing long, seconds double"
SEAS = "player_id long, team_id long, metric string, numerator double, samples long, missing long, minutes double, value double, per90 double, enough boolean"


@pytest.mark.parametrize("code, change", [
    ({}, {}),
    ({"DUPLICATE_ROW"}, {"s": [(1, 10, "m", "shots", 0.0, 0, 0, 0.0)]}),
    ({"NOT_VALIDATED", "AGGREGATION", "MINUTES"}, {"s": [(1, 10, "x", "shots", 1.0, 1, 0, 60.0)]}),
    ({"WITHOUT_FEATURES"}, {"e": [(1, 10, "y", 5.0)]}),
    ({"EXPOSURE"}, {"e": [(1, 10, "z", 5.0)], "s": [(2, 10, "w", "shots", 1.0, 1, 0, 60.0)], "e2": [(2, 10, "w", 61.0)], "t": [(2, 10, "shots", 1.0, 1, 0, 1.0, 1.0, 90.0, False)], "e3": True}),
    ({"MISSING_ABOVE_SAMPLES"}, {"s": [(2, 10, "w", "shots", 1.0, 1, 2, 60.0)], "e2": [(2, 10, "w", 60.0)], "t": [(2, 10, "shots", 1.0, 1, 2, 1.0, None, None, False)]}),
    ({"UNKNOWN_METRIC"}, {"s": [(2, 10, "w", "luck", 1.0, 1, 0, 60.0)], "e2": [(2, 10, "w", 60.0)], "t": [(2, 10, "luck", 1.0, 1, 0, 1.0, 1.0, 90.0, False)]}),
    ({"COVERAGE"}, {"t": [(3, 10, "shots", 1.0, 1, 0, 1.0, 1.0, 90.0, False)]}),
    ({"VALUE"}, {"s": [(2, 10, "w", "shots", 1.0, 1, 0, 60.0)], "e2": [(2, 10, "w", 60.0)], "t": [(2, 10, "shots", 1.0, 1, 0, 1.0, 2.0, 90.0, False)]}),
    ({"RATE"}, {"s": [(2, 10, "w", "shots", 1.0, 1, 0, 60.0)], "e2": [(2, 10, "w", 60.0)], "t": [(2, 10, "shots", 1.0, 1, 0, 1.0, 1.0, None, False)]}),
    ({"THRESHOLD"}, {"s": [(2, 10, "w", "shots", 1.0, 1, 0, 60.0)], "e2": [(2, 10, "w", 60.0)], "t": [(2, 10, "shots", 1.0, 1, 0, 1.0, 1.0, 90.0, True)]}),
])
def test_features(spark, code, change):
    extra = change.get("e", []) if not change.get("e3") else []
    sessions = spark.createDataFrame([(1, 10, "m", "shots", 2.0, 2, 0, 60.0), *change.get("s", [])], SESS)
    exposure = spark.createDataFrame([(1, 10, "m", 60.0), *extra, *change.get("e2", [])], "player_id long, team_id long, match_id string, seconds double")
    seasons = spark.createDataFrame([(1, 10, "shots", 2.0, 2, 0, 1.0, 2.0, 180.0, False), *change.get("t", [])], SEAS)
    found = only(A.features(sessions, exposure, seasons), None)
    assert set(found) - ({"EXPOSURE"} if code == {"DUPLICATE_ROW"} else set()) - ({"AGGREGATION", "MINUTES"} if code == {"DUPLICATE_ROW"} else set()) == set(code)


SPELLS = "player_id long, team_id long, role string, share double, minutes double, partial boolean, reasons array<string>, eligible boolean, is_ref boolean"


@pytest.mark.parametrize("code, row", [
    ({"DUPLICATE_PROFILE", "DOUBLE_REFERENCE"}, (1, 10, "CB", 0.9, 900.0, False, [], True, True)),
    ({"UNKNOWN_ROLE"}, (2, 10, "XX", 0.9, 900.0, False, [], True, True)),
    ({"ROLE_SHARE"}, (2, 10, "CB", 0.5, 900.0, False, [], True, True)),
    ({"ROLE_LEFT_OUT"}, (2, 10, None, 0.9, 900.0, False, ["MIXED_POSITION_USAGE"], False, False)),
    ({"PARTIAL_FLAG"}, (2, 10, "CB", 0.9, 900.0, True, [], True, True)),
    ({"MINUTES_FLAG"}, (2, 10, "CB", 0.9, 90.0, False, [], True, True)),
    ({"ROLE_FLAG"}, (2, 10, None, 0.5, 900.0, False, [], True, False)),
    ({"ELIGIBLE_FLAG", "REFERENCE_NOT_ELIGIBLE"}, (2, 10, "CB", 0.9, 900.0, False, [], False, True)),
    ({"DOUBLE_REFERENCE"}, (1, 20, "CB", 0.9, 900.0, False, [], True, True)),
])
def test_profiles(spark, code, row):
    spells = spark.createDataFrame([(1, 10, "CB", 0.9, 900.0, False, [], True, True), row], SPELLS)
    none = spark.createDataFrame([], "player_id long, team_id long, role string, metric string, v double, status string, percentile double, peer_count long")
    assert set(only(A.profiles(spells, none), None)) == code


@pytest.mark.parametrize("code, row", [
    (set(), (1, 10, "CB", "shots", 1.0, "AVAILABLE", 50.0, 10)), ({"OUTSIDE"}, (1, 10, "CB", "shots", 1.0, "AVAILABLE", 101.0, 10)), ({"STATUS"}, (1, 10, "CB", "shots", 1.0, "MISSING_METRIC", 50.0, 10)),
    ({"FEW_PEERS", "PEER_COUNT"}, (1, 10, "CB", "shots", 1.0, "AVAILABLE", 50.0, 9)), ({"PEER_COUNT"}, (1, 10, "CB", "shots", 1.0, "AVAILABLE", 50.0, 11)),
])
def test_percentiles(spark, code, row):
    spells = spark.createDataFrame([(p, 10, "CB", 0.9, 900.0, False, [], True, True) for p in range(10)], SPELLS)
    rows = [row if p == 1 else (p, 10, "CB", "shots", 1.0, "AVAILABLE", 50.0, 10) for p in range(10)]
    assert set(only(A.profiles(spells, spark.createDataFrame(rows, "player_id long, team_id long, role string, metric string, v double, status string, percentile double, peer_count long")), None)) == code


@pytest.mark.parametrize("code, change", [
    (set(), {}), ({"DUPLICATE_CANDIDATE"}, {"player_id": 1, "team_id": 11}), ({"ORDER"}, {"score": 90.0, "contribution": 90.0}), ({"COHORT"}, {"eligible": False}), ({"MINUTES"}, {"minutes": 1.0}),
    ({"EXCLUDED_TEAM"}, {"team_id": 99}), ({"COMPONENTS"}, {"metric": ["tackles", "shots"]}), ({"CONTRIBUTIONS"}, {"contribution": 41.0}), ({"WEIGHTS"}, {"weight": 0.5}), ({"SCORE_OUTSIDE"}, {"score": -1.0, "contribution": -1.0}),
])
def test_rankings(spark, code, change):
    r = {"player_id": 2, "team_id": 10, "minutes": 900.0, "score": 40.0, "contribution": 40.0, "weight": 1.0, "eligible": True, "metric": ["tackles"]} | change
    rows = spark.createDataFrame([("s", 1, 10, 900.0, 80.0, 1), ("s", r["player_id"], r["team_id"], r["minutes"], r["score"], 2)], "set string, player_id long, team_id long, minutes double, score double, rank int")
    more = [("s", r["player_id"], r["team_id"], m, r["weight"] / len(r["metric"]), r["contribution"] / len(r["metric"])) for m in r["metric"]]
    parts = spark.createDataFrame([("s", 1, 10, "tackles", 1.0, 80.0), *more], "set string, player_id long, team_id long, metric string, weight double, contribution double")
    asked = spark.createDataFrame([("s", "CB", "tackles", 450.0, [99], 10)], "set string, set_role string, metric string, min_minutes double, excluded array<long>, top_k int")
    spells = spark.createDataFrame([(1, 10, "CB", True), (r["player_id"], r["team_id"], "CB", r["eligible"])], "player_id long, team_id long, role string, eligible boolean")
    assert set(only(A.rankings(rows, parts, asked, spells), None)) == code


def test_fingerprints_do_not_depend_on_order_and_merge(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, "x", "xy", "1:x"]), rng.choice([None, 1, 12, 2])) for _ in range(500)]
    cols = ["s", "n"]
    first = spark.createDataFrame(rows, "p string, s string, n int").repartition(4)
    second = spark.createDataFrame(sorted(rows, key=repr), "p string, s string, n int").repartition(2)
    whole = lambda d: sorted(map(tuple, d.collect()))
    assert whole(Fp.digests(first, ["p"], cols)) == whole(Fp.digests(second, ["p"], cols))
    assert Fp.differences(first, second, ["p"], cols).count() == 0
    parts = Fp.digests(first.withColumn("q", F.monotonically_increasing_id() % 7), ["p", "q"], cols)
    assert whole(Fp.merged(parts, ["p"])) == whole(Fp.digests(first, ["p"], cols))
    changed = rows[1:] + [("a", "new", None), ("a", "new", None), ("c", None, None)]
    got = {(r.p, r.s, r.n): (r.n_first, r.n_second) for r in Fp.differences(first, spark.createDataFrame(changed, "p string, s string, n int"), ["p"], cols).collect()}
    k = rows.count(rows[0])
    assert got == {rows[0]: (k, k - 1), ("a", "new", None): (0, 2), ("c", None, None): (0, 1)}
    # values that only look alike together
    a = spark.createDataFrame([("1", "2:x", "")], "a string, b string, c string")
    b = spark.createDataFrame([("1", "2", "x")], "a string, b string, c string")
    assert Fp.compared(*(Fp.digests(x.withColumn("p", F.lit(1)), ["p"], ["a", "b", "c"]) for x in (a, b)), ["p"]).first().differs


def test_raw_records_against_canonical(spark, tmp_path):
    for key, ids in (("m1", ["a", "b", "c"]), ("m2", ["d"]), ("m3", ["e", "f"])):
        (tmp_path / f"{key}.json").write_text(json.dumps([{"id": i, "nested": {"x": [1, 2]}} for i in ids]))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "empty.json").write_text("[]")
    raw = census.raw_records(spark, str(tmp_path))
    assert sorted((r.key, r.place, r.id) for r in raw.where("id is not null").collect()) == [("m1", 0, "a"), ("m1", 1, "b"), ("m1", 2, "c"), ("m2", 0, "d"), ("m3", 0, "e"), ("m3", 1, "f")]
    assert {r.key for r in raw.where("record is null").collect()} == {"bad", "empty"}
    canonical = spark.createDataFrame([("m1", "a"), ("m1", "c"), ("m2", "d"), ("m2", "d"), ("m3", "e"), ("m3", "f"), ("m9", "z")], "key string, id string")
    got = sorted((r.key, r.id, r.code) for r in census.reconciled(raw, canonical).collect())
    assert got == [("m1", "b", "DROPPED"), ("m2", "d", "DOUBLED"), ("m9", "z", "FOREIGN")]


def test_snapshot_is_ordered_nested_and_pruned(spark, tmp_path):
    spells = spark.createDataFrame([(p, p % 2, r) for p in range(50) for r in ("CB",)], "player_id long, team_id long, role string").withColumn("role", F.when(F.col("player_id") % 3 == 0, "ST").otherwise("CB"))
    metrics = spark.createDataFrame([(p, p % 2, m, 1.0, None, 1.0, "AVAILABLE", 50.0, 10) for p in range(49) for m in reversed(S.METRICS)], "player_id long, team_id long, metric string, value double, per90 double, coverage double, status string, percentile double, peer_count long")
    rows = snapshot.nested_profiles(spells, metrics.repartition(5))
    path = f"{tmp_path}/snapshot"
    snapshot.write_snapshot(rows, path, "role", ["player_id"])
    with pytest.raises(Exception, match="(?i)exist"):
        snapshot.write_snapshot(rows, path, "role", ["player_id"])
    back = spark.read.parquet(path).where("role = 'CB'").collect()
    assert [m.metric for m in back[0].metrics] == S.METRICS and set(back[0].metrics[0].asDict()) == {"metric", "value", "per90", "unit", "coverage", "status", "percentile", "peer_count"}
    for part in (tmp_path / "snapshot" / "role=CB").glob("*.parquet"):
        ids = [r.player_id for r in spark.read.parquet(str(part)).collect()]
        assert ids == sorted(ids)
    wanted = spark.createDataFrame([("ST",)], "role string")
    loaded = snapshot.load_partitions(spark, path, "role", wanted.where("role > 'A'"))
    assert "dynamicpruning" in loaded._jdf.queryExecution().toString().lower()
    assert {r.role for r in loaded.collect()} == {"ST"}


def test_reference_bitmaps(spark):
    rows = [(p, 1, "CB", m, None if (p % 7 == 0 and m == "shots") else 1.0, p % 2 == 0) for p in [*range(0, 100), 32768, 32770, 100_000] for m in ("tackles", "shots")]
    long = spark.createDataFrame(rows, "player_id long, team_id long, role string, metric string, v double, is_ref boolean")
    sets = spark.createDataFrame([("x", "tackles"), ("x", "shots"), ("y", "tackles")], "set string, metric string")
    members = Ref.members(long, sets)
    maps = Ref.bitmaps(members)
    want = {"CB:shots+tackles": {p for p, *_ in rows if p % 2 == 0 and p % 7}, "CB:tackles": {p for p, *_ in rows if p % 2 == 0}}
    assert {r.key: r.peer_count for r in Ref.counted(maps).collect()} == {k: len(v) for k, v in want.items()}
    asked = spark.createDataFrame([(k, p) for k in [*want, "ST:tackles"] for p in [*range(0, 200), 32767, 32768, 32769, 32770, 65536, 100_000]], "key string, player_id long")
    got = {}
    for r in Ref.listed(maps, asked).collect():
        got.setdefault(r.key, set()).add(r.player_id)
    assert got == want


@pytest.mark.parametrize("code, rows, seconds", [
    (set(), [], []), ({"DUPLICATE_IDENTITY"}, [(1, 10, 600.0, "nominal")], []), ({"ROLE_SECONDS"}, [(2, 10, 60.0, "nominal")], [(2, 10, "CB", 61.0)]),
    ({"INVALID_SECONDS"}, [(2, 10, 60.0, "nominal")], [(2, 10, "CB", 61.0), (2, 10, "ST", -1.0)]), ({"UNKNOWN_ROLE"}, [(2, 10, 60.0, "nominal")], [(2, 10, "XX", 60.0)]),
    ({"NO_EXPOSURE"}, [(2, 10, 0.0, "nominal")], []), ({"CONVENTION"}, [(2, 10, 60.0, "elapsed")], [(2, 10, "CB", 60.0)]),
])
def test_profile_inputs(spark, code, rows, seconds):
    found = A.profile_inputs(spark.createDataFrame([(1, 10, 600.0, "nominal"), *rows], "player_id long, team_id long, playing_seconds double, minutes_convention string"), spark.createDataFrame([(1, 10, "CB", 600.0), *seconds], "player_id long, team_id long, role string, seconds double"), "nominal")
    assert set(only(found, None)) == code
    if code:
        with pytest.raises(ValueError, match=min(code)):
            A.require(found)
    else:
        A.require(found)


def test_cohort_report(spark):
    from touchline.operators import quality as Q

    apps = spark.createDataFrame([("m", 1, "VALIDATED", True), ("m", 2, "NEEDS_REVIEW", True), ("m", 3, "EXCLUDED", False), ("m", 4, "EXCLUDED", True)], "match_id string, player_id long, quality_status string, used boolean")
    issues = spark.createDataFrame([("A",), ("A",), ("B",)], "code string")
    roster = spark.createDataFrame([("m", p) for p in range(1, 5)], "match_id string, player_id long")
    r = Q.Reconciled(apps, None, None, None, issues)
    got = {(x["kind"], x["name"]): x.n for x in Q.cohort_report(r, roster).collect()}
    assert got == {("appearances", "VALIDATED"): 1, ("appearances", "NEEDS_REVIEW"): 1, ("appearances", "unused_roster"): 1, ("appearances", "EXCLUDED"): 1, ("issues", "A"): 2, ("issues", "B"): 1, ("roster", "entries"): 4}
    with pytest.raises(ValueError, match="roster of 3"):
        Q.cohort_report(r, roster.limit(3))


def test_counts_of_copies_are_not_sent_with_the_tasks(spark):
    """Rows of an explode are estimated as one a row, which made Spark gather the counts of all of them on the driver."""
    rows = spark.range(100).select("id", F.explode(F.array(*[F.lit(m) for m in S.METRICS])).alias("metric"))
    df = A.copies(rows, ["id", "metric"])
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 100 * len(S.METRICS) and df.where("copies <> 1").count() == 0


def test_sessions_are_audited_where_they_are_and_only_violations_are_written(spark, monkeypatch):
    plans, old = [], A.materialised

    def kept(df, name, **options):
        out = old(df, name, **options)
        plans.append((df._jdf.queryExecution().executedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(A, "materialised", kept)
    keys = ["player_id", "team_id", "match_id"]
    rows = [(p, 10, "m", m, 2.0, 3 if p == 7 else 2, 3 if p != 7 else 0, 60.0) for p in range(20) for m in ("shots", "xg")]
    sessions = spark.createDataFrame(rows, SESS).repartition(4, *keys)
    exposure = spark.createDataFrame([(p, 10, "m", 60.0) for p in range(20)], "player_id long, team_id long, match_id string, seconds double").hint("merge")
    seasons = spark.createDataFrame([], SEAS)
    first = A.features(sessions, exposure, seasons)[0]
    plan, written = plans[0]
    # the sessions as they come, and the exposure
    assert plan.count("Exchange hashpartitioning") <= 2
    assert first.counts["rows"] == 40 and first.counts["MISSING_ABOVE_SAMPLES"] == written == 38
