import pytest
from pyspark.sql import functions as F

from touchline import settings as S
from touchline.functions import scalars as X
from touchline.operators import intervals as I
from touchline.operators import presence as Pr
from touchline.operators import profiles as P
from touchline.sources.json import accepted


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict()


def test_metrics_are_whole():
    assert len(S.METRICS) == 41 == len(set(S.METRICS))
    assert sum(S.normalized({"a": 1e308, "b": 1e308}).values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        S.normalized({"a": 0.0})


def test_clocks(spark):
    t = {"ok": "00:59:59.500", "minute": "00:60:00.000", "second": "00:00:60.000", "word": "bad"}
    got = one(spark, **{k: X.clock_seconds(F.lit(v)) for k, v in t.items()})
    assert got == {"ok": 3599.5, "minute": None, "second": None, "word": None}


def test_progressive_edges(spark):
    at = lambda x: X.progressive(F.lit(60.0), F.lit(40.0), F.lit(x), F.lit(40.0))
    assert one(spark, a=at(75.0), b=at(74.99), c=at(None).cast("boolean")) == {"a": True, "b": False, "c": None}


def test_age(spark):
    day = lambda s: F.to_date(F.lit(s))
    got = one(spark, before=X.age_status(day("2000-05-18"), day("2024-05-17"), 23), on=X.age_status(day("2000-05-18"), day("2024-05-18"), 23), leap=X.age_on(day("2000-02-29"), day("2023-02-28")))
    assert got == {"before": "ELIGIBLE", "on": "INELIGIBLE", "leap": 22}


def test_rates(spark):
    value, per90, coverage = X.rates(F.lit("pass_completion_pct"), F.lit(1.0), F.lit(4), F.lit(0), F.lit(100.0))
    assert one(spark, v=value, p=per90, c=coverage) == {"v": 25.0, "p": None, "c": 1.0}
    value, per90, _ = X.rates(F.lit("passes_completed"), F.lit(1.0), F.lit(2), F.lit(1), F.lit(45.0))
    assert one(spark, v=value, p=per90) == {"v": None, "p": None}


def test_mid_rank_and_outsiders(spark):
    rows = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True), ("a", 2.0, True), ("a", 4.0, True), ("a", 3.0, False), ("b", 5.0, True), ("b", 5.0, True)], "g string, v double, in_ref boolean")
    got = {(r.g, r.v): r.pct for r in P.mid_rank(rows, ["g"]).collect()}
    assert got == {("a", 1.0): 12.5, ("a", 2.0): 50.0, ("a", 3.0): 75.0, ("a", 4.0): 87.5, ("b", 5.0): None}


def test_union_and_disagreement(spark):
    a = spark.createDataFrame([(1, 0, 1800), (1, 900, 2700), (1, 0, 1800)], "k long, start long, end long")
    assert I.union_length(a, ["k"]).first().covered == 2700
    b = spark.createDataFrame([(1, 100, 2700)], "k long, start long, end long")
    assert I.disagreement(a, b, ["k"]).first().differs == 100


def test_strict_json(spark):
    raws = ['{"a":1}', '{"id":1,"id":2}', "[NaN]", "[1e309]", "[1e30]", '{"t":"1e309"}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raws], "raw string").select(accepted(F.col("raw"))).collect()]
    assert got == [True, False, False, False, True, True]


TRANSITIONS = "session string, kind string, player_id long, other_id long, period int, at double, index long, permanent boolean, card string"


def session(moves):
    rows = [("s", "Starter", p, None, 1, 0.0, 0, False, None) for p in range(1, 12)]
    rows += [("s", "Period End", -1, None, p, e, 0, False, None) for p, e in ((1, 3000.0), (2, 3300.0))]
    rows += [("s", k, p, o, per, at, i, perm, card) for i, (k, p, o, per, at, perm, card) in enumerate(moves)]
    return rows


@pytest.mark.parametrize(
    "moves, player, seconds",
    [
        ([], 1, 6300.0),
        ([("Substitution", 1, 12, 2, 1800.375, False, None)], 1, 4800.375),
        ([("Substitution", 1, 12, 2, 1800.375, False, None)], 12, 1499.625),
        ([("Player Off", 1, None, 1, 60.125, False, None), ("Player On", 1, None, 1, 90.875, False, None)], 1, 6269.25),
        ([("Foul", 1, None, 2, 1234.567, False, "Red Card")], 1, 4234.567),
        ([("Player Off", 1, None, 1, 60.0, True, None)], 1, 60.0),
    ],
)
def test_presence(spark, moves, player, seconds):
    got = Pr.presence(spark.createDataFrame(session(moves), TRANSITIONS)).toPandas()
    own = got[got.player_id == player]
    assert (own.end - own.start).sum() == pytest.approx(seconds)
    assert got.issue.isna().all()


def test_presence_refuses_and_cascades(spark):
    moves = [("Substitution", 99, 12, 1, 10.0, False, None), ("Substitution", 12, 13, 1, 20.0, False, None), ("Player On", 1, None, 1, 30.0, False, None)]
    got = Pr.presence(spark.createDataFrame(session(moves), TRANSITIONS)).toPandas()
    assert got.issue.dropna().tolist() == ["INVALID_SUBSTITUTION_STATE"] * 4 + ["PLAYER_ON_WITHOUT_TEMPORARY_EXIT"]


def test_cuts_of_buckets_are_made_once(spark):
    """Approximate cuts that are computed again where they are used may differ, and ranks with them."""
    from touchline.operators.order import bucketed
    from touchline.operators.profiles import mid_rank

    rows = spark.range(4000).selectExpr("'a' as g", "cast(id % 2000 as double) as v", "true as in_ref")
    ranks = mid_rank(rows, ["g"])
    for df in (ranks, *bucketed(rows, ["g"], "v", F.count("*"))):
        assert "percentile_approx" not in df._jdf.queryExecution().executedPlan().toString()
    assert all(r.pct == (2 * r.v + 1) * 100 / 4000 for r in ranks.collect())


def test_points_are_rounded_as_in_sql(spark):
    """Minutes of whole microseconds are often just at a half of the last digit."""
    import duckdb

    us = [1030743090870, *range(1030743090000, 1030743099000, 30), -1030743090870]
    want = duckdb.sql(f"select round(x / 60000000e0, 6), round(x / 60000000e0, 9) from (select unnest({us}) as x) t").fetchall()
    rows = spark.createDataFrame([(x,) for x in us], "x long").select(X.point(F.col("x") / 60_000_000), X.point(F.col("x") / 60_000_000, 9))
    assert sorted(map(tuple, rows.collect())) == sorted(want)
