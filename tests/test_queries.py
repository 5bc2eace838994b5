"""A sample of registered queries against DuckDB at the smallest size."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = ["clock_parse", "progressive", "hash_retention", "interval_overlap", "timeline_disagreement", "season_rollup", "metric_percentile", "requirement_batch"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def norm(v):
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["metric_percentile", "profile_audit", "profile_expectations", "profile_export", "profile_snapshot"])
def test_percentiles_do_not_depend_on_cuts(spark, monkeypatch, name):
    """Cuts that are others each time they are computed, as parts of a shuffle between executors may be merged in any order.

    Of the fields of a snapshot, status, peers and percentile are compared: its SQL rounds means at halves by the order of its threads.
    """

    def unsteady(value, *_):
        now = F.expr("cast(reflect('java.lang.System', 'nanoTime') as bigint)")
        return F.array_sort(F.array(*[F.max(value) * F.pmod(F.hash(now, F.lit(k)), F.lit(1000)) / 1000 for k in range(63)]))

    def shown(rows):
        return sorted(re.sub(r"(=\w+,\w+,\d+),[^;]*,", r"\1,", repr([norm(x) for x in r])) for r in rows)

    monkeypatch.setattr(F, "percentile_approx", unsteady)
    data = DIR.replace("0.001", "0.01")
    df = entry.queries()[name](spark, data)
    got = shown(df.collect())
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"create view events as select * from '{data}/events.parquet'")
    assert got == shown(c.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]}) q").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("ids", [range(100), [*range(100), 40], [i for i in range(100) if i != 40], [5, 5, 5, 7, None, -1], [None], []])
def test_contiguous_index_on_imperfect_ids(spark, tmp_path, ids):
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["contiguous_index"](spark, str(tmp_path)).first().breaks
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == c.execute(entry.oracle_sql()["contiguous_index"]).fetchone()[0]


def test_presence_fold_has_bounded_sessions_and_its_capacity(spark, tmp_path):
    """Twelve users of one team and block, in two blocks and two months: four sessions, each above eleven."""
    users = [u for u in range(132) if (u % 12 == 1 and u % 7) or (u % 12 == 0 and u % 7 == 0)]
    rows = [(m * 1000 + b * 500 + u, f"2024-0{m}-25 10:00:00", u + b * 924, "view", 1.0, '{"k": 1}') for m in (1, 2) for b in (0, 1) for u in users]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["presence_fold"](spark, str(tmp_path)).collect()
    assert len(users) == 12 and len({r.session for r in got}) == 4
    assert [r.issue for r in got if r.issue] == ["TEAM_CAPACITY_EXCEEDED"] * 8


@pytest.mark.parametrize("name", ["similarity_stability_20", "ranking_stability_20"])
def test_whole_stability(spark, name):
    d = DIR.replace("0.001", "0.01")
    duck = duckdb.connect()
    for t in ("events", "customer", "orders", "lineitem"):
        duck.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    rows = entry.queries()[name](spark, d)
    cols = sorted(rows.columns)
    res = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in res.description]
    got, want = rows.collect(), res.fetchall()
    assert sorted(repr([norm(r[c]) for c in cols]) for r in got) == sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in want)
    assert {r.rep for r in got} == set(range(20))


def test_similarity_stability_has_all_replicates(spark):
    test_whole_stability(spark, "similarity_stability")


def test_result_audit_has_all_rules(spark, monkeypatch):
    """It equals its SQL, and a broken neighbour and a broken ranking are counted by the rules that they break."""
    from touchline.operators import ranking as R
    from touchline.operators import similarity as Sim
    from touchline.plans import queries_shortlist as Q

    d = DIR.replace("0.001", "0.01")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{d}/events.parquet'")
    res = duck.execute(entry.oracle_sql()["result_audit"])
    want = dict(zip([x[0] for x in res.description], res.fetchone(), strict=True))
    assert entry.queries()["result_audit"](spark, d).first().asDict() == want
    assert want["neighbours"] > 0 and want["candidates"] > 0 and all(n == 0 for k, n in want.items() if k not in ("neighbours", "candidates"))
    search, ranked = Sim.search, R.ranked

    def wrong_search(*a, **k):
        found = search(*a, **k)
        found.near = found.near.withColumn("distance", F.when(F.col("rank") == 2, -1.0).otherwise(F.col("distance")))
        return found

    def wrong_ranked(*a, **k):
        status, rows = ranked(*a, **k)
        return status, rows.withColumn("minutes", F.when(F.col("rank") == 1, 1.0).otherwise(F.col("minutes"))).withColumn("score", F.when(F.col("rank") == 3, 99.0).otherwise(F.col("score")))

    monkeypatch.setattr(Sim, "search", wrong_search)
    monkeypatch.setattr(Q.R, "ranked", wrong_ranked)
    got = entry.queries()["result_audit"](spark, d).first()
    assert got.neighbour_order > 0 and got.distance_sums > 0 and got.candidate_minutes > 0 and got.score_order > 0 and got.score_sums > 0
    assert got.self_neighbours == got.excluded_teams == got.weight_sums == got.candidate_components == 0


def test_sessions_are_summed_where_they_were_dealt(spark, monkeypatch):
    """The wide sums of a session, 123 columns, cross no shuffle."""
    from touchline.plans import cohort

    monkeypatch.setattr(cohort, "materialised", lambda df, name: df)
    plan = cohort.Cohort(spark, DIR).base._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Window")]


def test_replicates_hold_only_what_requirements_ask(spark):
    from touchline import settings as S
    from touchline.plans import queries_shortlist as Q
    from touchline.plans.cohort import Cohort

    rows = Q._thinned(Cohort(spark, DIR), 2)
    asked = {(role, m) for role, w in S.REQUIREMENTS.values() for m in w}
    got = {(r.role.split("#")[0], r.metric) for r in rows.select("role", "metric").distinct().collect()}
    assert got and got <= asked and rows.where("not is_ref").isEmpty()
