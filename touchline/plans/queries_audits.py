"""Queries of fingerprints, audits, raw census, snapshots and reference sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions import scalars as X
from ..operators import audits as Au
from ..operators import contracts
from ..operators import fingerprint as Fp
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import reference as Ref
from ..operators import similarity as Sim
from ..operators import statistics as St
from ..sources import sinks, snapshot
from ..sources.shared import shared_folder
from .binding import ACTIONS_SQL, actions, exposed, table
from .cohort import SESSION, SPELL, Cohort, cohort_sql
from .queries_basic import SPANS, _spans
from .queries_shortlist import BASE, FEATS, RANK, SIM, _requirements, _wide

QUERIES, ORACLE = {}, {}
A = f"with {ACTIONS_SQL}"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# --- fingerprints --------------------------------------------------------------------------------------


def _text(*columns: str) -> str:
    return " || ".join(f"coalesce(length(cast({c} as varchar))::varchar || ':' || cast({c} as varchar), '-')" for c in columns)


def _digest_sql(source: str, by: str, *columns: str) -> str:
    return f"""select {by}, count(*) as n, cast(sum(strlen(t)) as bigint) as bytes, cast(sum(h) as varchar) as hash_sum, cast(bit_xor(h) as varchar) as hash_xor
from (select *, cast('0x' || substr(md5(t), 1, 15) as bigint) as h from (select *, {_text(*columns)} as t from {source}) x) y group by {by}"""


def _shown(digests):
    return digests.withColumns({k: F.col(k).cast("string") for k in ("hash_sum", "hash_xor")})


_TABLES = {"events": ("event_type", ["event_id", "user_id", "props"]), "lineitem": ("l_returnflag", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]), "orders": ("o_orderstatus", ["o_orderkey", "o_custkey", "o_orderpriority"])}


@query(" union all ".join(f"select '{t}' as name, {by} as part, * exclude ({by}) from ({_digest_sql(t, by, *cols)}) d" for t, (by, cols) in _TABLES.items()))
def table_fingerprint(spark, d):
    """Rows, bytes and order-independent digest of each part of a table."""
    out = None
    for name, (by, cols) in _TABLES.items():
        rows = _shown(Fp.digests(table(spark, d, name), [by], cols)).select(F.lit(name).alias("name"), F.col(by).alias("part"), *Fp.DIGEST)
        out = rows if out is None else out.unionByName(rows)
    return out


_WAYS = A + """,
one as (select match_id, player_id, cast(sum(dur) as bigint) as us from exposed group by all),
parts as (select match_id, player_id, team_id, period, cast(sum(dur) as bigint) as us from exposed group by all),
two as (select match_id, player_id, cast(sum(us) as bigint) as us from parts group by all)"""


@query(_WAYS + f""",
a as ({_digest_sql("one", "match_id", "player_id", "us")}), b as ({_digest_sql("two", "match_id", "player_id", "us")})
select coalesce(a.match_id, b.match_id) as match_id, coalesce(a.n, 0) as n_first, coalesce(b.n, 0) as n_second, a.hash_sum as first_sum, b.hash_sum as second_sum,
  not (a.n is not distinct from b.n and a.hash_sum is not distinct from b.hash_sum and a.hash_xor is not distinct from b.hash_xor and a.bytes is not distinct from b.bytes) as differs
from a full join b on a.match_id = b.match_id""")
def replay_digests(spark, d):
    """Exposure in two ways, compared by match: only matches with unlike digests would be read row by row."""
    e = exposed(actions(spark, d))
    one = e.groupBy("match_id", "player_id").agg(F.sum("dur").alias("us"))
    two = e.groupBy("match_id", "player_id", "team_id", "period").agg(F.sum("dur").alias("us")).groupBy("match_id", "player_id").agg(F.sum("us").alias("us"))
    a, b = (Fp.digests(x, ["match_id"], ["player_id", "us"]) for x in (one, two))
    sums = lambda x, name: x.select("match_id", F.col("hash_sum").cast("string").alias(name))
    return Fp.compared(a, b, ["match_id"]).join(sums(a, "first_sum"), "match_id", "left").join(sums(b, "second_sum"), "match_id", "left")


@query("""select event_id, user_id, props, count(*) filter (where side = 1) as n_first, count(*) filter (where side = 2) as n_second from (
  select event_type, event_id, user_id, props, 1 as side from events
  union all select event_type, event_id, user_id + case when event_id % 997 = 0 then 1 else 0 end, props, 2 from events where event_id % 1009 <> 1) x group by all having n_first <> n_second""")
def replay_differences(spark, d):
    """A replay in which some rows were changed and some lost: each is named."""
    first = table(spark, d, "events")
    second = first.where("event_id % 1009 <> 1").withColumn("user_id", F.col("user_id") + F.when(F.col("event_id") % 997 == 0, 1).otherwise(0))
    cols = ["event_id", "user_id", "props"]
    return Fp.differences(first, second, ["event_type"], cols).select(*cols, "n_first", "n_second")


@query(A + """,
origin as (select event_id, day(ts) as match_id, cast(json_extract(props, '$.k') as int) as k from events),
a as (select match_id, count(*) as n, sum(k) as ks from origin group by all), b as (select match_id, count(*) as n, sum(k) as ks, count(distinct event_id) as ids from actions group by all)
select coalesce(a.match_id, b.match_id) as match_id, coalesce(a.n, 0) as n_raw, coalesce(b.n, 0) as n_canonical, coalesce(ids, 0) as n_ids, cast(coalesce(a.ks, 0) as bigint) as raw_sum, cast(coalesce(b.ks, 0) as bigint) as canonical_sum
from a full join b on a.match_id = b.match_id""")
def ingest_census(spark, d):
    """Raw records, read as VARIANT, against the canonical actions made of them, by match."""
    raw = table(spark, d, "events").select("event_id", F.dayofmonth("ts").cast("long").alias("match_id"), F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))
    a = raw.groupBy("match_id").agg(F.count("*").alias("n_raw"), F.sum("k").alias("raw_sum"))
    b = actions(spark, d).groupBy("match_id").agg(F.count("*").alias("n_canonical"), F.count_distinct("event_id").alias("n_ids"), F.sum("k").alias("canonical_sum"))
    rows = a.join(b, "match_id", "full")
    return rows.select("match_id", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n_raw", "n_canonical", "n_ids", "raw_sum", "canonical_sum")])


# --- audits --------------------------------------------------------------------------------------------


def _census_sql(audit: str, source: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select '{audit}' as audit, '{code}' as rule, (select count(*) from {source}) as rows, (select count(*) from {source} where coalesce({bad}, false)) as violations" for code, bad in rules.items())


_BASE_SECONDS = S.NOMINAL_SECONDS[1]
_MINUTES = SPANS + f""",
pr as (select match_id, team_id, player_id, period, start / 1e6 as start, "end" / 1e6 as "end" from pres), po as (select match_id, team_id, player_id, period, start / 1e6 as start, "end" / 1e6 as "end" from posn),
tot as (select match_id, player_id, sum("end" - start) as s, sum(greatest(0, least("end", {_BASE_SECONDS}) - least(start, {_BASE_SECONDS}))) / 60 as nom from pr group by all),
tpo as (select match_id, player_id, sum("end" - start) as s from po group by all),
app0 as (select match_id, player_id, min(team_id) as team_id, bool_and(valid) as valid from actions group by all),
app as (select a.*, case when valid or a.player_id % 3 = 0 then coalesce(t.s, 0) + case when a.player_id % 10 = 0 then 1 else 0 end end as playing_seconds, case when valid then coalesce(t.nom, 0) end as nominal_minutes, coalesce(t.s, 0) as present, coalesce(o.s, 0) as placed
  from app0 a left join tot t on t.match_id = a.match_id and t.player_id = a.player_id left join tpo o on o.match_id = a.match_id and o.player_id = a.player_id),
ivl as (select kind, s.*, a.team_id as app_team, a.valid, max("end") over (partition by kind, s.match_id, s.player_id, period order by start, "end" rows between unbounded preceding and 1 preceding) as reach
  from (select 'presence' as kind, * from pr union all select 'positions', * from po) s left join app a on a.match_id = s.match_id and a.player_id = s.player_id),
pt as (select match_id, player_id, period, start as t, 1 as da, 0 as db from pr union all select match_id, player_id, period, "end", -1, 0 from pr union all select match_id, player_id, period, start, 0, 1 from po union all select match_id, player_id, period, "end", 0, -1 from po),
ps as (select match_id, player_id, period, t, sum(da) as da, sum(db) as db from pt group by all),
sw as (select *, lead(t) over w as nx, sum(da) over (w rows unbounded preceding) as na, sum(db) over (w rows unbounded preceding) as nb from ps window w as (partition by match_id, player_id, period order by t)),
gap as (select match_id, player_id, sum(nx - t) as gap from sw where (na > 0) <> (nb > 0) group by all),
apg as (select a.*, g.gap from app a left join gap g on g.match_id = a.match_id and g.player_id = a.player_id),
ce as (select match_id, team_id, period, t, c, sum(c) as delta from (select match_id, team_id, period, start as t, 1 as c from pr union all select match_id, team_id, period, "end", -1 from pr) x group by all),
cr as (select match_id, team_id, period, sum(delta) over (partition by match_id, team_id, period order by t, c rows unbounded preceding) as open from ce),
cap as (select match_id, team_id, period, max(open) as most, min(open) as least from cr group by all)
"""
_EDGE = S.EDGE


@query(_MINUTES + " union all ".join([
    _census_sql("minutes intervals", "ivl", {"UNVALIDATED_INTERVAL": "not coalesce(valid, false)", "OTHER_TEAM": "app_team <> team_id", "OUTSIDE_PERIOD": '"end" > 43000', "NOT_POSITIVE": '"end" <= start', "OVERLAP": f"start < reach - {_EDGE}"}),
    _census_sql("minutes appearances", "apg", {
        "DUPLICATE_APPEARANCE": "false", "PRESENCE_TOTAL": f"valid and abs(playing_seconds - present) > {_EDGE}", "POSITION_TOTAL": f"valid and abs(playing_seconds - placed) > {_EDGE}",
        "NOMINAL_TOTAL": "false", "TIMELINE": f"valid and gap > {_EDGE}", "QUARANTINED_MINUTES": "not valid and playing_seconds is not null"}),
    _census_sql("minutes capacity", "cap", {"OVER_CAPACITY": "most > 11 or least < 0"}),
]))
def minutes_expectations(spark, d):
    """All rules of the minutes audit on spans of the events, which break most of them: some totals are a second off, some rows in quarantine show minutes, and periods end at 43,000 seconds."""
    own = ["match_id", "team_id", "player_id", "period"]
    pres, posn = (x.select(*own, (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end")) for x in _spans(spark, d))
    a = actions(spark, d)
    person = ["match_id", "player_id"]
    base = F.lit(_BASE_SECONDS)
    total = pres.groupBy(*person).agg(F.sum(F.col("end") - F.col("start")).alias("s"), (F.sum(F.greatest(F.lit(0.0), F.least("end", base) - F.least("start", base))) / 60).alias("nom"))
    app = a.groupBy(*person).agg(F.min("team_id").alias("team_id"), F.bool_and("valid").alias("valid")).join(total, person, "left")
    seconds = F.coalesce("s", F.lit(0.0)) + F.when(F.col("player_id") % 10 == 0, 1).otherwise(0)
    app = app.select(*person, "team_id", F.when(F.col("valid"), "VALIDATED").otherwise("NEEDS_REVIEW").alias("quality_status"), F.when(F.col("valid") | (F.col("player_id") % 3 == 0), seconds).alias("playing_seconds"), F.when(F.col("valid"), F.coalesce("nom", F.lit(0.0))).alias("nominal_minutes"))
    periods = a.select("match_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("period")).distinct().withColumn("duration", F.lit(43000.0))
    return Au.census(spark, Au.minutes(app, periods, pres, posn))


@query(BASE + _census_sql("features of sessions", "session_stats", dict.fromkeys(["DUPLICATE_ROW", "NOT_VALIDATED", "WITHOUT_FEATURES", "EXPOSURE", "MISSING_ABOVE_SAMPLES", "UNKNOWN_METRIC"], "false"))
       + " union all " + _census_sql("features of seasons", "season", dict.fromkeys(["DUPLICATE_ROW", "COVERAGE", "MISSING_ABOVE_SAMPLES", "AGGREGATION", "MINUTES", "VALUE", "RATE"], "false") | {"THRESHOLD": f"(minutes >= 600) <> (minutes >= {S.MIN_MINUTES})"}))
def feature_expectations(spark, d):
    """All rules of the feature audit; the flag of enough minutes is a stale one, of 600."""
    c = Cohort(spark, d)
    seconds = c.appearances.where("valid").select(*SESSION, (F.col("us") / 1e6).alias("seconds"))
    # sessions meet their seconds as wide rows, both sides dealt by session, and stay where they are when they are unpivoted
    sessions = St.unpivoted(St.rolled_up(c.base.where("valid"), SESSION).join(seconds.hint("merge"), SESSION), [*SESSION, "seconds"], S.METRICS)
    return Au.census(spark, Au.features(sessions, seconds, c.season.withColumn("enough", F.col("minutes") >= 600)))


@query(BASE + _census_sql("profiles", "spells", dict.fromkeys(["DUPLICATE_PROFILE", "UNKNOWN_ROLE", "ROLE_SHARE", "ROLE_LEFT_OUT", "PARTIAL_FLAG"], "false") | {"MINUTES_FLAG": f"(minutes < 600) <> (minutes < {S.MIN_MINUTES})"} | dict.fromkeys(["ROLE_FLAG", "ELIGIBLE_FLAG", "REFERENCE_NOT_ELIGIBLE", "DOUBLE_REFERENCE"], "false"))
       + " union all " + _census_sql("percentiles", "percentiles", dict.fromkeys(["OUTSIDE", "STATUS", "FEW_PEERS", "PEER_COUNT", "VALUE"], "false")))
def profile_expectations(spark, d):
    """All rules of the profile audit, asked with a threshold of 600 minutes."""
    c = Cohort(spark, d)
    return Au.census(spark, Au.profiles(c.spells, c.percentiles, min_minutes=600.0))


@query(SIM + RANK[len(cohort_sql()):] + ", shown as (select r.*, r.minutes < 5000 as late from ranked r where rank <= top_k) " + _census_sql("neighbours", "near", dict.fromkeys(["DUPLICATE_NEIGHBOUR", "ORDER", "COHORT", "SELF", "INCOMPLETE", "CONTRIBUTIONS"], "false"))
       + " union all " + _census_sql("rankings", "shown", dict.fromkeys(["DUPLICATE_CANDIDATE", "ORDER", "COHORT"], "false") | {"MINUTES": "late"} | dict.fromkeys(["EXCLUDED_TEAM", "COMPONENTS", "CONTRIBUTIONS", "WEIGHTS", "SCORE_OUTSIDE"], "false")))
def result_expectations(spark, d):
    """All rules of the result audit; rankings are held against a stricter threshold of minutes than they were made with."""
    c = Cohort(spark, d)
    wanted, strict = (R.requirement_table(spark, _requirements(**x)) for x in ({}, {"min_minutes": 5000.0}))
    rows = R.ranked(c.long, wanted, cut=True)[1]
    parts = R.components(c.long, wanted).where("complete").select("set", *SPELL, "metric", "weight", "contribution")
    return Au.census(spark, [*Au.neighbours(Sim.neighbours(_wide(c), FEATS), c.spells), *Au.rankings(rows, parts, strict, c.spells)])


# --- snapshots and reference sets ----------------------------------------------------------------------

_LIST = "[" + ", ".join(f"'{m}'" for m in S.METRICS) + "]"
_UNIT = f"case when metric in ({', '.join(repr(m) for m in S.PERCENTAGES)}) then 'percent' when metric in ({', '.join(repr(m) for m in S.MEANS)}) then 'mean' else 'per90' end"
_MICRO = lambda c: f"coalesce(cast(cast(round({c} * 1e4) as bigint) as varchar), '-')"


@query(cohort_sql() + f""" select p.player_id, p.team_id, p.role, count(*) as fields, string_agg(metric || '=' || {_UNIT} || ',' || status || ',' || peer_count || ',' || {_MICRO("value")} || ',' || {_MICRO("per90")} || ',' || {_MICRO("coverage")} || ',' || {_MICRO("percentile")}, ';' order by list_position({_LIST}, metric)) as metrics
from percentiles q join spells p on p.player_id = q.player_id and p.team_id = q.team_id group by all""")
def profile_snapshot(spark, d):
    """All fields of all metrics, nested in a fixed order; shown as text, fractions in ten-thousandths."""
    c = Cohort(spark, d)
    rows = snapshot.nested_profiles(c.spells.select(*SPELL, "role"), c.percentiles)
    whole = lambda x: F.coalesce(F.round(x * 1e4).cast("long").cast("string"), F.lit("-"))
    text = F.transform("metrics", lambda m: F.concat(m["metric"], F.lit("="), F.concat_ws(",", m["unit"], m["status"], m["peer_count"].cast("string"), whole(m["value"]), whole(m["per90"]), whole(m["coverage"]), whole(m["percentile"]))))
    return rows.select(*SPELL, "role", F.size("metrics").cast("long").alias("fields"), F.array_join(text, ";").alias("metrics"))


@query("select event_type, count(*) as n, sum(user_id)::bigint as users, min(event_id) as least, max(event_id) as most from events where event_type in ('purchase', 'signup') group by all")
def snapshot_load(spark, d):
    """Events written as an ordered snapshot and read back by partition; the scan prunes all others."""
    import uuid

    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write_snapshot(table(spark, d, "events"), path, "event_type", ["event_id"])
    wanted = spark.createDataFrame([("purchase",), ("signup",)], "event_type string")
    rows = snapshot.load_partitions(spark, path, "event_type", wanted)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.min("event_id").alias("least"), F.max("event_id").alias("most"))


_SETS = ", ".join(f"('{k}', '{m}', {len(ms)})" for k, ms in S.CATEGORIES.items() for m in ms)


@query(cohort_sql() + f""",
sets(set_, metric, parts) as (values {_SETS}),
keys as (select set_, string_agg(metric, '+' order by metric) as metrics from sets group by all),
has as (select set_, role, player_id, count(*) as n, any_value(parts) as parts from long l join sets s on s.metric = l.metric where is_ref and v is not null and role is not null group by all)
select role || ':' || metrics as key, count(*) as peer_count, sum(player_id)::bigint as ids, count(*) filter (where player_id % 2 = 0) as even_members
from has join keys k on k.set_ = has.set_ where n = parts group by all""")
def reference_members(spark, d):
    """Members of the complete reference of each category's metrics, from bitmaps: their count, and a test of every spell's entity."""
    c = Cohort(spark, d)
    sets = spark.createDataFrame([(k, m) for k, ms in S.CATEGORIES.items() for m in ms], "set string, metric string")
    rows = Ref.members(c.long, sets)
    maps = Ref.bitmaps(rows)
    asked = rows.select("key").distinct().join(c.spells.select(F.substring_index("role", ":", 1).alias("r"), "player_id").distinct(), F.expr("split(key, ':')[0] = r")).drop("r")
    inside = Ref.listed(maps, asked).groupBy("key").agg(F.sum("player_id").alias("ids"), F.count_if(F.col("player_id") % 2 == 0).alias("even_members"))
    return Ref.counted(maps).join(inside, "key", "left")


@query("select * from events where event_type = 'purchase'")
def partition_sink_load(spark, d):
    """One partition through the sink."""
    import uuid

    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    sinks.write_partitions(table(spark, d, "events"), path, "event_type")
    return sinks.load_partition(spark, path, "event_type", "purchase").select(*table(spark, d, "events").columns)


# --- canonical contracts, card evidence, conventions ---------------------------------------------------


@query(A + """,
c as (select *, case when k % 50 <> 0 then team_id end as team, sx / 120 + case when k % 25 = 0 then 0.5e0 else 0 end as x, sy / 80 as y from actions),
v as (select unnest(list_filter([
  case when us < 1000000 then 'BAD_SECONDS' end, case when event_id % 7919 = 1 then 'BAD_INDEX' end, case when team is null then 'PLAYER_WITHOUT_TEAM' end,
  case when x is not null and not coalesce(x between 0 and 1 and y between 0 and 1, false) then 'OUTSIDE_PITCH' end,
  case when kind = 'Pass' and k % 40 = 0 then 'PASS_DETAIL_MISMATCH' end, case when kind <> 'Carry' and k % 33 = 0 then 'CARRY_DETAIL_MISMATCH' end], lambda x: x is not null)) as violation from c)
select violation, count(*) as n from v group by violation""")
def event_contract(spark, d):
    """Actions under the contract of canonical events; some are bound wrongly."""
    a = actions(spark, d)
    k, kind = F.col("k"), F.col("kind")
    detail = lambda on: F.when(on, F.struct(F.lit(1).alias("x")))
    rows = a.select(
        ((F.col("us") - 1_000_000) / 1e6).alias("elapsed"), F.when(F.col("event_id") % 7919 == 1, -1).otherwise(F.col("event_id")).alias("index"), "player_id",
        F.when(k % 50 != 0, F.col("team_id")).alias("team_id"), kind.alias("event_type"),
        F.when(F.col("sx").isNotNull(), F.struct((F.col("sx") / 120 + F.when(k % 25 == 0, 0.5).otherwise(0.0)).alias("x"), (F.col("sy") / 80).alias("y"))).alias("start_location"),
        detail((kind == "Pass") & (k % 40 != 0)).alias("pass_detail"), detail((kind == "Carry") | (k % 33 == 0)).alias("carry_detail"), detail(kind == "Shot").alias("shot_detail"),
    )
    found = contracts.checked(rows, "event")
    return found.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


_TYPES = "(['Yellow Card', 'Second Yellow', 'Red Card'])[cast(k % 3 as int) + 1]"


@query(A + f""",
cards as (select event_id, match_id, player_id, period, {_TYPES} as card, case when k % 7 <> 0 then us / 1e6 end as clk from actions where event_type = 'purchase'),
ev as (select match_id, player_id, period, {_TYPES} as card, us / 1e6 as clk from actions where event_type = 'error'),
m as (select c.event_id, any_value(c.card) as card, any_value(c.clk) as clk, count(e.card) as n, count(*) filter (where e.period = c.period and abs(e.clk - c.clk) <= {S.CLOCK_TOLERANCE}) as near
  from cards c left join ev e on e.match_id = c.match_id and e.player_id = c.player_id and e.card = c.card group by c.event_id),
w as (select *, case when n = 0 then 'LINEUP_CARD_WITHOUT_EVENT' when clk is null then case when n = 1 then 'CARD_CLOCK_RESOLVED_FROM_EVENT' else 'AMBIGUOUS_SOURCE_CARD' end when near = 0 then 'CARD_EVENT_CLOCK_DISAGREEMENT' end as code from m)
select code, case when code = 'CARD_CLOCK_RESOLVED_FROM_EVENT' then 'warning' when code = 'AMBIGUOUS_SOURCE_CARD' then 'error' when card in ('Red Card', 'Second Yellow') then 'error' else 'warning' end as severity, count(*) as n from w where code is not null group by all""")
def card_evidence(spark, d):
    """Cards of line-ups against card events of the same player and card."""
    a = actions(spark, d)
    card = F.element_at(F.array(*map(F.lit, ("Yellow Card", "Second Yellow", "Red Card"))), (F.col("k") % 3 + 1).cast("int"))
    at = F.struct("period", (F.col("us") / 1e6).alias("elapsed"))
    cards = a.where("event_type = 'purchase'").select("match_id", "player_id", card.alias("card_type"), F.when(F.col("k") % 7 != 0, at).alias("time"))
    events = a.where("event_type = 'error'").select("match_id", "player_id", card.alias("card"), "period", (F.col("us") / 1e6).alias("elapsed"))
    return Q.card_issues(cards, events).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(A + """ select player_id, match_id, round(sum(dur) / 6e7, 6) as elapsed_minutes, round(sum(greatest(0, least(us + dur, 21600000000) - least(us, 21600000000))) / 6e7, 6) as nominal_minutes from exposed group by all""")
def exposure_convention(spark, d):
    """Minutes of an appearance under both conventions."""
    e = exposed(actions(spark, d))
    cap = F.lit(21_600_000_000)
    nominal = F.greatest(F.lit(0), F.least(F.col("us") + F.col("dur"), cap) - F.least("us", cap))
    rows = e.groupBy("player_id", "match_id").agg((F.sum("dur") / 1e6).alias("seconds"), (F.sum(nominal) / 6e7).alias("nominal"))
    each = [F.round(X.denominator(c, F.col("seconds"), F.col("nominal")), 6).alias(f"{c.split('_')[0]}_minutes") for c in X.CONVENTIONS]
    return rows.select("player_id", "match_id", *each)


@query(cohort_sql() + f" select role, metric, count(v) as values from long where role is not null and is_ref and metric not in ({', '.join(repr(m) for m in S.MEANS)}) and (role <> 'GK' or metric in ({', '.join(repr(m) for m in S.KEEPER_METRICS)})) group by all")
def rankable_metrics(spark, d):
    """Metrics that each role can be ranked by, with the reference values they have."""
    wanted = spark.createDataFrame([(r, m) for r in S.ROLES for m in R.rankable(r)], "role string, metric string")
    rows = Cohort(spark, d).long.where("is_ref").join(F.broadcast(wanted), ["role", "metric"])
    return rows.groupBy("role", "metric").agg(F.count("v").alias("values"))
