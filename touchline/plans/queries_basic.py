"""Queries of scalar, filter, join, aggregate, interval and audit operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import intervals as I
from ..operators import presence as Pr
from ..operators import quality as Q
from ..operators.profiles import top_of_each
from ..sources.shared import materialised
from .binding import ACTIONS_SQL, HALF, actions, exposed, table

QUERIES, ORACLE = {}, {}
A = f"with {ACTIONS_SQL}\n"
SPANS = A[:-1] + """,
pres as (select player_id, team_id, match_id, period, us as start, least(us + 600000000, 43200000000) as "end" from actions where event_type in ('view', 'click')),
posn as (select player_id, team_id, match_id, period, us as start, least(us + 900000000, 43200000000) as "end" from actions where event_type in ('purchase', 'signup'))
"""
KEYS = ["player_id", "match_id", "period"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _spans(spark, sf_dir):
    a = actions(spark, sf_dir)

    def cut(kinds, n):
        return a.where(F.col("event_type").isin(kinds)).select("player_id", "team_id", "match_id", "period", F.col("us").alias("start"), F.least(F.col("us") + n, F.lit(HALF)).alias("end"))

    return cut(["view", "click"], 600_000_000), cut(["purchase", "signup"], 900_000_000)


# --- scalars ---------------------------------------------------------------------------------------


@query("select event_id, 'demo:player:' || user_id as id, cast(user_id as varchar) as native from events")
def namespaced_id(spark, d):
    e = table(spark, d, "events")
    i = X.namespaced_id("demo", "player", F.col("user_id"))
    return e.select("event_id", i.alias("id"), X.native_of(i).alias("native"))


@query("select event_id, hour(ts) * 3600e0 + minute(ts) * 60 + second(ts) as seconds, cast(null as double) as broken from events")
def clock_parse(spark, d):
    text = F.date_format("ts", "HH:mm:ss")
    return table(spark, d, "events").select("event_id", X.clock_seconds(text).alias("seconds"), X.clock_seconds(F.concat(text, F.lit(":9"))).alias("broken"))


@query("""select event_id, case when k * 60 + k % 60 - b >= 0 then (k * 60 + k % 60 - b) * 1e0 end as seconds from (
  select event_id, cast(json_extract_string(props, '$.k') as int) as k, (case event_id % 4 + 1 when 1 then 0 when 2 then 2700 when 3 then 5400 else 6300 end) as b from events) x""")
def lineup_clock(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.format_string("%d:%02d", k, k % 60)
    return table(spark, d, "events").select("event_id", X.lineup_seconds(text, F.col("event_id") % 4 + 1).alias("seconds"))


@query(A + "select event_id, round(sx / 120, 9) as x, round(sy / 80, 9) as y, sx / 120 between 0 and 1 and sy / 80 between 0 and 1 as inside from actions")
def coord_normalize(spark, d):
    x, y = F.col("sx") / 120, F.col("sy") / 80
    return actions(spark, d).select("event_id", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), (x.between(0, 1) & y.between(0, 1)).alias("inside"))


@query(A + "select outcome, count(*) as n from actions where kind = 'Pass' group by outcome")
def outcome_map(spark, d):
    return actions(spark, d).where("kind = 'Pass'").groupBy("outcome").agg(F.count("*").alias("n"))


@query(A + "select event_id, coalesce(recovery_failure, false) as failed from actions")
def flag_default(spark, d):
    return actions(spark, d).select("event_id", X.flag(F.col("recovery_failure")).alias("failed"))


@query("select event_id, case when event_id % 3 = 0 then 'extra' else '' end as unknown_keys from events")
def residual_attributes(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("user_id").alias("extra")))).otherwise(F.col("props"))
    bag = F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, _: ~k.isin("k"))
    return table(spark, d, "events").select("event_id", F.array_join(F.map_keys(bag), ",").alias("unknown_keys"))


@query(A + """select event_id, array_to_string(list_filter([case when ex is null then 'MISSING_END' end, case when outcome = 'unknown' then 'UNMAPPED_PASS_OUTCOME' end,
  case when play_pattern is null then 'MISSING_PATTERN' end], lambda x: x is not null), ',') as flags from actions""")
def quality_flags(spark, d):
    flags = X.codes([(F.col("ex").isNull(), "MISSING_END"), (F.col("outcome") == "unknown", "UNMAPPED_PASS_OUTCOME"), (F.col("play_pattern").isNull(), "MISSING_PATTERN")])
    return actions(spark, d).select("event_id", F.array_join(flags, ",").alias("flags"))


@query("""select event_type, n, t.id is not null as reviewed from (select event_type, count(*) as n from events group by event_type) e
left join (values (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'signup')) t(id, name) on t.name = e.event_type""")
def type_review(spark, d):
    known = spark.createDataFrame([(1, "view"), (2, "click"), (3, "purchase"), (4, "signup")], "id int, event_type string")
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(known), "event_type", "left").select("event_type", "n", F.col("id").isNotNull().alias("reviewed"))


@query(A + """select event_id, case when b is null then 'OPEN_END' when b < us then 'REVERSED' when b = us then 'ZERO_LENGTH' else '' end as flag from (
  select event_id, us, case when k % 10 = 0 then null when k % 10 = 1 then us when k % 10 = 2 then us - 1 else us + k end as b from actions) x""")
def position_observation(spark, d):
    k, us = F.col("k") % 10, F.col("us")
    end = F.when(k == 0, None).when(k == 1, us).when(k == 2, us - 1).otherwise(us + F.col("k"))
    flag = F.when(end.isNull(), "OPEN_END").when(end < us, "REVERSED").when(end == us, "ZERO_LENGTH").otherwise("")
    return actions(spark, d).select("event_id", flag.alias("flag"))


@query(A + "select event_id, round(sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)), 6) as displacement from actions")
def displacement(spark, d):
    return actions(spark, d).select("event_id", F.round(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")), 6).alias("displacement"))


@query(A + "select event_id, sx >= 102 and sy between 18 and 62 as starts_inside, ex >= 102 and ey between 18 and 62 as ends_inside from actions")
def zone_entry(spark, d):
    return actions(spark, d).select("event_id", X.in_box(F.col("sx"), F.col("sy")).alias("starts_inside"), X.in_box(F.col("ex"), F.col("ey")).alias("ends_inside"))


@query(A + """select event_id, case when ex is not null then b > 0 and ex > sx and b - a >= greatest(10, 0.25e0 * b) end as progressive from (
  select *, sqrt((120 - sx) * (120 - sx) + (40 - sy) * (40 - sy)) as b, sqrt((120 - ex) * (120 - ex) + (40 - ey) * (40 - ey)) as a from actions) x""")
def progressive(spark, d):
    return actions(spark, d).select("event_id", X.progressive(F.col("sx"), F.col("sy"), F.col("ex"), F.col("ey")).alias("progressive"))


@query("""select o_orderkey, case when o_custkey % 50 = 0 then 'UNKNOWN' when born > date '2000-02-28' then 'INVALID' when age <= 3 then 'ELIGIBLE' else 'INELIGIBLE' end as status from (
  select *, 2000 - year(born) - case when (month(born), day(born)) > (2, 28) then 1 else 0 end as age from (select o_orderkey, o_custkey, cast(o_orderdate as date) as born from orders) y) x""")
def age_eligibility(spark, d):
    born = F.when(F.col("o_custkey") % 50 != 0, F.to_date("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", X.age_status(born, F.to_date(F.lit("2000-02-28")), 3).alias("status"))


@query("select o_orderpriority, round(w / sum(w) over (), 9) as weight from (select o_orderpriority, count(*)::double as w from orders group by all) x")
def weight_normalize(spark, d):
    w = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").cast("double").alias("w"))
    # five rows of configuration size
    m = w.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o_orderpriority", "w")))).alias("m"))
    top = F.array_max(F.map_values("m"))
    scaled = m.select(F.transform_values("m", lambda _, v: v / top).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v)
    return scaled.select(F.explode(F.transform_values("m", lambda _, v: F.round(v / total, 9)))).toDF("o_orderpriority", "weight")


@query("select c_custkey, cast(('0x' || substr(sha256('evaluation-0.8.0:3:' || c_custkey), 1, 8)) as bigint) % 100 < 80 as kept from customer")
def hash_retention(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.retained(F.col("c_custkey"), F.lit(3)).alias("kept"))


@query("select c_custkey from customer where contains(lower(c_name || ' ' || c_mktsegment), '12 mach')")
def entity_search(spark, d):
    text = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return table(spark, d, "customer").where(text.contains("12 mach")).select("c_custkey")


@query(A + """select violation, count(*) as n from (select unnest(list_filter([case when sx / 120 > 0.95e0 then 'X_OUTSIDE' end, case when xg > 0.9e0 then 'XG_ABOVE' end,
  case when kind = 'Pass' and pass_length is null then 'PASS_WITHOUT_LENGTH' end], lambda x: x is not null)) as violation from actions) x group by violation""")
def contract_violations(spark, d):
    v = X.codes([(F.col("sx") / 120 > 0.95, "X_OUTSIDE"), (F.col("xg") > 0.9, "XG_ABOVE"), ((F.col("kind") == "Pass") & F.col("pass_length").isNull(), "PASS_WITHOUT_LENGTH")])
    return actions(spark, d).select(F.explode(v).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query("select sha256(c_custkey || '|' || c_nationkey) as key, c_custkey from customer")
def hash_key(spark, d):
    return table(spark, d, "customer").select(F.sha2(F.concat_ws("|", "c_custkey", "c_nationkey").cast("binary"), 256).alias("key"), "c_custkey")


@query("select event_id, event_id % 5 not in (1, 2) as accepted from events")
def strict_json_gate(spark, d):
    i = F.col("event_id") % 5
    raw = F.when(i == 1, F.lit('{"k":1,"k":2}')).when(i == 2, F.lit('{"k":1e309}')).otherwise(F.col("props"))
    from ..sources.json import accepted

    return table(spark, d, "events").select("event_id", accepted(raw).alias("accepted"))


# --- filters and joins -------------------------------------------------------------------------------


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def scope_semi_join(spark, d):
    scope = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(scope, "o_custkey", "left_semi").select("o_orderkey")


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def dim_lookup(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c = table(spark, d, "customer")
    # nation and region are fixed dimensions of 25 and 5 rows
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def orphan_actors(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""select count(*) filter (where l is null) as only_orders, count(*) filter (where o is null) as only_lines, count(*) as keys
from (select distinct o_orderkey as o from orders) a full join (select distinct l_orderkey as l from lineitem) b on o = l""")
def key_coverage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key")).distinct().withColumn("o", F.lit(1))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")).distinct().withColumn("l", F.lit(1))
    return o.join(li, "key", "full").agg(F.count_if(F.col("l").isNull()).alias("only_orders"), F.count_if(F.col("o").isNull()).alias("only_lines"), F.count("*").alias("keys"))


@query(SPANS + """select event_id from actions a where exists (select 1 from posn p where p.player_id = a.player_id and p.match_id = a.match_id and p.period = a.period
  and a.us >= p.start - 1 and a.us <= p."end" + 1)""")
def interval_semi_join(spark, d):
    return I.within(actions(spark, d), _spans(spark, d)[1], KEYS, "us", 1).select("event_id")


@query(SPANS + """select a.player_id, a.match_id, a.period, cast(sum(least(a."end", b."end") - greatest(a.start, b.start)) as bigint) as overlap, count(*) as pairs
from pres a join posn b on a.player_id = b.player_id and a.match_id = b.match_id and a.period = b.period and greatest(a.start, b.start) < least(a."end", b."end") group by all""")
def interval_overlap(spark, d):
    p, q = _spans(spark, d)
    return I.overlaps(p, q, KEYS).groupBy(*KEYS).agg(F.sum(F.col("to") - F.col("from")).alias("overlap"), F.count("*").alias("pairs"))


@query(A + """select p.event_id, p.us, coalesce((select arg_min(a.us, (abs(a.us - p.us), a.us)) from actions a
  where a.event_type = 'error' and a.player_id = p.player_id and a.match_id = p.match_id and a.period = p.period and abs(a.us - p.us) <= 3600000000), p.us) as snapped
from actions p where p.event_type = 'purchase'""")
def nearest_anchor(spark, d):
    a = actions(spark, d)
    anchors = a.where("event_type = 'error'").select(*KEYS, F.col("us").alias("at"))
    return I.nearest_anchor(a.where("event_type = 'purchase'"), anchors, KEYS, "event_id", "us", 3_600_000_000).select("event_id", "us", "snapped")


@query(A + """select c.event_id, case when count(e.event_id) = 0 then 'NONE' when count(*) filter (where abs(e.us - c.us) <= 3600000000) = 1 then 'UNIQUE' when count(*) filter (where abs(e.us - c.us) <= 3600000000) > 1 then 'AMBIGUOUS' else 'CLOCK' end as match
from actions c left join actions e on e.player_id = c.player_id and e.match_id = c.match_id and e.period = c.period and e.event_type = 'error' where c.event_type = 'purchase' group by c.event_id""")
def evidence_match(spark, d):
    a = actions(spark, d)
    e = a.where("event_type = 'error'").select(*KEYS, F.col("us").alias("e_us"))
    near = F.count_if(F.abs(F.col("e_us") - F.col("us")) <= 3_600_000_000)
    rows = a.where("event_type = 'purchase'").join(e, KEYS, "left").groupBy("event_id").agg(F.count("e_us").alias("n"), near.alias("m"))
    return rows.select("event_id", F.when(F.col("n") == 0, "NONE").when(F.col("m") == 1, "UNIQUE").when(F.col("m") > 1, "AMBIGUOUS").otherwise("CLOCK").alias("match"))


@query("select event_type, n, (case event_type when 'view' then 'CB' when 'click' then 'DM' when 'purchase' then 'W' end) as role, event_type not in ('view', 'click', 'purchase') as unmapped from (select event_type, count(*) as n from events group by all) x")
def role_mapping(spark, d):
    roles = spark.createDataFrame([("view", "CB"), ("click", "DM"), ("purchase", "W")], "event_type string, role string")
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(roles), "event_type", "left").select("event_type", "n", "role", F.col("role").isNull().alias("unmapped"))


# --- aggregates and windows --------------------------------------------------------------------------


@query(A + """select player_id, match_id, cast(sum(dur) as bigint) as elapsed, cast(sum(greatest(0, least(us + dur, 21600000000) - least(us, 21600000000))) as bigint) as nominal from exposed group by all""")
def interval_duration(spark, d):
    cap = F.lit(HALF // 2)
    nominal = F.greatest(F.lit(0), F.least(F.col("us") + F.col("dur"), cap) - F.least(F.col("us"), cap))
    return exposed(actions(spark, d)).groupBy("player_id", "match_id").agg(F.sum("dur").alias("elapsed"), F.sum(nominal).alias("nominal"))


@query("select count(distinct user_id) as users, count(distinct event_id) as events, count(*) as rows from events")
def distinct_census(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_id").alias("events"), F.count("*").alias("rows"))


@query(A + "select match_id, count(*) as events, count(distinct player_id) as players, count(*) filter (where outcome = 'unknown') as flagged from actions group by rollup(match_id)")
def match_census(spark, d):
    return actions(spark, d).rollup("match_id").agg(F.count("*").alias("events"), F.count_distinct("player_id").alias("players"), F.count_if(F.col("outcome") == "unknown").alias("flagged"))


@query("select (select count(*) from orders) as orders, (select count(*) from lineitem) as lineitem, (select cast(sum(l_orderkey * 7 + l_linenumber) as bigint) from lineitem) as line_sum")
def dataset_census(spark, d):
    o = table(spark, d, "orders").agg(F.count("*").alias("orders"))
    li = table(spark, d, "lineitem").agg(F.count("*").alias("lineitem"), F.sum(F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("line_sum"))
    return o.join(li)


@query("select * from events where event_type = 'purchase'")
def partition_load(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'")


@query(SPANS + """select player_id, match_id, period, cast(sum(greatest(0, "end" - greatest(start, coalesce(reach, start)))) as bigint) as covered from (
  select *, max("end") over (partition by player_id, match_id, period order by start, "end" rows between unbounded preceding and 1 preceding) as reach from pres) x group by all""")
def interval_union(spark, d):
    return I.union_length(_spans(spark, d)[0], KEYS)


@query(SPANS + """, ev as (select match_id, team_id, period, start as t, 1 as c from pres union all select match_id, team_id, period, "end", -1 from pres),
run as (select *, sum(c) over (partition by match_id, team_id, period order by t, c rows between unbounded preceding and current row) as open from ev)
select match_id, team_id, period, cast(max(open) as bigint) as most, cast(min(open) as bigint) as least from run group by all""")
def capacity_sweep(spark, d):
    return I.capacity(_spans(spark, d)[0], ["match_id", "team_id", "period"])


@query(SPANS + """select player_id, match_id, period, count(*) as n from (
  select *, max("end") over (partition by player_id, match_id, period order by start, "end" rows between unbounded preceding and 1 preceding) as reach from pres) x where start < reach group by all""")
def interval_overlap_check(spark, d):
    return I.overlapping(_spans(spark, d)[0], KEYS).groupBy(*KEYS).agg(F.count("*").alias("n"))


@query(SPANS + """, ev as (select player_id, match_id, period, start as t, 1 as a, 0 as b from pres union all select player_id, match_id, period, "end", -1, 0 from pres
  union all select player_id, match_id, period, start, 0, 1 from posn union all select player_id, match_id, period, "end", 0, -1 from posn),
cuts as (select player_id, match_id, period, t, sum(a) as a, sum(b) as b from ev group by all),
run as (select player_id, match_id, period, t, lead(t) over w as nx, sum(a) over w as na, sum(b) over w as nb from cuts window w as (partition by player_id, match_id, period order by t))
select player_id, match_id, period, cast(coalesce(sum(nx - t) filter (where (na > 0) <> (nb > 0)), 0) as bigint) as differs from run group by all""")
def timeline_disagreement(spark, d):
    p, q = _spans(spark, d)
    return I.disagreement(p, q, KEYS)


@query("select count(*) filter (where rn <> event_id) as breaks from (select event_id, row_number() over (order by event_id) - 1 as rn from events) x")
def contiguous_index(spark, d):
    """Rows whose rank by id is not their id. Ids are counted and dealt into ranges; only the totals of ranges are summed in one order."""
    ids = table(spark, d, "events").where("event_id is not null").groupBy("event_id").agg(F.count("*").alias("c"))
    # written once, so that the ranges are the same for their totals and for their rows
    dealt = materialised(ids.repartitionByRange("event_id").withColumn("range", F.spark_partition_id()), "ids")
    total = dealt.groupBy("range").agg(F.sum("c").alias("t"), F.min("event_id").alias("lo"))
    # one row a range
    before = F.coalesce(F.sum("t").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = total.select("range", before.alias("before"))
    inside = F.sum("c").over(Window.partitionBy("range").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("before") + F.coalesce("inside", F.lit(0))
    # equal ids have the ranks from first on; at most one of them is the id
    own = F.col("event_id").between(first, first + F.col("c") - 1).cast("long")
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(total), "range")
    return ranked.agg(F.coalesce(F.sum(F.col("c") - own), F.lit(0)).alias("breaks"))


@query(A + """select event_id, event_type, case when event_type = 'error' then coalesce(prev <> 'error', true) else coalesce(prev = 'error', false) end as valid from (
  select *, lag(event_type) over (partition by player_id, match_id order by event_id) as prev from actions where event_type in ('error', 'signup')) x""")
def presence_toggle(spark, d):
    t = actions(spark, d).where(F.col("event_type").isin("error", "signup"))
    prev = F.lag("event_type").over(Window.partitionBy("player_id", "match_id").orderBy("event_id"))
    t = t.withColumn("prev", prev)
    ok = F.when(F.col("event_type") == "error", F.coalesce(F.col("prev") != "error", F.lit(True))).otherwise(F.coalesce(F.col("prev") == "error", F.lit(False)))
    return t.select("event_id", "event_type", ok.alias("valid"))


FOLD_SQL = A.replace("with ", "with recursive ", 1) + """,
sess as (select a.*, strftime(cast(e.ts as date), '%Y-%m-%d') || ':' || a.team_id || ':' || (a.player_id // 132) as session from actions a join events e on a.event_id = e.event_id),
moves as (
  select session, period, 0 as over_, us / 1000000e0 as clock, event_id as idx, player_id as p, case when event_type = 'purchase' then player_id + 12 end as other,
    case event_type when 'error' then case when k % 7 = 0 then 'permanent_exit' else 'temporary_exit' end when 'signup' then 'return' when 'purchase' then 'substitution' end as move
  from sess where event_type in ('error', 'signup') or event_type = 'purchase' and k % 10 = 0
  union all select distinct session, u.period, 1, 43200e0, 0, -1, null, 'end' from sess, (select unnest([1, 2]) as period) u),
tr as (select *, row_number() over (partition by session order by period, over_, clock, idx) as seq from moves),
run as (
  select session, cast(0 as bigint) as seq, list(distinct player_id) as active, []::bigint[] as away, list(distinct player_id) as known, true as ok from sess group by session
  union all
  select session, seq,
    case when not valid or move = 'end' then active when move = 'substitution' then list_append(list_filter(active, lambda x: x <> p), other) when move = 'return' then list_append(active, p) else list_filter(active, lambda x: x <> p) end,
    case when not valid or move in ('end', 'permanent_exit') then away when move = 'temporary_exit' then list_append(away, p) else list_filter(away, lambda x: x <> p) end,
    case when valid and move = 'substitution' then list_append(known, other) else known end, valid
  from (select t.*, r.active, r.away, r.known,
      case move when 'substitution' then (list_contains(r.active, t.p) or list_contains(r.away, t.p)) and not list_contains(r.known, t.other) when 'return' then list_contains(r.away, t.p)
        when 'end' then true else list_contains(r.active, t.p) end as valid
    from run r join tr t on t.session = r.session and t.seq = r.seq + 1) x),
steps as (select t.*, cur.ok, prev.active as before from tr t join run cur on cur.session = t.session and cur.seq = t.seq join run prev on prev.session = t.session and prev.seq = t.seq - 1),
enter as (
  select session, period, player_id, cast(0 as double) as clock, seq - 0.5 as seq, 'period_start' as opened from (
    select session, period, unnest(before) as player_id, seq from (select * from steps qualify seq = min(seq) over (partition by session, period)) y) x
  union all select session, period, case move when 'return' then p else other end, clock, seq, move from steps where ok and move in ('return', 'substitution')),
leave as (
  select session, period, p as player_id, clock, seq, move as closed from steps where ok and move in ('substitution', 'permanent_exit', 'temporary_exit') and list_contains(before, p)
  union all select session, period, unnest(before), clock, seq, 'period_end' from steps where move = 'end'),
e as (select *, row_number() over (partition by session, period, player_id order by seq) as n from enter),
l as (select *, row_number() over (partition by session, period, player_id order by seq) as n from leave),
spans as (select e.session, e.player_id, e.period, e.clock as start, l.clock as "end", opened, closed from e join l on l.session = e.session and l.period = e.period and l.player_id = e.player_id and l.n = e.n where l.clock > e.clock),
refused as (
  select session, p as player_id, period, clock, move from steps where not ok
  union all select session, other, period, clock, move from steps where not ok and move = 'substitution'
  union all select session, -1, period, clock, 'end' from steps where move = 'end' and len(before) > 11),
codes as (
  select *, case move when 'substitution' then 'INVALID_SUBSTITUTION_STATE' when 'return' then 'PLAYER_ON_WITHOUT_TEMPORARY_EXIT' when 'end' then 'TEAM_CAPACITY_EXCEEDED' else 'PLAYER_OFF_NOT_ACTIVE' end as issue from refused)
"""


def _sessions(spark, d):
    """Actions with their session: a team's day within a block of users, of whom eleven are of the team, besides those that come from another one."""
    return actions(spark, d).withColumn("session", F.concat_ws(":", "date", "team_id", F.floor(F.col("player_id") / 132)))


def _folded(a):
    none = F.lit(None)
    move = F.when(F.col("event_type") == "error", "Player Off").when(F.col("event_type") == "signup", "Player On").when((F.col("event_type") == "purchase") & (F.col("k") % 10 == 0), "Substitution")
    cols = ["session", "kind", "player_id", "other_id", "period", "at", "index", "permanent", "card"]
    moves = a.withColumn("kind", move).where("kind is not null")
    moves = moves.select("session", "kind", "player_id", F.when(F.col("kind") == "Substitution", F.col("player_id") + 12).alias("other_id"), "period", (F.col("us") / 1e6).alias("at"), F.col("event_id").alias("index"), (F.col("k") % 7 == 0).alias("permanent"), none.cast("string").alias("card"))
    starters = a.groupBy("session", "player_id").agg(F.lit("Starter").alias("kind"))
    starters = starters.select("session", "kind", "player_id", none.cast("long").alias("other_id"), F.lit(1).alias("period"), F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("index"), F.lit(False).alias("permanent"), none.cast("string").alias("card"))
    ends = a.select("session").distinct().select("session", F.lit("Period End").alias("kind"), F.lit(-1).cast("long").alias("player_id"), none.cast("long").alias("other_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("period"), F.lit(43200.0).alias("at"), F.lit(0).cast("long").alias("index"), F.lit(False).alias("permanent"), none.cast("string").alias("card"))
    return Pr.presence(moves.select(cols).unionByName(starters).unionByName(ends))


@query(FOLD_SQL + """select session, player_id, period, start, "end", opened, closed, null::varchar as issue from spans
union all select session, player_id, period, clock, clock, null, null, issue from codes""")
def presence_fold(spark, d):
    return _folded(_sessions(spark, d))


@query(FOLD_SQL + """,
acts as (select *, us / 1000000e0 as clock from sess where event_type in ('view', 'click')),
lost as (select session, player_id from acts a where not exists (select 1 from spans s where s.session = a.session and s.player_id = a.player_id and s.period = a.period and a.clock >= s.start - 1e-6 and a.clock <= s."end" + 1e-6)),
found as (select session, player_id, issue from codes where player_id >= 0 union select session, player_id, 'ACTION_OUTSIDE_RECONSTRUCTED_PRESENCE' from lost union
  select p.session, p.player_id, issue from (select distinct session, player_id from sess) p join codes c on c.session = p.session and c.player_id < 0),
total as (select session, player_id, sum("end" - start) as seconds from spans group by all)
select p.session, p.player_id, coalesce(array_to_string(flags, ','), '') as quality_flags,
  case when flags is not null then 'NEEDS_REVIEW' when coalesce(seconds, 0) <= 0 then 'EXCLUDED' else 'VALIDATED' end as quality_status,
  case when flags is null and seconds > 0 then round(seconds, 6) end as playing_seconds
from (select distinct session, player_id from sess) p left join (select session, player_id, list_sort(list(distinct issue)) as flags from found group by all) f on f.session = p.session and f.player_id = p.player_id
  left join total t on t.session = p.session and t.player_id = p.player_id""")
def presence_quality(spark, d):
    """Decision on every player of a session from refused moves, its capacity, and actions outside of presence."""
    a = materialised(_sessions(spark, d).select("session", "event_id", "event_type", "player_id", "team_id", "period", "us", "k", "date"), "sessions")
    folded = materialised(_folded(a).withColumnRenamed("session", "match_id"), "folded")
    people = a.groupBy(F.col("session").alias("match_id"), "player_id").agg(F.lit(True).alias("introduced"), F.lit(0).alias("observed"))
    spans = folded.where("issue is null")
    acts = a.where(F.col("event_type").isin("view", "click")).select(F.col("session").alias("match_id"), "player_id", "period", (F.col("us") / 1e6).alias("elapsed"))
    lost = I.within(acts, spans, Q.BY_PERIOD, "elapsed", 1e-6, "left_anti")
    own = folded.where("issue is not null").select("match_id", F.when(F.col("player_id") >= 0, F.col("player_id")).alias("player_id"), F.col("issue").alias("code"))
    issues = own.unionByName(lost.select("match_id", "player_id", F.lit("ACTION_OUTSIDE_RECONSTRUCTED_PRESENCE").alias("code"))).withColumn("severity", F.lit("error"))
    rows = Q.decided(people, issues, spans)
    return rows.select(F.col("match_id").alias("session"), "player_id", F.array_join("quality_flags", ",").alias("quality_flags"), "quality_status", F.round("playing_seconds", 6).alias("playing_seconds"))


@query(A + """, o as (select player_id, match_id, min(period) as p0, arg_min(us, event_id) as a, max(period) as p1, arg_max(us, event_id) as b from actions group by all),
s as (select *, unnest(generate_series(p0, p1)) as period from o)
select player_id, match_id, period, "from", "to" from (select *, case when period = p0 then a else 0 end as "from", case when period = p1 then b else 43200000000 end as "to" from s) x where "from" < "to" """)
def period_split(spark, d):
    o = actions(spark, d).groupBy("player_id", "match_id").agg(F.min("period").alias("p0"), F.min_by("us", "event_id").alias("start"), F.max("period").alias("p1"), F.max_by("us", "event_id").alias("end"))
    return I.by_period(o, HALF).select("player_id", "match_id", "period", "from", "to")


# --- top-k, sets, audits -----------------------------------------------------------------------------


@query(A + """select player_id, match_id, us, rank from (select *, row_number() over (partition by player_id order by us desc, match_id) as rank from (
  select player_id, match_id, cast(sum(dur) as bigint) as us from exposed group by all) y) x where rank <= 2""")
def top_sessions(spark, d):
    s = exposed(actions(spark, d)).groupBy("player_id", "match_id").agg(F.sum("dur").alias("us"))
    return top_of_each(s, ["player_id"], [F.desc("us"), F.col("match_id")], 2)


@query("select c_custkey, 'CASE-' || lpad(cast(row_number() over (partition by c_nationkey order by sha256('review:' || c_custkey)) as varchar), 4, '0') as alias from customer")
def hash_alias(spark, d):
    key = F.sha2(F.concat(F.lit("review:"), F.col("c_custkey").cast("string")).cast("binary"), 256)
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(key))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("CASE-"), F.lpad(n.cast("string"), 4, "0")).alias("alias"))


@query("select count(*) as n from (select c_custkey from customer except all select distinct o_custkey from orders) x")
def key_difference(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return c.exceptAll(table(spark, d, "orders").select("o_custkey").distinct()).agg(F.count("*").alias("n"))


@query(A + """select (select count(*) from (select event_id from actions group by all having count(*) > 1) x) as duplicate_ids,
  (select count(*) from actions a left join (select distinct c_custkey from customer) c on a.player_id = c.c_custkey where c_custkey is null) as unknown_players""")
def canonical_audit(spark, d):
    a = actions(spark, d)
    dup = a.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    lost = a.join(table(spark, d, "customer").select(F.col("c_custkey").alias("player_id")).distinct(), "player_id", "left_anti").agg(F.count("*").alias("unknown_players"))
    return dup.join(lost)


@query("""select o_orderkey, count(l_orderkey) as lines, coalesce(cast(sum(l_linenumber) as bigint), 0) as total from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def ingest_reconcile(spark, d):
    """Nested JSON of each order's lines is parsed back; its rows must be those of the flat table."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    raw = li.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("l_linenumber"))).alias("raw"))
    back = raw.select("l_orderkey", F.explode(F.from_json("raw", "array<struct<l_linenumber:int>>")).alias("x"))
    each = back.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("x.l_linenumber").alias("total"))
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(each, o["o_orderkey"] == each["l_orderkey"], "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("total", F.lit(0)).alias("total"))


@query(SPANS + """select count(*) filter (where "end" <= start) as empty_spans, count(*) filter (where start < 0 or "end" > 43200000000) as outside, cast(sum("end" - start) as bigint) as total from pres""")
def minutes_audit(spark, d):
    p = _spans(spark, d)[0]
    return p.agg(F.count_if(F.col("end") <= F.col("start")).alias("empty_spans"), F.count_if((F.col("start") < 0) | (F.col("end") > HALF)).alias("outside"), F.sum(F.col("end") - F.col("start")).alias("total"))


@query(A + "select 0 as only_first, 0 as only_second from (select count(*) from actions) x")
def replay_diff(spark, d):
    """Exposure in two ways must be the same rows: summed by player and match at once, and by way of teams and periods."""
    e = exposed(actions(spark, d))
    one = e.groupBy("player_id", "match_id").agg(F.sum("dur").alias("us"))
    two = e.groupBy("player_id", "team_id", "match_id", "period").agg(F.sum("dur").alias("us")).groupBy("player_id", "match_id").agg(F.sum("us").alias("us"))
    a = one.exceptAll(two).agg(F.count("*").cast("int").alias("only_first"))
    return a.join(two.exceptAll(one).agg(F.count("*").cast("int").alias("only_second")))
