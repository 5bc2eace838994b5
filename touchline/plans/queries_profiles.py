"""Queries of the statistic and profile operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalars import eligibility_at, point
from ..operators import profiles as P
from ..operators import statistics as St
from .cohort import SESSION, SPELL, Cohort, cohort_sql

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, *, prefix: str | None = None, name: str | None = None):
    """Register a function (cohort) -> DataFrame with its SQL after the common stages."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Cohort(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = (cohort_sql() if prefix is None else prefix) + "\n" + sql
        return f

    return add


@query("select event_id, disposition from disposed")
def event_disposition(c):
    from .binding import exposed

    return St.disposition(exposed(c.actions)).select("event_id", "disposition")


@query("select count(*) filter (where valid) as kept, count(*) filter (where not valid) as excluded, cast(sum(us) filter (where valid) as bigint) as kept_us from apps")
def validity_gate(c):
    return c.appearances.agg(F.count_if("valid").alias("kept"), F.count_if(~F.col("valid")).alias("excluded"), F.sum(F.when(F.col("valid"), F.col("us"))).alias("kept_us"))


@query("select event_id, link, link_valid, link_xg from linked where assist")
def unique_link(c):
    return c.events.where("assist").select("event_id", "link", "link_valid", "link_xg")


@query("select player_id, team_id, match_id, metric, round(numerator, 6) as numerator, samples, missing from session_stats")
def zero_fill(c):
    return c.session_stats.select(*SESSION, "metric", point(F.col("numerator")).alias("numerator"), "samples", "missing")


@query("select player_id, team_id, match_id, metric, round(numerator, 6) as numerator, samples, missing from summed where samples > 0")
def sufficient_stats(c):
    return St.sufficient(c.included, SESSION).where("samples > 0").select(*SESSION, "metric", point(F.col("numerator")).alias("numerator"), "samples", "missing")


@query("select player_id, team_id, metric, round(numerator, 6) as numerator, samples, missing from season_stats")
def season_rollup(c):
    return c.season_stats.select(*SPELL, "metric", point(F.col("numerator")).alias("numerator"), "samples", "missing")


@query("select player_id, team_id, us, appearances, excluded, partial, round(minutes, 6) as minutes from exposure")
def exposure_rollup(c):
    return c.exposure.select(*SPELL, "us", "appearances", "excluded", "partial", point(F.col("minutes")).alias("minutes"))


@query("select player_id, team_id, round(minutes, 6) as elapsed_minutes, 90 * appearances as nominal_minutes, minutes >= 450 as minimum_minutes_met from exposure")
def exposure_denominator(c):
    return c.exposure.select(*SPELL, point(F.col("minutes")).alias("elapsed_minutes"), (90 * F.col("appearances")).alias("nominal_minutes"), (F.col("minutes") >= S.MIN_MINUTES).alias("minimum_minutes_met"))


@query("select player_id, team_id, metric, round(value, 6) as value, round(per90, 6) as per90, round(coverage, 6) as coverage from season")
def rate_per90(c):
    return c.season.select(*SPELL, "metric", *[point(F.col(x)).alias(x) for x in ("value", "per90", "coverage")])


@query("select metric, count(*) filter (where missing > 0) as spells_with_missing, count(*) as spells from season_stats group by metric")
def missing_metric_census(c):
    return c.season_stats.groupBy("metric").agg(F.count_if(F.col("missing") > 0).alias("spells_with_missing"), F.count("*").alias("spells"))


@query("select player_id, team_id, largest, round(share, 9) as share, role from dominant")
def dominant_role(c):
    return P.dominant_role(c.role_time, SPELL).select(*SPELL, "largest", point(F.col("share"), 9).alias("share"), "role")


@query("select player_id, team_id, eligible, array_to_string(reasons, ',') as reasons from spells")
def peer_eligibility(c):
    return c.spells.select(*SPELL, "eligible", F.array_join("reasons", ",").alias("reasons"))


@query("""select player_id, team_id, array_to_string(list_filter(list_filter(reasons, lambda x: x <> 'BELOW_MINIMUM_MINUTES') || [case when minutes < 20000 then 'BELOW_MINIMUM_MINUTES' end], lambda x: x is not null), ',') as reasons from spells""")
def eligibility_at_threshold(c):
    return c.spells.select(*SPELL, F.array_join(eligibility_at(F.col("reasons"), F.col("minutes"), 20000.0), ",").alias("reasons"))


@query("select player_id, team_id, role, is_ref from spells where eligible")
def longest_spell(c):
    return c.spells.where("eligible").select(*SPELL, "role", "is_ref")


@query("select player_id, team_id, metric, status, peer_count, round(percentile, 6) as percentile from percentiles")
def metric_percentile(c):
    return c.percentiles.select(*SPELL, "metric", "status", "peer_count", point(F.col("percentile")).alias("percentile"))


@query("select metric, status, count(*) as n from percentiles group by all")
def metric_status(c):
    return c.percentiles.groupBy("metric", "status").agg(F.count("*").alias("n"))


@query("select status, count(*) as n from percentiles group by status")
def status_census(c):
    return c.percentiles.groupBy("status").agg(F.count("*").alias("n"))


@query("select reason, count(*) as n from (select unnest(reasons) as reason from spells) x group by reason")
def reason_census(c):
    return c.spells.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_FEATURES = ", ".join(f"'{m}'" for m in S.FEATURES)


@query(f"select player_id, team_id from long where metric in ({_FEATURES}) group by all having count(v) = count(*)")
def complete_cases(c):
    rows = c.long.where(F.col("metric").isin(S.FEATURES)).groupBy(*SPELL).agg(F.count("v").alias("k"), F.count("*").alias("n"))
    return rows.where("k = n").select(*SPELL)


@query("select role, metric, count(v) as peer_count from long where is_ref group by all")
def reference_sets(c):
    return c.long.where("is_ref").groupBy("role", "metric").agg(F.count("v").alias("peer_count"))


_CATS = ", ".join(f"('{k}', '{m}', {i}, {len(ms)})" for k, ms in S.CATEGORIES.items() for i, m in enumerate(ms))
CATEGORY_SQL = f""",
cats(cat, metric, place, parts) as (values {_CATS}),
cat_rows as (select l.*, cat, place, parts, count(v) over w = count(*) over w as complete from long l join cats c on l.metric = c.metric window w as (partition by player_id, team_id, cat)),
cat_mid as (
  select a.player_id, a.team_id, a.cat, a.metric, a.place, count(b.v) as n,
    case when min(b.v) < max(b.v) then (count(*) filter (where b.v < a.v) + 0.5 * count(*) filter (where b.v = a.v)) * 100 / count(b.v) end as pct0
  from cat_rows a join cat_rows b on a.role = b.role and a.cat = b.cat and a.metric = b.metric and b.is_ref and b.complete and b.v is not null
  where a.v is not null group by all),
cat_scores as (
  select player_id, team_id, cat as category, status, case when status = 'AVAILABLE' then total / parts end as score,
    case when status in ('INELIGIBLE_PROFILE', 'MISSING_COMPONENT') then 0 else coalesce(n, 0) end as peer_count from (
    select *, case when not eligible then 'INELIGIBLE_PROFILE' when not complete then 'MISSING_COMPONENT' when coalesce(n, 0) < 10 then 'INSUFFICIENT_PEERS'
      when known < parts then 'CONSTANT_COMPONENT' else 'AVAILABLE' end as status from (
      select r.player_id, r.team_id, r.cat, bool_and(eligible) as eligible, bool_and(complete) as complete, max(n) as n, max(parts) as parts,
        count(pct0) as known, sum(case when r.metric in ('miscontrols', 'dispossessions') then 100 - pct0 else pct0 end) as total
      from cat_rows r left join cat_mid m on r.player_id = m.player_id and r.team_id = m.team_id and r.cat = m.cat and r.metric = m.metric group by all) x) y)"""


@query("select player_id, team_id, category, status, peer_count, round(score, 6) as score from cat_scores", prefix=cohort_sql() + CATEGORY_SQL)
def category_score(c):
    return P.category_scores(c.long, c.spark).select(*SPELL, "category", "status", "peer_count", point(F.col("score")).alias("score"))


@query("select category, status, count(*) as n from cat_scores group by all", prefix=cohort_sql() + CATEGORY_SQL)
def category_status(c):
    return P.category_scores(c.long, c.spark).groupBy("category", "status").agg(F.count("*").alias("n"))


@query("""select player_id, team_id, metric, round(percentile, 6) as percentile, hi, lo from (
  select *, row_number() over (partition by player_id, team_id order by percentile desc, metric) as hi, row_number() over (partition by player_id, team_id order by percentile, metric) as lo
  from percentiles where status = 'AVAILABLE') x where hi <= 3 or lo <= 3""")
def highlights(c):
    from pyspark.sql import Window

    w = Window.partitionBy(*SPELL)
    rows = c.percentiles.where("status = 'AVAILABLE'")
    rows = rows.withColumns({"hi": F.row_number().over(w.orderBy(F.desc("percentile"), "metric")), "lo": F.row_number().over(w.orderBy("percentile", "metric"))})
    return rows.where("hi <= 3 or lo <= 3").select(*SPELL, "metric", point(F.col("percentile")).alias("percentile"), "hi", "lo")


@query("""select p.player_id, p.team_id, p.role, p.eligible, array_to_string(p.reasons, ',') as reasons, round(p.minutes, 6) as minutes, p.appearances,
  count(*) filter (where status = 'AVAILABLE') as available, round(max(percentile), 6) as best
from spells p join percentiles q on p.player_id = q.player_id and p.team_id = q.team_id group by all""")
def profiles(c):
    best = c.percentiles.groupBy(*SPELL).agg(F.count_if(F.col("status") == "AVAILABLE").alias("available"), F.max("percentile").alias("best"))
    rows = c.spells.join(best, SPELL)
    return rows.select(*SPELL, "role", "eligible", F.array_join("reasons", ",").alias("reasons"), point(F.col("minutes")).alias("minutes"), "appearances", "available", point(F.col("best")).alias("best"))


@query("""select player_id, team_id, metric, round(v, 6) as v, status, round(percentile, 6) as percentile from percentiles
where metric in ('passes_attempted', 'shots', 'xg', 'pressures') and eligible""")
def profile_export(c):
    """Fields of the snapshot: chosen metrics as a nested map at a sink, in long form here."""
    rows = c.percentiles.where(F.col("metric").isin("passes_attempted", "shots", "xg", "pressures") & F.col("eligible"))
    return rows.select(*SPELL, "metric", point(F.col("v")).alias("v"), "status", point(F.col("percentile")).alias("percentile"))


@query("select role, count(*) as spells, count(distinct player_id) as players, count(*) filter (where eligible) as eligible, count(*) filter (where is_ref) as reference from spells where role is not null group by role")
def cohort_meta(c):
    rows = c.spells.where("role is not null")
    return rows.groupBy("role").agg(F.count("*").alias("spells"), F.count_distinct("player_id").alias("players"), F.count_if("eligible").alias("eligible"), F.count_if("is_ref").alias("reference"))


@query("""select (select count(*) from session_stats where missing > samples) as missing_above_samples,
  (select count(*) from apps a full join (select distinct player_id, team_id, match_id from session_stats) s on a.player_id = s.player_id and a.team_id = s.team_id and a.match_id = s.match_id where a.valid and s.player_id is null or not a.valid and s.player_id is not null) as key_mismatch,
  (select count(*) from season where per90 < 0) as negative_rates""")
def feature_audit(c):
    s = c.session_stats
    over = s.agg(F.count_if(F.col("missing") > F.col("samples")).alias("missing_above_samples"))
    keys = c.appearances.select(*SESSION, "valid").join(s.select(*SESSION, F.lit(True).alias("has")).distinct(), SESSION, "full")
    bad = keys.agg(F.count_if(F.coalesce("valid", F.lit(False)) != F.coalesce("has", F.lit(False))).alias("key_mismatch"))
    rate = c.season.agg(F.count_if(F.col("per90") < 0).alias("negative_rates"))
    # three one-row results
    return over.join(bad).join(rate)


@query("""select (select count(*) from spells where role is not null and share < 0.6) as weak_roles,
  (select count(*) from (select role, player_id from spells where is_ref group by all having count(*) > 1) x) as double_reference,
  (select count(*) from percentiles where percentile < 0 or percentile > 100) as outside""")
def profile_audit(c):
    a = c.spells.agg(F.count_if(F.col("role").isNotNull() & (F.col("share") < S.MIN_SHARE)).alias("weak_roles"))
    b = c.spells.where("is_ref").groupBy("role", "player_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("double_reference"))
    d = c.percentiles.agg(F.count_if((F.col("percentile") < 0) | (F.col("percentile") > 100)).alias("outside"))
    return a.join(b).join(d)


def _family(name: str, metrics: list[str]) -> None:
    listed = ", ".join(f"'{m}'" for m in metrics)

    @query(f"select player_id, team_id, match_id, metric, round(numerator, 6) as numerator, samples, missing from summed where metric in ({listed})", name=f"metric_{name}")
    def run(c):
        return St.sufficient(c.included, SESSION, metrics).where("samples > 0").select(*SESSION, "metric", point(F.col("numerator")).alias("numerator"), "samples", "missing")


_family("passing", ["passes_attempted", "passes_completed", "pass_completion_pct", "forward_passes", "switches", "crosses", "long_passes"])
_family("entries", ["passes_into_final_third", "carries_into_final_third", "passes_into_box", "carries_into_box"])
_family("progression", ["progressive_passes", "progressive_carries", "carries", "carry_displacement"])
_family("creation", ["shot_assists", "shot_linked_xg_assisted"])
_family("shooting", ["shots", "goals", "shots_on_target", "xg", "penalty_shots", "nonpenalty_shots", "nonpenalty_xg", "average_shot_distance", "shots_inside_box"])
_family("defending", ["pressures", "counterpressures", "interceptions", "recovery_attempts", "recoveries", "tackles", "blocks", "clearances"])
_family("retention", ["miscontrols", "dispossessions"])
_family("zones", ["event_involvements", "average_action_x", "average_action_y", "final_third_actions", "box_actions"])
