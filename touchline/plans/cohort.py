"""The stages from actions to profiles, and the same stages in SQL for checks.

Actions are aggregated once, to one wide row for each session and role (exposure and the sums of all
metrics). That table is written to the shared folder; all later stages read it, not the events.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import profiles as P
from ..operators import statistics as St
from ..sources.shared import materialised
from .binding import ACTIONS_SQL, actions, exposed

SESSION = ["player_id", "team_id", "match_id"]
SPELL = ["player_id", "team_id"]


@dataclass
class Cohort:
    spark: object
    sf_dir: str
    min_minutes: float = S.MIN_MINUTES
    min_peers: int = S.MIN_PEERS

    @cached_property
    def actions(self) -> DataFrame:
        return actions(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        # dealt by session once, for the exposure within a period and for the sums of a session
        return exposed(St.unique_links(St.disposition(self.actions)).repartition(*SESSION))

    @cached_property
    def included(self) -> DataFrame:
        return self.events.where("disposition = 'included'")

    @cached_property
    def base(self) -> DataFrame:
        """A wide row for each session and role."""
        exposure = [F.sum("dur").alias("us"), F.bool_and("valid").alias("valid"), F.count("*").alias("n_events")]
        wide = self.events.groupBy(*SESSION, "role").agg(*exposure, *St.metric_sums(counted=F.col("disposition") == "included"))
        return materialised(wide, "sessions")

    @cached_property
    def appearances(self) -> DataFrame:
        """Sessions of an entity with exposure and validity."""
        return self.base.groupBy(*SESSION).agg(F.sum("us").alias("us"), F.bool_and("valid").alias("valid"), F.sum("n_events").alias("n_events"))

    @cached_property
    def session_stats(self) -> DataFrame:
        return St.unpivoted(St.rolled_up(self.base.where("valid"), SESSION), SESSION, S.METRICS)

    @cached_property
    def season_stats(self) -> DataFrame:
        return St.unpivoted(St.rolled_up(self.base.where("valid"), SPELL), SPELL, S.METRICS)

    @cached_property
    def exposure(self) -> DataFrame:
        a = self.appearances
        return a.groupBy(*SPELL).agg(
            F.sum(F.when(F.col("valid"), F.col("us")).otherwise(0)).alias("us"),
            F.count_if("valid").alias("appearances"),
            F.count_if(~F.col("valid")).alias("excluded"),
        ).withColumn("minutes", F.col("us") / 60_000_000).withColumn("partial", F.col("excluded") > 0)

    @cached_property
    def role_time(self) -> DataFrame:
        return self.base.where("valid").groupBy(*SPELL, "role").agg(F.sum("us").alias("time"))

    @cached_property
    def spells(self) -> DataFrame:
        """One row per entity and group with exposure, role, reasons, eligibility and reference flag."""
        base = self.exposure.where("us > 0").join(P.dominant_role(self.role_time, SPELL), SPELL, "left")
        return materialised(P.with_eligibility(base, self.min_minutes), "spells")

    @cached_property
    def season(self) -> DataFrame:
        minutes = self.exposure.where("us > 0").select(*SPELL, "minutes")
        return materialised(St.rated(self.season_stats.join(minutes, SPELL)), "season")

    @cached_property
    def long(self) -> DataFrame:
        """Spell and metric rows; spells meet their sums as wide rows, before these are unpivoted."""
        info = ["minutes", "role", "eligible", "is_ref"]
        wide = St.rolled_up(self.base.where("valid"), SPELL).join(self.spells.select(*SPELL, *info), SPELL)
        return materialised(St.rated(St.unpivoted(wide, [*SPELL, *info], S.METRICS)), "long")

    @cached_property
    def percentiles(self) -> DataFrame:
        return P.metric_percentiles(self.long, self.min_peers)


def _metric_sql() -> str:
    loc = "sx is not null and sy is not null"
    ends = f"{loc} and ex is not null and ey is not null"
    done = "(case when kind = 'Carry' then true when outcome <> 'unknown' then outcome = 'complete' end)"
    box = lambda x, y: f"({x} >= 102 and {y} between 18 and 62)"
    entered = lambda hit: f"case when not {done} then 0e0 when {done} and {ends} then cast(({hit}) as double) end"
    third = entered("sx < 80 and ex >= 80")
    into = entered(f"not {box('sx', 'sy')} and {box('ex', 'ey')}")
    open_play = "(case when kind = 'Pass' and coalesce(pass_type in ('Corner','Free Kick','Goal Kick','Kick Off','Throw-in'), false) then false else play_pattern in ('Regular Play','From Counter') end)"
    d0, d1 = "sqrt((120-sx)*(120-sx)+(40-sy)*(40-sy))", "sqrt((120-ex)*(120-ex)+(40-ey)*(40-ey))"
    prog = f"case when not {done} or not {open_play} then 0e0 when {done} and {open_play} then case when {ends} then cast(({d0} > 0 and ex > sx and {d0} - {d1} >= greatest(10e0, {d0} * 0.25e0)) as double) end end"
    p, cr, sh, claim = "kind = 'Pass'", "kind = 'Carry'", "kind = 'Shot'", "(kind = 'Pass' and assist)"
    rows = {
        "event_involvements": ("true", "1e0"), "average_action_x": (loc, "sx"), "average_action_y": (loc, "sy"),
        "final_third_actions": (loc, "cast(sx >= 80 as double)"), "box_actions": (loc, f"cast({box('sx', 'sy')} as double)"),
        "passes_attempted": (p, "1e0"), "passes_completed": (p, f"cast({done} as double)"), "pass_completion_pct": (p, f"cast({done} as double)"),
        "forward_passes": (p, f"case when {ends} then cast(ex > sx as double) end"), "switches": (p, "cast(switch as double)"),
        "crosses": (p, 'cast("cross" as double)'), "long_passes": (p, "cast(pass_length >= 30 as double)"), "carries": (cr, "1e0"),
        "carry_displacement": (cr, f"case when {ends} then sqrt((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)) end"),
        "passes_into_final_third": (p, third), "carries_into_final_third": (cr, third), "passes_into_box": (p, into), "carries_into_box": (cr, into),
        "progressive_passes": (p, prog), "progressive_carries": (cr, prog),
        "shot_assists": (claim, "case when link_valid then 1e0 end"), "shot_linked_xg_assisted": (claim, "case when link_valid then link_xg end"),
        "shots": (sh, "1e0"), "goals": (sh, "cast(shot_outcome = 'Goal' as double)"),
        "shots_on_target": (sh, "cast(shot_outcome in ('Goal','Saved','Saved To Post','Saved to Post') as double)"), "xg": (sh, "xg"),
        "penalty_shots": (sh, "cast(shot_type = 'Penalty' as double)"), "nonpenalty_shots": (sh, "cast(shot_type <> 'Penalty' as double)"),
        "nonpenalty_xg": (sh, "case when shot_type = 'Penalty' then 0e0 when shot_type <> 'Penalty' then xg end"),
        "average_shot_distance": (sh, f"case when {loc} then {d0} end"), "shots_inside_box": (sh, f"case when {loc} then cast({box('sx', 'sy')} as double) end"),
        "pressures": ("kind = 'Pressure'", "1e0"), "counterpressures": ("kind = 'Pressure'", "cast(counterpress as double)"),
        "interceptions": ("kind = 'Interception'", "1e0"), "recovery_attempts": ("kind = 'Ball Recovery'", "1e0"),
        "recoveries": ("kind = 'Ball Recovery'", "cast(not recovery_failure as double)"), "tackles": ("kind = 'Duel'", "cast(duel_type = 'Tackle' as double)"),
        "blocks": ("kind = 'Block'", "1e0"), "clearances": ("kind = 'Clearance'", "1e0"), "miscontrols": ("kind = 'Miscontrol'", "1e0"),
        "dispossessions": ("kind = 'Dispossessed'", "1e0"),
    }
    each = " union all ".join(f"select player_id, team_id, match_id, '{m}' as metric, {v} as val from included where {a}" for m, (a, v) in rows.items())
    return f"samples_ as ({each})"


_MEANS = ", ".join(f"'{m}'" for m in S.MEANS)
_RATIO = ", ".join(f"'{m}'" for m in S.MEANS + S.PERCENTAGES)
_ALL = ", ".join(f"'{m}'" for m in S.METRICS)


def cohort_sql(min_minutes: float = S.MIN_MINUTES, min_peers: int = S.MIN_PEERS) -> str:
    """All stages as common table expressions, ending without a comma."""
    return f"""with {ACTIONS_SQL},
disposed as (
  select *, case when period = 5 then 'shootout' when kind = 'Half Start' then 'administrative' when not valid then 'no_validated_appearance' else 'included' end as disposition
  from exposed),
fits as (
  select c.event_id, s.xg as link_xg, row_number() over (partition by c.match_id, c.link order by c.event_id) as rn
  from disposed c join disposed s on c.link = s.event_id and c.team_id = s.team_id and c.match_id = s.match_id and c.period = s.period
  where c.assist and c.disposition = 'included' and s.disposition = 'included' and s.kind = 'Shot' and s.us >= c.us and coalesce(s.key_pass = c.event_id, true)),
linked as (
  select d.*, f.link_xg, case when assist then f.event_id is not null end as link_valid
  from disposed d left join fits f on d.event_id = f.event_id and f.rn = 1),
included as (select * from linked where disposition = 'included'),
{_metric_sql()},
summed as (
  select player_id, team_id, match_id, metric, sum(coalesce(val, 0)) as numerator, count(*) as samples, count(*) - count(val) as missing
  from samples_ group by all),
apps as (select player_id, team_id, match_id, sum(dur) as us, bool_and(valid) as valid, count(*) as n_events from exposed group by all),
session_stats as (
  select a.player_id, a.team_id, a.match_id, m.metric, coalesce(numerator, 0) as numerator, coalesce(samples, 0) as samples, coalesce(missing, 0) as missing
  from (select * from apps where valid) a cross join (select unnest([{_ALL}]) as metric) m
  left join summed s on s.player_id = a.player_id and s.team_id = a.team_id and s.match_id = a.match_id and s.metric = m.metric),
exposure as (
  select *, us / 60000000e0 as minutes, excluded > 0 as partial from (
    select player_id, team_id, cast(sum(case when valid then us else 0 end) as bigint) as us, count(*) filter (where valid) as appearances, count(*) filter (where not valid) as excluded
    from apps group by all) x),
role_time as (select player_id, team_id, role, cast(sum(dur) as bigint) as time from exposed where valid group by all),
dominant as (
  select player_id, team_id, largest, share, case when share >= 0.6 then largest end as role from (
    select player_id, team_id, arg_max(role, (time, role)) as largest, coalesce(max(time)::double / nullif(sum(time), 0)::double, 0) as share from role_time group by all) x),
spells as (
  select *, eligible and row_number() over (partition by role, player_id order by eligible desc, minutes desc, team_id) = 1 as is_ref from (
    select e.*, largest, share, role,
      list_filter([case when minutes < {min_minutes} then 'BELOW_MINIMUM_MINUTES' end, case when partial then 'PARTIAL_PLAYER_SEASON' end, case when role is null then 'MIXED_POSITION_USAGE' end], lambda x: x is not null) as reasons,
      not (minutes < {min_minutes} or partial or role is null) as eligible
    from exposure e left join dominant d on e.player_id = d.player_id and e.team_id = d.team_id where us > 0) x),
season_stats as (select player_id, team_id, metric, sum(numerator) as numerator, cast(sum(samples) as bigint) as samples, cast(sum(missing) as bigint) as missing from session_stats group by all),
season as (
  select *, case when metric in ({_RATIO}) then value else per90 end as v from (
    select s.*, minutes,
      case when missing = 0 then case when metric in ({_RATIO}) then case when samples > 0 then numerator * case when metric = 'pass_completion_pct' then 100 else 1 end / samples end else numerator end end as value,
      case when missing = 0 and metric not in ({_RATIO}) and minutes > 0 then numerator * 90 / minutes end as per90,
      case when samples > 0 then (samples - missing)::double / samples end as coverage
    from season_stats s join exposure e on s.player_id = e.player_id and s.team_id = e.team_id where us > 0) x),
long as (
  select s.*, role, eligible, is_ref from season s join spells p on s.player_id = p.player_id and s.team_id = p.team_id),
mid as (
  select a.player_id, a.team_id, a.metric, count(b.v) as n,
    case when min(b.v) < max(b.v) then (count(*) filter (where b.v < a.v) + 0.5 * count(*) filter (where b.v = a.v)) * 100 / count(b.v) end as pct
  from long a join long b on a.role = b.role and a.metric = b.metric and b.is_ref and b.v is not null
  where a.v is not null group by all),
percentiles as (
  select l.*, case when status in ('AVAILABLE', 'CONSTANT_METRIC', 'INSUFFICIENT_PEERS') then coalesce(n, 0) else 0 end as peer_count,
    case when status = 'AVAILABLE' then case when metric in ('miscontrols', 'dispossessions') then 100 - pct else pct end end as percentile from (
    select l.*, m.n, m.pct, case when l.metric in ({_MEANS}) then 'DESCRIPTIVE_ONLY' when not eligible then 'INELIGIBLE_PROFILE' when v is null then 'MISSING_METRIC'
      when coalesce(n, 0) < {min_peers} then 'INSUFFICIENT_PEERS' when pct is null then 'CONSTANT_METRIC' else 'AVAILABLE' end as status
    from long l left join mid m on l.player_id = m.player_id and l.team_id = m.team_id and l.metric = m.metric) l)"""
