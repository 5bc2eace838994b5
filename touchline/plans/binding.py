"""Binding of the events table to player actions, so that every operator runs on given rows.

Attributes that the table lacks are derived from its columns by fixed rules; some are unknown (NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF = 43_200_000_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: Column) -> Column:
    """Microseconds within the day of a timestamp without zone, whatever the session's zone."""
    return F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def actions(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, u, ts = F.col("k"), F.col("user_id"), F.col("ts")
    when = F.when
    kind = (
        when(F.col("event_type") == "view", "Pass")
        .when(F.col("event_type") == "click", "Carry")
        .when(F.col("event_type") == "purchase", "Shot")
        .when(
            F.col("event_type") == "signup",
            F.element_at(F.array(*map(F.lit, ("Interception", "Ball Recovery", "Duel", "Block", "Clearance", "Miscontrol", "Dispossessed", "Pressure"))), k % 8 + 1),
        )
        .when(k % 3 == 0, "Pressure")
        .otherwise("Half Start")
    )
    role = F.array(*map(F.lit, ("CB", "DM", "W", "ST")))
    seat = when((F.col("event_id") % 10 < 7) | (u % 5 != 0), u % 4).otherwise((u + 1) % 4)
    a = e.select(
        "event_id",
        u.alias("player_id"),
        when((u % 7 == 0) & (F.dayofmonth(ts) > 20), (u + 1) % 12).otherwise(u % 12).alias("team_id"),
        F.to_date(ts).alias("date"),
        F.dayofmonth(ts).cast("long").alias("match_id"),
        when(F.hour(ts) < 12, 1).otherwise(2).alias("period"),
        (_micros(ts) % HALF).alias("us"),
        "event_type",
        "value",
        "k",
        F.element_at(role, (seat + 1).cast("int")).alias("role"),
        kind.alias("kind"),
        (k * 1.2).alias("sx"),
        ((k * 37) % 101 * 0.8).alias("sy"),
        when((k % 17 != 0) | (u % 6 != 0), (k * 7 + 13) % 101 * 1.2).alias("ex"),
        ((k * 13 + 5) % 101 * 0.8).alias("ey"),
    )
    k, kd = F.col("k"), F.col("kind")
    whole = F.col("player_id") % 6 != 0  # these have no unknown attribute
    a = a.withColumns(
        {
            "outcome": when(kd == "Pass", when((k % 20 == 0) & ~whole, "unknown").when(k % 3 == 0, "incomplete").otherwise("complete")),
            "pass_length": when((kd == "Pass") & ((k % 19 != 0) | whole), k * 0.6),
            "switch": (kd == "Pass") & (k % 9 == 0),
            "cross": (kd == "Pass") & (k % 8 == 0),
            "pass_type": when((kd == "Pass") & (k % 15 == 0), "Corner"),
            "play_pattern": when((k % 13 != 0) | whole, when(k % 4 == 0, "From Throw In").otherwise("Regular Play")),
            "xg": when((kd == "Shot") & ((k % 25 != 0) | whole), F.least(F.col("value") / 500, F.lit(1.0))),
            "shot_outcome": when(kd == "Shot", when(k % 4 == 0, "Goal").when(k % 4 == 1, "Saved").when(k % 4 == 2, "Off T").when((k % 7 != 0) | whole, "Blocked")),
            "shot_type": when((kd == "Shot") & ((k % 23 != 0) | whole), when(k % 11 == 0, "Penalty").otherwise("Open Play")),
            "counterpress": (kd == "Pressure") & (k % 2 == 0),
            "recovery_failure": when((kd == "Ball Recovery") & ((k % 6 != 0) | whole), k % 5 == 0),
            "duel_type": when((kd == "Duel") & ((k % 10 != 0) | whole), when(k % 3 == 0, "Tackle").otherwise("Aerial Lost")),
            "valid": (F.col("player_id") * 31 + F.col("match_id")) % 97 != 0,
            "assist": (kd == "Pass") & (k % 5 == 0),
            "key_pass": when((kd == "Shot") & (k % 3 == 0), F.col("event_id") - 12 * (k % 4)),
        }
    )
    # the next shot: the least id of those seen when going back from the end, a running minimum
    ahead = Window.partitionBy("team_id", "match_id", "period").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    link = F.min(when(kd == "Shot", F.col("event_id"))).over(ahead)
    return a.withColumn("link", when(F.col("assist"), link))


def exposed(a: DataFrame) -> DataFrame:
    """Actions with the microseconds until the same player's next one in the period."""
    w = Window.partitionBy("player_id", "team_id", "match_id", "period").orderBy("us", "event_id")
    return a.withColumn("dur", F.lead("us", 1, HALF).over(w) - F.col("us"))


ACTIONS_SQL = """
raw as (select *, cast(json_extract_string(props, '$.k') as int) as k from events),
bound as (
  select event_id, user_id as player_id,
    case when user_id % 7 = 0 and day(ts) > 20 then (user_id + 1) % 12 else user_id % 12 end as team_id,
    cast(day(ts) as bigint) as match_id, case when hour(ts) < 12 then 1 else 2 end as period,
    epoch_us(ts) % 43200000000 as us, event_type, value, k,
    (['CB','DM','W','ST'])[cast(case when event_id % 10 < 7 or user_id % 5 <> 0 then user_id % 4 else (user_id + 1) % 4 end as int) + 1] as role,
    case event_type when 'view' then 'Pass' when 'click' then 'Carry' when 'purchase' then 'Shot'
      when 'signup' then (['Interception','Ball Recovery','Duel','Block','Clearance','Miscontrol','Dispossessed','Pressure'])[k % 8 + 1]
      else case when k % 3 = 0 then 'Pressure' else 'Half Start' end end as kind,
    k * 1.2e0 as sx, ((k * 37) % 101) * 0.8e0 as sy,
    case when k % 17 <> 0 or user_id % 6 <> 0 then ((k * 7 + 13) % 101) * 1.2e0 end as ex, ((k * 13 + 5) % 101) * 0.8e0 as ey
  from raw),
act as (
  select *,
    case when kind = 'Pass' then case when k % 20 = 0 and not (player_id % 6 <> 0) then 'unknown' when k % 3 = 0 then 'incomplete' else 'complete' end end as outcome,
    case when kind = 'Pass' and (k % 19 <> 0 or player_id % 6 <> 0) then k * 0.6e0 end as pass_length,
    kind = 'Pass' and k % 9 = 0 as switch, kind = 'Pass' and k % 8 = 0 as "cross",
    case when kind = 'Pass' and k % 15 = 0 then 'Corner' end as pass_type,
    case when (k % 13 <> 0 or player_id % 6 <> 0) then case when k % 4 = 0 then 'From Throw In' else 'Regular Play' end end as play_pattern,
    case when kind = 'Shot' and (k % 25 <> 0 or player_id % 6 <> 0) then least(value / 500, 1e0) end as xg,
    case when kind = 'Shot' then case k % 4 when 0 then 'Goal' when 1 then 'Saved' when 2 then 'Off T' else case when (k % 7 <> 0 or player_id % 6 <> 0) then 'Blocked' end end end as shot_outcome,
    case when kind = 'Shot' and (k % 23 <> 0 or player_id % 6 <> 0) then case when k % 11 = 0 then 'Penalty' else 'Open Play' end end as shot_type,
    kind = 'Pressure' and k % 2 = 0 as counterpress,
    case when kind = 'Ball Recovery' and (k % 6 <> 0 or player_id % 6 <> 0) then k % 5 = 0 end as recovery_failure,
    case when kind = 'Duel' and (k % 10 <> 0 or player_id % 6 <> 0) then case when k % 3 = 0 then 'Tackle' else 'Aerial Lost' end end as duel_type,
    (player_id * 31 + match_id) % 97 <> 0 as valid, kind = 'Pass' and k % 5 = 0 as assist,
    case when kind = 'Shot' and k % 3 = 0 then event_id - 12 * (k % 4) end as key_pass
  from bound),
actions as (
  select *, case when assist then min(case when kind = 'Shot' then event_id end)
    over (partition by team_id, match_id, period order by event_id rows between 1 following and unbounded following) end as link
  from act),
exposed as (
  select *, lead(us, 1, 43200000000) over (partition by player_id, team_id, match_id, period order by us, event_id) - us as dur from actions)"""
