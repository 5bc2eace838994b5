"""Sufficient statistics: per event and metric a value or unknown, summed by session and then by season.

A statistic is (numerator, samples, missing). Partial sums are merged by plain addition, so both
levels are ordinary aggregations with map-side combine; rates are computed from sums, never averaged.
All sums are of whole numbers (fractional values in steps of 1 / STEP), so that they do not depend on the
order of the rows: a value that is planned or computed twice is the same, and ties stay ties.
A level is one wide row (three columns a metric) and is unpivoted last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalars import in_box, progressive, rank_value, rates
from .intervals import within


#: Fractional values are summed in steps of so many to one.
STEP = 1_000_000_000
FRACTIONAL = frozenset(S.SUMS + S.MEANS)


def disposition(events: DataFrame) -> DataFrame:
    """events with `disposition`; each rule applies to what the rules before left."""
    return events.withColumn(
        "disposition",
        F.when(F.col("period") == 5, "shootout")
        .when(F.col("kind").isin(S.ADMINISTRATIVE), "administrative")
        .when(~F.coalesce("valid", F.lit(False)), "no_validated_appearance")
        .otherwise("included"),
    )


def disposition_errors(events: DataFrame, presence: DataFrame, appearances: DataFrame) -> DataFrame:
    """Included events that contradict their sources, with a code; they go to quarantine and must be none.

    presence: match_id, player_id, period, start, end; appearances: match_id, player_id, team_id of validated ones.
    events as `disposition` gives them, with elapsed and quality_flags.
    """
    rows = events.where("disposition = 'included'")
    team = appearances.select("match_id", "player_id", F.col("team_id").alias("valid_team"))
    wrong = rows.join(team, ["match_id", "player_id"], "left").where(~F.coalesce(F.col("team_id") == F.col("valid_team"), F.lit(False))).select(rows.columns)
    outside = within(rows, presence, ["match_id", "player_id", "period"], "elapsed", S.EDGE, "left_anti")
    odd = rows.where(F.size(F.array_except("quality_flags", F.array(F.lit("UNMAPPED_PASS_OUTCOME")))) > 0)
    parts = ((wrong, "WRONG_TEAM"), (outside, "OUTSIDE_PRESENCE"), (odd, "UNREVIEWED_FLAGS"))
    first, *rest = [part.select("match_id", "event_id", F.lit(code).alias("code")) for part, code in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


def unique_links(events: DataFrame) -> DataFrame:
    """events with link_valid and link_xg: a claimed shot exists, fits, names no other pass, and is claimed by no valid pass before.

    Shots are joined on (team, match, period, id), which also are the conditions of a valid link. Both sides speak: a
    pass claims a shot, and a shot may name its key pass. A shot that names one is its alone; of several claims of
    one that names none the first wins, and a pass claims one shot, so no side is in two links.
    """
    keys = ["team_id", "match_id", "period"]
    shots = events.where((F.col("kind") == "Shot") & (F.col("disposition") == "included")).select(*keys, F.col("event_id").alias("link"), F.col("us").alias("shot_us"), F.col("xg").alias("shot_xg"), F.col("key_pass").alias("named"))
    # only claims go through the join and the window
    claims = events.where(F.col("assist") & (F.col("disposition") == "included"))
    fits = claims.join(shots, [*keys, "link"]).where((F.col("shot_us") >= F.col("us")) & F.coalesce(F.col("named") == F.col("event_id"), F.lit(True)))
    order = Window.partitionBy("match_id", "link").orderBy("event_id")
    good = fits.withColumn("__first", F.row_number().over(order)).where("__first = 1").select("event_id", F.lit(True).alias("link_valid"), F.col("shot_xg").alias("link_xg"))
    claimed = events.where("assist").join(good, "event_id", "left").withColumn("link_valid", F.coalesce("link_valid", F.lit(False)))
    return claimed.unionByName(events.where(~F.coalesce("assist", F.lit(False))), allowMissingColumns=True)


def _number(flag: Column) -> Column:
    return flag.cast("double")


def metric_values() -> dict[str, tuple[Column, Column]]:
    """(applies, value) of each metric on one event; a NULL value is a missing sample."""
    c = F.col
    kind, sx, sy, ex, ey = c("kind"), c("sx"), c("sy"), c("ex"), c("ey")
    located = sx.isNotNull() & sy.isNotNull()
    ends = located & ex.isNotNull() & ey.isNotNull()
    passed, carried, shot = kind == "Pass", kind == "Carry", kind == "Shot"
    done = F.when(carried, F.lit(True)).otherwise(F.when(c("outcome") != "unknown", c("outcome") == "complete"))
    one = F.lit(1.0)

    def entered(hit: Column) -> Column:
        return F.when(~done, F.lit(0.0)).when(done & ends, _number(hit))

    final_third = entered((sx < S.FINAL_THIRD) & (ex >= S.FINAL_THIRD))
    box = entered(~in_box(sx, sy) & in_box(ex, ey))
    open_play = F.when(passed & F.coalesce(c("pass_type").isin(S.RESTARTS), F.lit(False)), F.lit(False)).otherwise(c("play_pattern").isin(S.OPEN_PLAY))
    progress = F.when(~done | ~open_play, F.lit(0.0)).when(done & open_play, _number(progressive(sx, sy, ex, ey)))
    penalty = c("shot_type") == "Penalty"
    known = c("shot_outcome").isNotNull()
    claim = passed & c("assist")
    return {
        "event_involvements": (F.lit(True), one),
        "average_action_x": (located, sx),
        "average_action_y": (located, sy),
        "final_third_actions": (located, _number(sx >= S.FINAL_THIRD)),
        "box_actions": (located, _number(in_box(sx, sy))),
        "passes_attempted": (passed, one),
        "passes_completed": (passed, _number(done)),
        "pass_completion_pct": (passed, _number(done)),
        "forward_passes": (passed, F.when(ends, _number(ex > sx))),
        "switches": (passed, _number(c("switch"))),
        "crosses": (passed, _number(c("cross"))),
        "long_passes": (passed, _number(c("pass_length") >= S.LONG_PASS)),
        "carries": (carried, one),
        "carry_displacement": (carried, F.when(ends, F.hypot(ex - sx, ey - sy))),
        "passes_into_final_third": (passed, final_third),
        "carries_into_final_third": (carried, final_third),
        "passes_into_box": (passed, box),
        "carries_into_box": (carried, box),
        "progressive_passes": (passed, progress),
        "progressive_carries": (carried, progress),
        "shot_assists": (claim, F.when(c("link_valid"), one)),
        "shot_linked_xg_assisted": (claim, F.when(c("link_valid"), c("link_xg"))),
        "shots": (shot, one),
        "goals": (shot, F.when(known, _number(c("shot_outcome") == "Goal"))),
        "shots_on_target": (shot, F.when(known, _number(c("shot_outcome").isin(S.ON_TARGET)))),
        "xg": (shot, c("xg")),
        "penalty_shots": (shot, _number(penalty)),
        "nonpenalty_shots": (shot, _number(~penalty)),
        "nonpenalty_xg": (shot, F.when(penalty, F.lit(0.0)).when(~penalty, c("xg"))),
        "average_shot_distance": (shot, F.when(located, F.hypot(F.lit(S.LENGTH) - sx, F.lit(S.WIDTH / 2) - sy))),
        "shots_inside_box": (shot, F.when(located, _number(in_box(sx, sy)))),
        "pressures": (kind == "Pressure", one),
        "counterpressures": (kind == "Pressure", _number(c("counterpress"))),
        "interceptions": (kind == "Interception", one),
        "recovery_attempts": (kind == "Ball Recovery", one),
        "recoveries": (kind == "Ball Recovery", _number(~c("recovery_failure"))),
        "tackles": (kind == "Duel", _number(c("duel_type") == "Tackle")),
        "blocks": (kind == "Block", one),
        "clearances": (kind == "Clearance", one),
        "miscontrols": (kind == "Miscontrol", one),
        "dispossessions": (kind == "Dispossessed", one),
    }


def metric_sums(metrics: list[str] | None = None, counted: Column | None = None) -> list[Column]:
    """Three sums of each metric (m__n in steps of 1 / STEP or whole, m__s, m__m) over the events that are counted."""
    sums = []
    for m, (applies, value) in metric_values().items():
        if metrics is not None and m not in metrics:
            continue
        on = applies if counted is None else applies & counted
        amount = F.round(value * STEP) if m in FRACTIONAL else value
        sums += [
            F.sum(F.when(on, F.coalesce(amount, F.lit(0.0)).cast("long"))).alias(f"{m}__n"),
            F.count_if(on).alias(f"{m}__s"),
            F.count_if(on & value.isNull()).alias(f"{m}__m"),
        ]
    return sums


def sufficient(events: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """keys, metric, numerator, samples, missing: one pass, one shuffle.

    The sums of all metrics are columns of one aggregation, so an event is one row up to the shuffle;
    only the aggregated rows are unpivoted. Every metric has a row, also without samples.
    """
    wide = events.groupBy(*keys).agg(*metric_sums(metrics))
    return unpivoted(wide, keys, [m for m in metric_values() if metrics is None or m in metrics])


def rolled_up(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide sums over fewer keys; one row a key crosses the shuffle."""
    columns = [c for c in wide.columns if c.endswith(("__n", "__s", "__m"))]
    return wide.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def unpivoted(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row of every metric for every row of wide, zero where it has no samples."""
    parts = [
        F.struct(
            F.lit(m).alias("metric"),
            (F.coalesce(f"{m}__n", F.lit(0)) / (STEP if m in FRACTIONAL else 1)).alias("numerator"),
            F.coalesce(f"{m}__s", F.lit(0)).cast("long").alias("samples"),
            F.coalesce(f"{m}__m", F.lit(0)).cast("long").alias("missing"),
        )
        for m in metrics
    ]
    return wide.select(*keys, F.explode(F.array(*parts)).alias("s")).select(*keys, "s.*")


def rated(stats: DataFrame, minutes: str = "minutes") -> DataFrame:
    """stats with value, per90, coverage and v, the value that ranks a metric."""
    value, per90, coverage = rates(F.col("metric"), F.col("numerator"), F.col("samples"), F.col("missing"), F.col(minutes))
    out = stats.withColumns({"value": value, "per90": per90, "coverage": coverage})
    return out.withColumn("v", rank_value(F.col("metric"), F.col("value"), F.col("per90")))
