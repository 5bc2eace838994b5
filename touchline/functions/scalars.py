"""Column expressions with three-valued logic: NULL is unknown, never zero and never false."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S

ID_PATTERN = r"^[a-z0-9_]+:[a-z_]+:[^:\s][^:]*$"


def namespaced_id(provider: str, kind: str, native: Column) -> Column:
    """provider:kind:native, NULL when it is not a valid id."""
    out = F.concat_ws(":", F.lit(provider), F.lit(kind), native.cast("string"))
    return F.when(native.isNotNull() & out.rlike(ID_PATTERN), out)


def native_of(identifier: Column) -> Column:
    return F.split_part(identifier, F.lit(":"), F.lit(3))


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS(.f); NULL for anything else, minutes and seconds below 60."""
    part = F.split(text, ":")
    ok = text.rlike(r"^\d{2}:[0-5]\d:[0-5]\d(\.\d+)?$")
    at = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    return F.when(ok, at(1) * 3600 + at(2) * 60 + at(3))


def lineup_seconds(text: Column, period: Column) -> Column:
    """Seconds since the nominal start of the period of MM:SS; NULL when malformed, before it, or in no known period."""
    part = F.split(text, ":")
    at = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    base = F.coalesce(*[F.when(period == p, F.lit(float(b))) for p, b in S.PERIOD_BASE.items()])
    seconds = at(1) * 60 + at(2) - base
    return F.when(text.rlike(r"^\d+:[0-5]\d$") & (seconds >= 0), seconds)


def flag(value: Column) -> Column:
    """A source key that is absent means false; only for adapter columns."""
    return F.coalesce(value, F.lit(False))


def codes(pairs: Sequence[tuple[Column, str]]) -> Column:
    """The codes whose condition is true, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def in_box(x: Column, y: Column) -> Column:
    return (x >= S.BOX_X) & y.between(*S.BOX_Y)


def progressive(sx: Column, sy: Column, ex: Column, ey: Column) -> Column:
    """Forward, and nearer to the goal by the larger of an absolute and a relative step; NULL without both ends."""
    before = F.hypot(F.lit(S.LENGTH) - sx, F.lit(S.WIDTH / 2) - sy)
    after = F.hypot(F.lit(S.LENGTH) - ex, F.lit(S.WIDTH / 2) - ey)
    step = F.greatest(F.lit(S.PROGRESS_UNITS), before * S.PROGRESS_SHARE)
    known = sx.isNotNull() & sy.isNotNull() & ex.isNotNull() & ey.isNotNull()
    return F.when(known, (before > 0) & (ex > sx) & (before - after >= step))


def age_on(born: Column, day: Column) -> Column:
    """Whole years by comparing month and day (29 February has its birthday on 1 March in common years)."""
    early = (F.month(day) < F.month(born)) | ((F.month(day) == F.month(born)) & (F.dayofmonth(day) < F.dayofmonth(born)))
    return F.year(day) - F.year(born) - early.cast("int")


def age_status(born: Column, day: Column, oldest: int) -> Column:
    return (
        F.when(born.isNull(), F.lit("UNKNOWN"))
        .when(born > day, F.lit("INVALID"))
        .when(age_on(born, day) <= oldest, F.lit("ELIGIBLE"))
        .otherwise(F.lit("INELIGIBLE"))
    )


def rates(metric: Column, numerator: Column, samples: Column, missing: Column, minutes: Column) -> tuple[Column, Column, Column]:
    """(value, per90, coverage) of a sufficient statistic; any missing sample makes the value unknown."""
    whole = missing == 0
    ratio = metric.isin(S.MEANS + S.PERCENTAGES)
    scale = F.when(metric.isin(S.PERCENTAGES), F.lit(100.0)).otherwise(F.lit(1.0))
    value = F.when(whole, F.when(ratio, F.when(samples > 0, numerator * scale / samples)).otherwise(numerator))
    per90 = F.when(whole & ~ratio & (minutes > 0), numerator * 90 / minutes)
    return value, per90, F.when(samples > 0, (samples - missing) / samples)


def rank_value(metric: Column, value: Column, per90: Column) -> Column:
    """What a metric is compared by: means and percentages as they are, all else per 90 minutes."""
    return F.when(metric.isin(S.MEANS + S.PERCENTAGES), value).otherwise(per90)


#: How exposure is counted: played seconds with stoppages, or the nominal length of the periods.
CONVENTIONS = ("elapsed_including_stoppage", "nominal")


def denominator(convention: str, seconds: Column, nominal_minutes: Column) -> Column:
    """Minutes that rates are divided by."""
    if convention not in CONVENTIONS:
        raise ValueError(f"exposure is counted as {' or '.join(CONVENTIONS)}")
    return seconds / 60 if convention == CONVENTIONS[0] else nominal_minutes


def hash_bucket(key: Column, buckets: int) -> Column:
    """First eight hex digits of SHA-256, modulo buckets."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long") % buckets


def retained(entity: Column, replicate: Column, salt: str = "evaluation-0.8.0", percent: int = 80) -> Column:
    return hash_bucket(F.concat_ws(":", F.lit(salt), replicate.cast("string"), entity.cast("string")), 100) < percent


def eligibility(minutes: Column, partial: Column, role: Column, at_least: float = S.MIN_MINUTES) -> Column:
    """Reasons against a peer, in order; empty means eligible."""
    return codes([(minutes < at_least, "BELOW_MINIMUM_MINUTES"), (partial, "PARTIAL_PLAYER_SEASON"), (role.isNull(), "MIXED_POSITION_USAGE")])


def eligibility_at(reasons: Column, minutes: Column, at_least: float) -> Column:
    """The same under another threshold: its code is taken out and put at the end where it holds."""
    below = F.lit("BELOW_MINIMUM_MINUTES")
    return F.array_compact(F.concat(F.array_except(reasons, F.array(below)), F.array(F.when(minutes < at_least, below))))


def point(value: Column, digits: int = 6) -> Column:
    """value to so many digits as SQL rounds a double: scaled, to the nearest whole number, halves away from zero.

    F.round with digits rounds the shortest decimal that shows the double, which is another number at halves.
    """
    steps = F.lit(float(10**digits))
    return F.round(value * steps) / steps
