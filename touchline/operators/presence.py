"""Presence from transitions: a fold in order, since a refused transition changes what later ones may do.

Every player of a session has one status: on, away (may come back) or out; players that were never on have
none. MOVES is the table of transitions. Spark sorts the transitions of a session into an array and folds
it with `aggregate`; the state is a map of statuses and the rows found so far. A session has tens of
transitions, and its rows meet in one row of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S

#: Fixed values: (statuses from which it is allowed, status afterwards, reason of the end of a span, code of a refusal) of each
#: move. A substitution also needs a player who was never on, and brings that one on.
MOVES = {
    "substitution": (("on", "away"), "out", "substitution", "INVALID_SUBSTITUTION_STATE"),
    "permanent exit": (("on",), "out", "permanent_exit", "PLAYER_OFF_NOT_ACTIVE"),
    "temporary exit": (("on",), "away", "temporary_exit", "PLAYER_OFF_NOT_ACTIVE"),
    "return": (("away",), "on", None, "PLAYER_ON_WITHOUT_TEMPORARY_EXIT"),
    "dismissal": (("on", "away"), "out", "dismissal", "BENCH_OR_POST_EXIT_DISMISSAL"),
}
CAPACITY_CODE = "TEAM_CAPACITY_EXCEEDED"
CAPACITY = 11
WHO = "map<bigint,struct<status:string,since:double,opened:string>>"
ROW = "struct<player_id:bigint,period:int,start:double,end:double,opened:string,closed:string,issue:string>"


def move_of(kind: Column, permanent: Column, card: Column) -> Column:
    """Name of the move in MOVES, null for what moves nobody."""
    off = F.when(F.coalesce(permanent, F.lit(False)), "permanent exit").otherwise("temporary exit")
    return F.when(kind == "Substitution", "substitution").when(kind == "Player Off", off).when(kind == "Player On", "return").when(card.isin(S.DISMISSALS), "dismissal")


def _by_move(move: Column, pick) -> Column:
    """pick(row of MOVES) of the move."""
    return F.coalesce(*[F.when(move == name, pick(rule)) for name, rule in MOVES.items()])


def _row(player, period, start, end, opened, closed, issue) -> Column:
    return F.struct(player, period, start, end, opened, closed, issue).cast(ROW)


def _status(status: str, since: Column, opened: str) -> Column:
    return F.struct(F.lit(status), since, F.lit(opened)).cast("struct<status:string,since:double,opened:string>")


def _moved(acc: Column, x: Column) -> Column:
    """State after a transition x of one player, or a refusal."""
    own = F.try_element_at(acc["who"], x["player"])
    allowed = _by_move(x["move"], lambda rule: F.coalesce(own["status"].isin(*rule[0]), F.lit(False)))
    swap = x["move"] == "substitution"
    fresh = x["other"].isNotNull() & ~F.coalesce(F.map_contains_key(acc["who"], F.coalesce(x["other"], F.lit(-1))), F.lit(False))
    ok = allowed & (~swap | fresh)
    after = _by_move(x["move"], lambda rule: F.lit(rule[1]))
    ends = F.when((own["status"] == "on") & (x["at"] > own["since"]), F.array(_row(x["player"], x["period"], own["since"], x["at"], own["opened"], _by_move(x["move"], lambda rule: F.lit(rule[2]).cast("string")), F.lit(None))))
    refused = F.filter(F.array(x["player"], F.when(swap, x["other"])), lambda p: p.isNotNull())
    refused = F.transform(refused, lambda p: _row(p, x["period"], x["at"], x["at"], F.lit(None), F.lit(None), _by_move(x["move"], lambda rule: F.lit(rule[3]))))
    rest = F.map_filter(acc["who"], lambda p, _: p != x["player"])
    came = F.struct(after, x["at"], F.lit("return")).cast("struct<status:string,since:double,opened:string>")
    who = F.map_concat(rest, F.create_map(x["player"], came))
    who = F.when(swap, F.map_concat(who, F.create_map(F.coalesce(x["other"], F.lit(-1)), _status("on", x["at"], "substitution")))).otherwise(who)
    none = F.array().cast(f"array<{ROW}>")
    rows = F.concat(acc["rows"], F.when(ok, F.coalesce(ends, none)).otherwise(refused))
    return F.struct(F.when(ok, who).otherwise(acc["who"]).cast(WHO).alias("who"), rows.alias("rows"))


def _period_over(acc: Column, x: Column, capacity: int) -> Column:
    """State after the end of a period: spans of those on are closed and begin anew."""
    on = F.map_filter(acc["who"], lambda _, s: s["status"] == "on")
    spans = F.transform(
        F.filter(F.map_entries(on), lambda e: x["at"] > e["value"]["since"]),
        lambda e: _row(e["key"], x["period"], e["value"]["since"], x["at"], e["value"]["opened"], F.lit("period_end"), F.lit(None)),
    )
    none = F.array().cast(f"array<{ROW}>")
    over = F.when(F.size(on) > capacity, F.array(_row(F.lit(-1), x["period"], x["at"], x["at"], F.lit(None), F.lit(None), F.lit(CAPACITY_CODE)))).otherwise(none)
    again = F.transform_values(acc["who"], lambda _, s: F.when(s["status"] == "on", _status("on", F.lit(0.0), "period_start")).otherwise(s))
    return F.struct(again.cast(WHO).alias("who"), F.concat(acc["rows"], spans, over).alias("rows"))


def presence(transitions: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """session, player_id, period, start, end, opened, closed, issue: spans on, and refusals with a code.

    transitions: session, kind, player_id, other_id, period, at, index, permanent, card, with rows of kind
    Starter and Period End. Only periods with an end count; spans without length are no rows.
    """
    item = F.struct(
        F.col("period").cast("int").alias("period"),
        (F.col("kind") == "Period End").cast("int").alias("last"),
        F.col("at").cast("double").alias("at"),
        F.col("index").cast("long").alias("index"),
        move_of(F.col("kind"), F.col("permanent"), F.col("card")).alias("move"),
        F.col("player_id").cast("long").alias("player"),
        F.col("other_id").cast("long").alias("other"),
    )
    starter, end = F.col("kind") == "Starter", F.col("kind") == "Period End"
    sessions = transitions.groupBy("session").agg(
        F.collect_set(F.when(starter, F.col("player_id").cast("long"))).alias("starters"),
        F.collect_set(F.when(end, F.col("period").cast("int"))).alias("periods"),
        F.array_sort(F.collect_list(F.when(~starter, item))).alias("items"),
    )
    used = F.filter("items", lambda x: F.array_contains("periods", x["period"]) & ((x["last"] == 1) | x["move"].isNotNull()))
    who = F.map_from_entries(F.transform("starters", lambda p: F.struct(p, _status("on", F.lit(0.0), "period_start"))))
    start = F.struct(who.cast(WHO).alias("who"), F.array().cast(f"array<{ROW}>").alias("rows"))
    folded = F.aggregate(used, start, lambda acc, x: F.when(x["last"] == 1, _period_over(acc, x, capacity)).otherwise(_moved(acc, x)))
    return sessions.select("session", F.explode(folded["rows"]).alias("r")).select("session", "r.*")
