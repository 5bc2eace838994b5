"""Typed rows from raw records: each file is one JSON list, each record a map of its keys to raw JSON.

A record keeps all of its keys until it is mapped, so an absent key differs from a null one, and keys
that nothing reads stay in a residual bag. What cannot be read is NULL and has a flag, or stops the job
where the source breaks its own rules (ids, booleans, locations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalars import clock_seconds, codes, namespaced_id

PROVIDER = "statsbomb"
NAMED = "id long, name string"


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """file_key, place, fields: a row for each record of the lists under path; a file is one match or team list."""
    files = spark.read.option("wholetext", True).text(path).withColumn("file_key", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1))
    rows = files.select("file_key", "value", F.from_json("value", "array<map<string,string>>").alias("list"))
    bad = F.coalesce(F.size("list") <= 0, F.lit(True))
    rows = rows.withColumn("list", F.when(bad, F.raise_error(F.concat(F.lit("not a list of records: "), F.col("file_key")))).otherwise(F.col("list")))
    return rows.select("file_key", F.posexplode("list").alias("place", "fields"))


def get(fields: Column, key: str) -> Column:
    """Raw JSON of a key; NULL when it is absent or null."""
    return F.try_element_at(fields, F.lit(key))


def nested(fields: Column, key: str) -> Column:
    return F.from_json(get(fields, key), "map<string,string>")


def name_of(fields: Column, key: str) -> Column:
    return F.from_json(get(fields, key), NAMED)["name"]


def number(fields: Column, key: str) -> Column:
    return get(fields, key).try_cast("double")


def whole(fields: Column, key: str) -> Column:
    return get(fields, key).try_cast("long")


def flag(fields: Column, key: str) -> Column:
    """An absent key is false; anything but a boolean is an error."""
    raw = get(fields, key)
    return F.when(raw.isNull(), F.lit(False)).when(raw.isin("true", "false"), raw == "true").otherwise(F.raise_error(F.lit(f"not a boolean: {key}")).cast("boolean"))


def id_of(fields: Column, key: str) -> Column:
    """Native id of an optional {id, name}; ids are positive."""
    own = F.from_json(get(fields, key), NAMED)["id"]
    return F.when(get(fields, key).isNull(), F.lit(None).cast("long")).when(own > 0, own).otherwise(F.raise_error(F.lit(f"not an id: {key}")).cast("long"))


def place_of(fields: Column, key: str) -> Column:
    """x and y as shares of the pitch; a location has two numbers."""
    raw = get(fields, key)
    at = F.from_json(raw, "array<double>")
    good = (F.size(at) == 2) & ~F.exists(at, lambda v: v.isNull())
    made = F.struct((F.get(at, F.lit(0)) / S.LENGTH).alias("x"), (F.get(at, F.lit(1)) / S.WIDTH).alias("y"))
    return F.when(raw.isNull(), F.lit(None)).when(F.coalesce(good, F.lit(False)), made).otherwise(F.raise_error(F.lit(f"not a location: {key}")).cast("struct<x:double,y:double>"))


def pass_outcome(value: Column) -> Column:
    """Outcome of a pass record: complete without the key, a known name, else unknown."""
    known = F.coalesce(*[F.when(name_of(value, "outcome") == n, F.lit(o)) for n, o in S.PASS_OUTCOMES.items()], F.lit("unknown"))
    return F.when(F.map_contains_key(value, "outcome"), known).otherwise("complete")


def details(fields: Column, kind: Column) -> dict[str, Column]:
    """pass_detail, carry_detail, shot_detail, defensive_detail: the one of the event's type, the others NULL."""
    p, s = nested(fields, "pass"), nested(fields, "shot")
    carry = nested(fields, "carry")
    end = F.from_json(get(s, "end_location"), "array<double>")
    wrong = get(s, "end_location").isNotNull() & ~F.coalesce(F.size(end).isin(2, 3), F.lit(False))
    shot_end = F.when(wrong, F.raise_error(F.lit("a shot ends at two or three coordinates")).cast("array<double>")).otherwise(end)
    keys = {"Duel": "duel", "Interception": "interception", "Ball Recovery": "ball_recovery", "Block": "block", "Clearance": "clearance"}
    own = F.coalesce(*[F.when(kind == k, nested(fields, v)) for k, v in keys.items()], F.from_json(F.lit("{}"), "map<string,string>"))
    return {
        "pass_detail": F.when(
            kind == "Pass",
            F.struct(
                place_of(p, "end_location").alias("end_location"), id_of(p, "recipient").alias("recipient_id"), pass_outcome(p).alias("outcome"), get(p, "assisted_shot_id").alias("assisted_shot_id"),
                flag(p, "goal_assist").alias("goal_assist"), flag(p, "shot_assist").alias("shot_assist"), number(p, "length").alias("length"), number(p, "angle").alias("angle"),
                name_of(p, "height").alias("height"), name_of(p, "body_part").alias("body_part"), name_of(p, "type").alias("pass_type"), flag(p, "switch").alias("switch"), flag(p, "cross").alias("cross"),
            ),
        ),
        "carry_detail": F.when(kind == "Carry", F.struct(place_of(carry, "end_location").alias("end_location"))),
        "shot_detail": F.when(
            kind == "Shot",
            F.struct(
                number(s, "statsbomb_xg").alias("xg"), name_of(s, "outcome").alias("outcome"), name_of(s, "body_part").alias("body_part"), name_of(s, "type").alias("shot_type"),
                get(s, "key_pass_id").alias("key_pass_id"), name_of(s, "technique").alias("technique"), shot_end.alias("end_location"),
            ),
        ),
        "defensive_detail": F.when(
            kind.isin(list(keys)),
            F.struct(
                name_of(own, "type").alias("subtype"), name_of(own, "outcome").alias("outcome"),
                F.when(kind == "Ball Recovery", flag(own, "recovery_failure")).alias("recovery_failure"), F.when(kind.isin("Block", "Ball Recovery"), flag(own, "offensive")).alias("offensive"),
            ),
        ),
    }


def card_of(fields: Column) -> Column:
    """Card of a foul, else of bad behaviour."""
    own = lambda k: F.from_json(get(nested(fields, k), "card"), NAMED)
    return F.coalesce(own("foul_committed"), own("bad_behaviour"))


def residual(fields: Column, known) -> Column:
    """What nothing reads, as a map of raw JSON."""
    return F.map_filter(fields, lambda k, _: ~k.isin(list(known)))


def events(records: DataFrame) -> DataFrame:
    """Canonical events of the records of `raw_records`; file_key is the match."""
    f = F.col("fields")
    kind, type_id = name_of(f, "type"), F.from_json(get(f, "type"), NAMED)["id"]
    reviewed = F.coalesce(*[F.when(type_id == i, F.lit(n)) for i, n in S.EVENT_TYPES.items()])
    tactics = nested(f, "tactics")
    players = F.from_json(get(tactics, "lineup"), "array<struct<player:struct<id:bigint,name:string>,position:struct<id:bigint,name:string>,jersey_number:int>>")
    edges = F.map_concat(F.coalesce(nested(f, "half_start"), F.from_json(F.lit("{}"), "map<string,string>")), F.coalesce(nested(f, "half_end"), F.from_json(F.lit("{}"), "map<string,string>")))
    detail = details(f, kind)
    unread = F.size(F.array_except(F.map_keys(f), F.array(*map(F.lit, [*S.COMMON_FIELDS, *S.DETAIL_FIELDS])))) > 0
    return records.select(
        F.col("file_key").alias("match_id"),
        get(f, "id").alias("event_id"),
        whole(f, "index").alias("index"),
        whole(f, "period").cast("int").alias("period"),
        clock_seconds(get(f, "timestamp")).alias("elapsed"),
        kind.alias("event_type"),
        type_id.alias("source_type_id"),
        id_of(f, "team").alias("team_id"),
        id_of(f, "player").alias("player_id"),
        namespaced_id(PROVIDER, "player", id_of(f, "player")).alias("player_key"),
        id_of(f, "possession_team").alias("possession_team_id"),
        name_of(f, "position").alias("position"),
        name_of(f, "play_pattern").alias("play_pattern"),
        place_of(f, "location").alias("start_location"),
        number(f, "duration").alias("duration"),
        *[flag(f, k).alias(k) for k in ("under_pressure", "counterpress", "off_camera")],
        F.coalesce(F.from_json(get(f, "related_events"), "array<string>"), F.array().cast("array<string>")).alias("related_event_ids"),
        *[c.alias(k) for k, c in detail.items()],
        id_of(nested(f, "substitution"), "replacement").alias("replacement_id"),
        card_of(f)["name"].alias("card"),
        card_of(f)["id"].alias("source_card_id"),
        F.when(kind == "Player Off", flag(nested(f, "player_off"), "permanent")).alias("permanent"),
        codes([(flag(edges, k), k) for k in ("late_video_start", "early_video_end", "match_suspended")]).alias("boundary_flags"),
        get(tactics, "formation").alias("formation"),
        F.transform(players, lambda p: F.struct(p["player"]["id"].alias("player_id"), p["position"]["id"].cast("int").alias("source_position_id"), p["position"]["name"].alias("position_name"), p["jersey_number"].alias("jersey_number"))).alias("tactical"),
        codes([
            (F.coalesce(reviewed != kind, F.lit(True)), "UNREVIEWED_EVENT_TYPE"),
            (F.coalesce(detail["pass_detail"]["outcome"] == "unknown", F.lit(False)), "UNMAPPED_PASS_OUTCOME"),
            (unread, "UNREVIEWED_SOURCE_FIELDS"),
        ]).alias("quality_flags"),
        residual(f, S.COMMON_FIELDS).alias("source_attributes"),
    )


def line_up_point(text: Column, period: Column) -> Column:
    """(period, elapsed) of a MM:SS clock that runs through the periods; NULL when it is malformed or before its period."""
    part = F.split(text, ":")
    at = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    base = F.coalesce(*[F.when(period == p, F.lit(float(b))) for p, b in S.PERIOD_BASE.items()])
    seconds = at(1) * 60 + at(2) - base
    return F.when(text.rlike(r"^\d+:\d{2}(\.\d+)?$") & (at(2) < 60) & (seconds >= 0), F.struct(period.cast("int").alias("period"), seconds.alias("elapsed")))


def line_ups(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roster, positions, cards) of the team sheets; a match has two distinct teams."""
    f = F.col("fields")
    sheet = records.select(F.col("file_key").alias("match_id"), whole(f, "team_id").alias("team_id"), get(f, "team_name").alias("team_name"), F.from_json(get(f, "lineup"), "array<map<string,string>>").alias("lineup"), residual(f, S.SHEET_FIELDS).alias("team_attributes"))
    teams = sheet.groupBy("match_id").agg(F.count("*").alias("n"), F.count_distinct("team_id").alias("k"))
    wrong = F.when((F.col("n") != 2) | (F.col("k") != 2), F.raise_error(F.concat(F.lit("two distinct team sheets expected in "), F.col("match_id"))).cast("boolean")).otherwise(True)
    sheet = sheet.join(teams.select("match_id", wrong.alias("checked")), "match_id").where("checked")
    entry = sheet.select("match_id", "team_id", "team_name", F.explode("lineup").alias("e"))
    e = F.col("e")
    roster = entry.select(
        "match_id", "team_id", "team_name", whole(e, "player_id").alias("player_id"), get(e, "player_name").alias("player_name"), get(e, "player_nickname").alias("nickname"),
        name_of(e, "country").alias("country"), whole(e, "jersey_number").cast("int").alias("jersey_number"), residual(e, S.ENTRY_FIELDS).alias("source_attributes"),
    )
    key = [F.col("match_id"), F.col("team_id"), whole(e, "player_id").alias("player_id")]
    o = F.col("o")
    seen = entry.select(*key, F.explode(F.from_json(get(e, "positions"), "array<map<string,string>>")).alias("o"))
    start, end = line_up_point(get(o, "from"), whole(o, "from_period")), line_up_point(get(o, "to"), whole(o, "to_period"))
    order = lambda a, b: (a["period"] < b["period"]) | ((a["period"] == b["period"]) & (a["elapsed"] < b["elapsed"]))
    both = start.isNotNull() & end.isNotNull()
    same = (start["period"] == end["period"]) & (start["elapsed"] == end["elapsed"])
    flags = codes([
        (start.isNull(), "INVALID_SOURCE_POSITION_START"),
        (get(o, "to").isNotNull() & end.isNull(), "INVALID_SOURCE_POSITION_END"),
        (F.coalesce(both & same, F.lit(False)), "ZERO_DURATION_POSITION_OBSERVATION"),
        (F.coalesce(both & order(end, start), F.lit(False)), "REVERSED_SOURCE_POSITION_INTERVAL"),
    ])
    positions = seen.select(
        "match_id", "team_id", "player_id", whole(o, "position_id").cast("int").alias("position_id"), get(o, "position").alias("position_name"), start.alias("start"), end.alias("end"),
        get(o, "start_reason").alias("start_reason"), get(o, "end_reason").alias("end_reason"), flags.alias("quality_flags"), o.alias("source_attributes"),
    )
    shown = entry.select(*key, F.explode(F.from_json(get(e, "cards"), "array<map<string,string>>")).alias("o"))
    at = line_up_point(get(o, "time"), whole(o, "period"))
    cards = shown.select("match_id", "team_id", "player_id", get(o, "card_type").alias("card_type"), get(o, "reason").alias("reason"), at.alias("time"), codes([(at.isNull(), "INVALID_SOURCE_CARD_CLOCK")]).alias("quality_flags"), o.alias("source_attributes"))
    return roster, positions, cards
