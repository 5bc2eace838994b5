"""JSON sources: one multi-line list of records per file, read with a fixed schema, and the strict gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPETITIONS = "competition_id long, season_id long, competition_name string, season_name string, country_name string, competition_gender string, competition_youth boolean, competition_international boolean"
MATCHES = (
    "match_id long, competition struct<competition_id:long>, season struct<season_id:long>, match_date date, home_score int, away_score int, "
    "home_team struct<home_team_id:long,home_team_name:string>, away_team struct<away_team_id:long,away_team_name:string>"
)
EVENTS = (
    "id string, index int, period int, timestamp string, type struct<id:int,name:string>, team struct<id:long,name:string>, player struct<id:long,name:string>, "
    "location array<double>, play_pattern struct<id:int,name:string>, counterpress boolean, "
    "pass struct<end_location:array<double>,length:double,outcome:struct<name:string>,type:struct<name:string>,assisted_shot_id:string,shot_assist:boolean,goal_assist:boolean,switch:boolean,cross:boolean>, "
    "carry struct<end_location:array<double>>, shot struct<outcome:struct<name:string>,statsbomb_xg:double,type:struct<name:string>,key_pass_id:string>, "
    "duel struct<type:struct<name:string>>, ball_recovery struct<recovery_failure:boolean>, substitution struct<replacement:struct<id:long>>, "
    "player_off struct<permanent:boolean>, foul_committed struct<card:struct<name:string>>, bad_behaviour struct<card:struct<name:string>>"
)
LINEUPS = (
    "team_id long, team_name string, lineup array<struct<player_id:long,player_name:string,jersey_number:int,"
    "positions:array<struct<position_id:int,position:string,`from`:string,`to`:string,from_period:int,to_period:int,start_reason:string,end_reason:string>>,"
    "cards:array<struct<time:string,period:int,card_type:string,reason:string>>>>"
)


def accepted(raw: Column) -> Column:
    """Valid JSON without repeated keys, NaN or Infinity and without a number beyond the double range."""
    parsed = F.try_parse_json(raw)
    # only numbers in exponent form or of very many digits can overflow; their value is checked where they occur
    long = r"(?<![\w\"])-?(?:\d+(?:\.\d+)?[eE]\+?\d+|\d{309,}(?:\.\d+)?)"
    big = F.exists(F.regexp_extract_all(raw, F.lit(long), 0), lambda x: F.abs(x.try_cast("double")) == float("inf"))
    return parsed.isNotNull() & ~F.coalesce(big, F.lit(False))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all files under path; a file is one JSON list, its name without suffix is `file_key`."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("file_key", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1))


def competitions(spark, path: str) -> DataFrame:
    """The catalog; a competition and season that it has twice is an error."""
    rows = records(spark, path, COMPETITIONS)
    twice = rows.groupBy("competition_id", "season_id").agg(F.count("*").alias("n")).where("n > 1").orderBy("competition_id", "season_id").limit(3).collect()
    if twice:
        raise ValueError("repeated in the catalog: " + ", ".join(f"{r['competition_id']}/{r['season_id']}" for r in twice))
    return rows


def matches(spark, path: str, competition: int, season: int) -> DataFrame:
    """Matches of one competition and season in the order of their ids; others in the files are an error."""
    rows = records(spark, path, MATCHES)
    own = (F.col("competition.competition_id") == competition) & (F.col("season.season_id") == season)
    bad = rows.agg(F.count_if(~own).alias("foreign"), (F.count("*") - F.count_distinct("match_id")).alias("twice")).first()
    if bad["foreign"] or bad["twice"]:
        raise ValueError(f"{bad['foreign']} foreign and {bad['twice']} repeated matches")
    return rows.orderBy("match_id")


def events(spark, path: str) -> DataFrame:
    return records(spark, path, EVENTS).withColumn("match_id", F.col("file_key").cast("long"))


def lineups(spark, path: str) -> DataFrame:
    """A row per position of every player on a team sheet."""
    rows = records(spark, path, LINEUPS).withColumn("match_id", F.col("file_key").cast("long"))
    entry = rows.select("match_id", "team_id", "team_name", F.explode_outer("lineup").alias("e"))
    return entry.select("match_id", "team_id", "team_name", "e.player_id", "e.player_name", "e.jersey_number", F.explode_outer("e.positions").alias("position"), F.col("e.cards").alias("cards"))
