"""Flagship: actions to rates to mid-rank percentiles to the best of each role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profiles import top_of_each
from .cohort import Cohort


def shortlist(spark, sf_dir: str, min_peers: int = 2, k: int = 3) -> DataFrame:
    rows = Cohort(spark, sf_dir, min_peers=min_peers).percentiles.where("metric = 'passes_attempted' and status = 'AVAILABLE'")
    top = top_of_each(rows, ["role"], [F.desc("percentile"), F.col("player_id"), F.col("team_id")], k)
    return top.select("role", "rank", "player_id", "team_id", F.round("per90", 6).alias("per90"), F.round("percentile", 6).alias("percentile"))
