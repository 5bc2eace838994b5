"""Raw records counted from their files, to hold a canonical table against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fingerprint import differences


def raw_records(spark: SparkSession, path: str, record_id: str = "$.id") -> DataFrame:
    """(key, place, id, record) of files that hold one JSON array each; key is the file's name without its ending.

    Records stay VARIANT values, so nothing is assumed of their fields. A file that is no array has one row with a
    NULL record.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file"), F.try_parse_json("value").alias("whole"))
    rows = files.lateralJoin(spark.tvf.variant_explode_outer(F.col("whole").outer()))
    return rows.select(F.col("file").alias("key"), F.col("pos").alias("place"), F.try_variant_get("value", record_id, "string").alias("id"), F.col("value").alias("record"))


def reconciled(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """(key, id, n_raw, n_canonical, code): records that were dropped, doubled or come from nowhere.

    Both have key and id. Keys are compared by digests; only those that differ are compared record by record.
    """
    rows = differences(raw.where("id is not null"), canonical, ["key"], ["id"]).withColumnsRenamed({"n_first": "n_raw", "n_second": "n_canonical"})
    code = F.when(F.col("n_raw") == 0, "FOREIGN").when(F.col("n_canonical") > F.col("n_raw"), "DOUBLED").otherwise("DROPPED")
    return rows.withColumn("code", code)
