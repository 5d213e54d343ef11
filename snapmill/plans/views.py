"""Metric views over the test tables, as DataFrames and as the same SQL.

Re-delivered rows count once: of equal keys the greatest value holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmill.common import load

AT = ["db_id", "instance_num", "snap_id"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("instance_num", F.col("instance_num").cast("bigint")).withColumnRenamed("begin_snap_id", "snap_id")


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Load profile: per second by statistic."""
    return _keyed(load(spark, d, "load_profile")).where("per_second is not null").groupBy(*AT, F.col("stat_name").alias("name")).agg(F.max("per_second").alias("value"))


def waits(spark: SparkSession, d: str, kind: str = "foreground") -> DataFrame:
    """Wait events of one kind: time, count, share."""
    own = _keyed(load(spark, d, "wait_events")).where(F.col("wait_kind") == kind)
    return own.where("total_wait_time_s is not null").groupBy(*AT, F.col("event").alias("name")).agg(F.max("total_wait_time_s").alias("value"), F.max("waits").alias("waits"), F.max("pct_dbtime").alias("pct"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """The tables' numbers in the form of ``collection.metrics``."""
    at, value = [*AT, "kind", "name"], F.col("value")
    rates = _keyed(load(spark, d, "load_profile")).select(*AT, F.lit("load_profile").alias("kind"), F.col("stat_name").alias("name"), F.col("per_second").alias("value"))
    waits_ = _keyed(load(spark, d, "wait_events")).select(*AT, F.concat(F.col("wait_kind"), F.lit("_wait_events")).alias("kind"), F.col("event").alias("name"), F.col("total_wait_time_s").alias("value"))
    rows = rates.unionByName(waits_).where(value.isNotNull()).groupBy(*at).agg(F.max("value").alias("value"))
    return rows.select(*at, F.when(F.col("kind") == "load_profile", "per_second").otherwise("total_wait_time_s").alias("field"), "value")


def named(spark: SparkSession, d: str, name: str) -> DataFrame:
    return stats(spark, d).where(F.col("name") == name)


def snaps(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of instances with their end."""
    own = _keyed(load(spark, d, "snap_info")).where("end_snap_id > snap_id")
    return own.groupBy(*AT).agg(F.max("end_snap_id").alias("end_id"), F.max("end_snap_time").alias("ends"))


def days(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and user: a sparse series with many names, of one key."""
    own = load(spark, d, "events").select(F.lit(1).cast("bigint").alias("db_id"), F.lit(1).cast("bigint").alias("instance_num"), F.unix_date(F.to_date("ts")).cast("bigint").alias("snap_id"), F.col("user_id").cast("string").alias("name"), "value")
    return own.groupBy(*AT, "name").agg(F.sum("value").alias("value"))


SQL = {
    "stats": "stats AS (SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, begin_snap_id AS snap_id, stat_name AS name, max(per_second) AS value FROM load_profile WHERE per_second IS NOT NULL GROUP BY ALL)",
    "waits": "waits AS (SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, begin_snap_id AS snap_id, event AS name, max(total_wait_time_s) AS value, max(waits) AS waits, max(pct_dbtime) AS pct FROM wait_events WHERE wait_kind = 'foreground' AND total_wait_time_s IS NOT NULL GROUP BY ALL)",
    "backs": "backs AS (SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, begin_snap_id AS snap_id, event AS name, max(total_wait_time_s) AS value FROM wait_events WHERE wait_kind = 'background' AND total_wait_time_s IS NOT NULL GROUP BY ALL)",
    "dbtime": "dbtime AS (SELECT * FROM stats WHERE name = 'DB Time(s)')",
    "dbcpu": "dbcpu AS (SELECT * FROM stats WHERE name = 'DB CPU(s)')",
    "snaps": "snaps AS (SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, begin_snap_id AS snap_id, max(end_snap_id) AS end_id, max(end_snap_time) AS ends FROM snap_info WHERE end_snap_id > begin_snap_id GROUP BY ALL)",
    "days": "days AS (SELECT CAST(1 AS BIGINT) AS db_id, CAST(1 AS BIGINT) AS instance_num, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS snap_id, CAST(user_id AS VARCHAR) AS name, sum(value) AS value FROM events GROUP BY ALL)",
}


def with_views(names: str, query: str, more: str = "") -> str:
    """``query`` with the named views (and ``more`` CTEs) before it."""
    return "WITH " + ",\n".join([*(SQL[n] for n in names.split()), *([more] if more else [])]) + "\n" + query
