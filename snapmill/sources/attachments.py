"""Files that lie beside reports: execution plans, operating-system outputs, links, snapshot pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmill.functions.text import safe_path
from snapmill.operators import series

PLAN_BYTES, OS_BYTES = 512 * 1024, 64 * 1024


def plans(spark: SparkSession, folder: str, pattern: str = "", limit: int = 100) -> DataFrame:
    """``sql_id, bytes, plan, truncated`` of the ``*.xplan`` files whose id holds ``pattern``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xplan").load(folder)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.xplan$", 1).alias("sql_id"), F.col("length").alias("bytes"), F.decode(F.substring("content", 1, PLAN_BYTES), "UTF-8").alias("plan"), (F.col("length") > PLAN_BYTES).alias("truncated"))
    return rows.where(F.lower("sql_id").contains(pattern.lower())).orderBy("sql_id").limit(min(limit, 500))


def os_files(spark: SparkSession, folder: str, pattern: str = "", most_bytes: int = OS_BYTES) -> DataFrame:
    """``path, bytes, text, truncated`` of the files below a folder, four levels deep at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.removeprefix("file:").rstrip("/")
    rows = files.select(F.substring_index("path", root + "/", -1).alias("path"), F.col("length").alias("bytes"), F.decode(F.substring("content", 1, most_bytes), "UTF-8").alias("text"), (F.col("length") > most_bytes).alias("truncated"))
    return rows.where(safe_path(F.col("path")) & (F.size(F.split("path", "/")) <= 4) & F.lower("path").contains(pattern.lower()))


def os_texts(spark: SparkSession, folder: str, pattern: str = "") -> DataFrame:
    """``os_files`` with whole texts, for what reads all their readings."""
    return os_files(spark, folder, pattern, most_bytes=2**31 - 1)


def links(mapping: DataFrame, names: DataFrame) -> DataFrame:
    """Links of the entities that occur: ``mapping`` has ``entity`` and ``links`` (JSON, a list of action and url)."""
    known = mapping.select("entity", F.explode(F.from_json("links", "array<struct<action:string,url:string>>")).alias("l"))
    return known.join(names.select(F.col("name").alias("entity")).distinct(), "entity", "left_semi").select("entity", "l.action", "l.url")


def report_pairs(snaps: DataFrame, starts: DataFrame | None = None, least_minutes: int = 30) -> DataFrame:
    """Pairs of snapshots to report on: consecutive ones of an instance (``db_id, instance_num, snap_id, at``), so many minutes
    apart; with ``starts`` (``db_id, instance_num, started``) only those after the last start."""
    if starts is not None:
        last = starts.groupBy("db_id", "instance_num").agg(F.max("started").alias("_started"))
        snaps = snaps.join(last, ["db_id", "instance_num"]).where(F.col("at") >= F.col("_started")).drop("_started")
    return series.pairs(snaps, least_minutes=least_minutes, at="at")
