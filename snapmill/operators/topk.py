"""Peaks and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill.operators.series import KEYS, of


def peaks(dbtime: DataFrame, dbcpu: DataFrame, ratio: float, more_than: float = 0.0, load: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Snapshots that mostly wait: CPU over database time below ``ratio``, both positive, and ``load`` (the load profile's database
    time) above ``more_than`` unless that is 0."""
    at = [*keys, "snap_id"]
    both = dbtime.select(*at, F.col("value").alias("dbtime")).join(dbcpu.select(*at, F.col("value").alias("dbcpu")), at).where("dbtime > 0 and dbcpu > 0").withColumn("ratio", F.col("dbcpu") / F.col("dbtime")).where(F.col("ratio") < ratio)
    if more_than:
        both = both.join((load or dbtime).where(F.col("value") > more_than).select(*at), at, "left_semi")
    return both


def top_per_snapshot(series: DataFrame, top: int, only_if_more: int = 0, whole: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``top`` names of each snapshot by value (by its whole part with ``whole``), of snapshots with more than ``only_if_more`` names."""
    at = of(keys, "snap_id")
    order = F.floor("value") if whole else F.col("value")
    rank = F.row_number().over(at.orderBy(order.desc(), "name"))
    return series.withColumn("names", F.count(F.lit(1)).over(at)).withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("names") > only_if_more)).drop("names")


def busiest(dbtime: DataFrame, top: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``top`` snapshots of each key by database time."""
    return dbtime.withColumn("rank", F.row_number().over(of(keys).orderBy(F.col("value").desc(), "snap_id"))).where(F.col("rank") <= top)


def leader(series: DataFrame, by: str = "value", keys: Sequence[str] = KEYS) -> DataFrame:
    """The name with the greatest value in each snapshot; the last name of equal ones."""
    return series.where(F.col(by).isNotNull()).groupBy(*keys, "snap_id").agg(F.max_by("name", F.struct(by, "name")).alias("name"), F.max(by).alias("value"))


def rank_by_total(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names by the sum of the whole parts of their values."""
    totals = series.groupBy(*keys, "name").agg(F.sum(F.floor("value")).alias("total"))
    return totals.withColumn("rank", F.row_number().over(of(keys).orderBy(F.col("total").desc(), "name")))


def rank_by_presence(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names by the number of snapshots with a positive value."""
    totals = series.groupBy(*keys, "name").agg(F.count_if(F.col("value") > 0).alias("present"))
    return totals.withColumn("rank", F.row_number().over(of(keys).orderBy(F.col("present").desc(), "name")))


def selected(*sets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names that are in any of the sets."""
    out = sets[0].select(*keys, "name")
    for other in sets[1:]:
        out = out.unionByName(other.select(*keys, "name"))
    return out.distinct()
