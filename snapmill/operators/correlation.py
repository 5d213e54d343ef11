"""Correlation of series with a target and with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill.functions.stats import bonferroni_r, pearson
from snapmill.operators.series import KEYS, of


def with_target(series: DataFrame, target: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    at = [*keys, "snap_id"]
    return series.join(target.select(*at, F.col("value").alias("target")), at)


def to_target(series: DataFrame, target: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Correlation of each name with the target, with sums, means and deviations; 0 where either is constant."""
    return with_target(series, target, keys).groupBy(*keys, "name").agg(pearson("value", "target").alias("r"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.count(F.lit(1)).alias("n"))


def significant(correlated: DataFrame, target: DataFrame, least: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Those beyond the greater of ``least`` and the Bonferroni bound of as many tests as the key has names, over as many pairs as the target has
    snapshots."""
    pairs = target.groupBy(*keys).agg(F.count_distinct("snap_id").alias("_pairs"))
    tests = correlated.withColumn("_tests", F.count(F.lit(1)).over(of(keys))).join(pairs, [*keys])
    return tests.where(F.abs("r") >= F.greatest(F.lit(least), bonferroni_r("_tests", "_pairs"))).drop("_tests", "_pairs")


def strong_pairs(left: DataFrame, right: DataFrame, least: float = 0.333, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of one name of each side, aligned by snapshot, that correlate: every name of a key's left side with every one of its right side,
    which thus hold the names that matter, as a report's top lists do."""
    at = [*keys, "snap_id"]
    joined = left.select(*at, F.col("name").alias("left_name"), F.col("value").alias("x")).join(right.select(*at, F.col("name").alias("right_name"), F.col("value").alias("y")), at)
    return joined.groupBy(*keys, "left_name", "right_name").agg(pearson("x", "y").alias("r")).where(F.abs("r") >= least)


def over_partition(series: DataFrame, target: DataFrame, least: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names whose correlation with the target over their partition reaches ``least``."""
    w = of(keys, "name")
    spread = F.stddev_pop("value").over(w) * F.stddev_pop("target").over(w)
    r = F.covar_pop("value", "target").over(w) / F.nullif(spread, F.lit(0.0))
    return with_target(series, target, keys).withColumn("r", r).where(F.col("r") >= least).select(*keys, "name", F.round("r", 6).alias("r")).distinct()


def ratio_stats(series: DataFrame, top: str, bottom: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and deviation over snapshots of one name's value over the sum of others', 0 where that is 0."""
    at = [*keys, "snap_id"]
    wide = series.where(F.col("name").isin(top, *bottom)).groupBy(*at).agg(F.sum(F.when(F.col("name") == top, F.col("value"))).alias("a"), F.sum(F.when(F.col("name").isin(*bottom), F.col("value"))).alias("b"))
    ratio = F.when(F.col("b") != 0, F.col("a") / F.nullif("b", F.lit(0.0))).otherwise(0.0)
    return wide.withColumn("ratio", ratio).groupBy(*keys).agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("spread"), F.count("ratio").alias("n"))


def partition_stats(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, mean, deviation, greatest and least value of a series beside each of its values."""
    w = of(keys, "name")
    return series.select(*keys, "snap_id", "name", "value", F.count("value").over(w).alias("n"), F.avg("value").over(w).alias("mean"), F.stddev_samp("value").over(w).alias("spread"), F.max("value").over(w).alias("most"), F.min("value").over(w).alias("least"))
