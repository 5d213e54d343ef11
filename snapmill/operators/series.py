"""Operators on long metric tables: keys, ``snap_id, name, value``.

``keys`` name whose series it is (an instance). Windows are per key and name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("db_id", "instance_num")


def of(keys: Sequence[str], *more: str):
    return Window.partitionBy(*keys, *more)


#: Parts that the names of a key are divided into where they meet its snapshots, so that a key with most rows isn't one task's.
PARTS = 16


def densify(fact: DataFrame, fill: float, keys: Sequence[str] = KEYS, snaps: DataFrame | None = None) -> DataFrame:
    """Every name of a key in every snapshot of that key; absent slots hold ``fill``."""
    names = fact.select(*keys, "name").distinct().withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(PARTS)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part")
    grid = (fact if snaps is None else snaps).select(*keys, "snap_id").distinct().select("*", parts).join(names, [*keys, "_part"]).drop("_part")
    return grid.join(fact.select(*keys, "snap_id", "name", "value"), [*keys, "snap_id", "name"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def delta(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First differences; the first snapshot of a series has none."""
    w = of(keys, "name").orderBy("snap_id")
    return series.withColumn("delta", F.col("value") - F.lag("value").over(w)).where("delta is not null").select(*keys, "snap_id", "name", "delta")


def standardized(deltas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Differences less their mean over their sample deviation; no deviation counts as 1e-12."""
    w = of(keys, "name")
    spread = F.stddev_samp("delta").over(w)
    return deltas.withColumn("z", (F.col("delta") - F.avg("delta").over(w)) / F.when(spread > 0, spread).otherwise(1e-12))


def pairs(snaps: DataFrame, keys: Sequence[str] = KEYS, least_minutes: int = 0, at: str | None = None) -> DataFrame:
    """Consecutive snapshots of a key as ``begin_id, end_id``; with ``at``, only those so many minutes apart."""
    w = of(keys).orderBy("snap_id")
    out = snaps.withColumn("end_id", F.lead("snap_id").over(w))
    if at:
        out = out.withColumn("minutes", (F.unix_seconds(F.lead(at).over(w)) - F.unix_seconds(at)) / 60).where(F.col("minutes") >= least_minutes)
    return out.where("end_id is not null").select(*keys, F.col("snap_id").alias("begin_id"), "end_id", *(["minutes"] if at else []))


def zscore(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(x - mean) / population deviation, 0 for a constant series."""
    w = of(keys, "name")
    spread = F.stddev_pop("value").over(w)
    return series.withColumn("z", F.when(spread > 0, (F.col("value") - F.avg("value").over(w)) / F.nullif(spread, F.lit(0.0))).otherwise(0.0))


def robust_z(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(x - upper median) / (1.4826 MAD), 0 where the MAD is 0."""
    middle = lambda x: F.element_at(F.sort_array(F.collect_list(x)), (F.count(x) / 2).cast("int") + 1)
    medians = series.groupBy(*keys, "name").agg(middle("value").alias("m"))
    off = series.join(medians, [*keys, "name"])
    mads = off.groupBy(*keys, "name").agg(middle(F.abs(F.col("value") - F.col("m"))).alias("mad"))
    return off.join(mads, [*keys, "name"]).withColumn("z", F.when(F.col("mad") > 0, (F.col("value") - F.col("m")) / F.nullif(1.4826 * F.col("mad"), F.lit(0.0))).otherwise(0.0)).drop("m", "mad")


def robust_minmax(series: DataFrame, low: float = 0.05, high: float = 0.95, log: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Values scaled to 0 to 100 between two percentiles of the series, clipped; with ``log``, of log1p (negative ones as 0)."""
    x = F.log1p(F.greatest("value", F.lit(0.0))) if log else F.col("value")
    own = series.withColumn("x", x)
    bounds = own.groupBy(*keys, "name").agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("b"))
    lo, hi = F.col("b")[0], F.col("b")[1]
    scaled = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("x") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100))).otherwise(0.0)
    return own.join(bounds, [*keys, "name"]).withColumn("scaled", scaled).drop("x", "b")


def split_windows(snaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Snapshots as ``baseline`` or ``recent``: recent is the last quarter (2 to 48), with 3 or more left as baseline."""
    i, n = F.row_number().over(of(keys).orderBy("snap_id")), F.count(F.lit(1)).over(of(keys))
    recent = F.least(F.greatest(F.ceil(n * 0.25), F.lit(2)), F.lit(48))
    recent = F.when(n - recent < 3, F.greatest(n - 3, F.lit(0))).otherwise(recent)
    return snaps.withColumn("part", F.when(i > n - recent, "recent").otherwise("baseline"))


def in_range(df: DataFrame, low: int, high: int, begin: str = "begin_snap_id", end: str = "end_snap_id") -> DataFrame:
    """Snapshots that lie within a range of ids."""
    if low >= high:
        raise ValueError("the range needs low < high")
    return df.where((F.col(begin) >= low) & (F.col(end) <= high))


def prefix_within(df: DataFrame, size: Column, budget: int, order: Sequence[Column]) -> DataFrame:
    """The longest run of first rows whose sizes add up to ``budget`` at most. For a report's parts, which are few."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)
