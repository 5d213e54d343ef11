"""Anomalies by median absolute deviation, over whole series or sliding windows, and their clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmill.common import join_same
from snapmill.operators.series import KEYS, of

THRESHOLD, TOP = 7.0, 10


def middle(sorted_array: Column) -> Column:
    """Median of a sorted array, null for an empty one."""
    n = F.size(sorted_array)
    at = lambda i: F.get(sorted_array, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.ceil((n - 1) / 2))) / 2


def best(scored: DataFrame, threshold: float, top: int, keys: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(of(keys, "name").orderBy(F.col("score").desc(), "snap_id"))
    return scored.where((F.col("mad") > 0) & (F.col("score") > threshold) & (F.col("value") >= 0)).withColumn("rank", rank).where(F.col("rank") <= top).select(*keys, "snap_id", "name", "value", "score", "rank")


def mad_global(series: DataFrame, threshold: float = THRESHOLD, top: int = TOP, keys: Sequence[str] = KEYS) -> DataFrame:
    """Values more than ``threshold`` MADs from the median of their series, the ``top`` of each series.

    Negative values mark missing slots: they take part in median and MAD and are never reported. A series without deviation has none.
    """
    w = of(keys, "name")  # medians, deviations and ranks share one exchange; a series is as long as there are snapshots
    off = series.withColumn("off", F.abs(F.col("value") - F.median("value").over(w)))
    scored = off.withColumn("mad", F.median("off").over(w)).withColumn("score", F.col("off") / F.nullif("mad", F.lit(0.0)))
    return best(scored, threshold, top, keys)


def mad_sliding(series: DataFrame, percent: float, snapshots: int, threshold: float = THRESHOLD, top: int = TOP, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same against a window of ``percent`` of the ``snapshots`` around each value.

    The window is rounded up to an even length. At the head of a series it keeps its length and starts at the first value; at
    the tail it is cut off. 100 percent is the global form.
    """
    if percent >= 100:
        return mad_global(series, threshold, top, keys)
    full = int(percent / 100 * snapshots)
    full += full % 2
    half = full // 2
    if not full:
        return mad_global(series, threshold, top, keys).limit(0)
    w = of(keys, "name").orderBy("snap_id")
    placed = series.withColumn("i", F.row_number().over(w) - 1).withColumn("around", F.collect_list("value").over(w.rowsBetween(-half, half - 1)))
    heads = placed.where(F.col("i") < full).groupBy(*keys, "name").agg(F.sort_array(F.collect_list("value")).alias("head"))
    head = join_same(placed.where(F.col("i") < half), heads, [*keys, "name"]).withColumn("frame", F.col("head")).drop("head")
    framed = placed.where(F.col("i") >= half).withColumn("frame", F.sort_array("around")).unionByName(head)
    # lambda variables hold what is used twice, and the explosion keeps the optimiser from writing it out again
    with_middle = F.transform(F.array("frame"), lambda f: F.struct(f.alias("f"), middle(f).alias("m")))
    stats = F.transform(with_middle, lambda s: F.struct(s["m"].alias("m"), middle(F.sort_array(F.transform(s["f"], lambda x: F.abs(x - s["m"])))).alias("mad")))
    scored = framed.select(*keys, "snap_id", "name", "value", F.explode(stats).alias("s")).select(*keys, "snap_id", "name", "value", "s.*")
    return best(scored.withColumn("score", F.abs(F.col("value") - F.col("m")) / F.nullif("mad", F.lit(0.0))), threshold, top, keys)


def union_domains(domains: dict[str, DataFrame]) -> DataFrame:
    """Anomalies of several domains as one table with ``domain``."""
    out = None
    for name, df in domains.items():
        df = df.withColumn("domain", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def trim(anomalies: DataFrame, top: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``top`` highest scores of each snapshot and domain; none for 0."""
    rank = F.row_number().over(of(keys, "snap_id", "domain").orderBy(F.col("score").desc(), "name"))
    return anomalies.withColumn("place", rank).where(F.col("place") <= top).drop("place")


def clusters(anomalies: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Anomalies per snapshot."""
    return anomalies.groupBy(*keys, "snap_id").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("domain").alias("domains"), F.max("score").alias("most"))


def top_clusters(found: DataFrame, top: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``top`` largest clusters of each key."""
    rank = F.row_number().over(of(keys).orderBy(F.col("size").desc(), "snap_id"))
    return found.withColumn("place", rank).where(F.col("place") <= top)


def heatmap(anomalies: DataFrame, snaps: DataFrame, domains: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Anomalies per snapshot and domain, 0 where there are none."""
    counts = anomalies.groupBy(*keys, "snap_id").pivot("domain", list(domains)).agg(F.count(F.lit(1)))
    return snaps.select(*keys, "snap_id").distinct().join(counts, [*keys, "snap_id"], "left").na.fill(0, list(domains))


def summaries(anomalies: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per snapshot the count and a text of all anomalies, as the per-snapshot CSV holds them."""
    line = F.concat_ws(" ", F.col("domain"), F.col("name"), F.format_number(F.col("score"), 2))
    return anomalies.groupBy(*keys, "snap_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("; ", F.sort_array(F.collect_list(line))).alias("summary"))


def write_csv(anomalies: DataFrame, folder: str, keys: Sequence[str] = KEYS) -> None:
    """One CSV of counts by snapshot, and one folder per snapshot with its anomalies, quoted as needed."""
    anomalies.groupBy(*keys, "snap_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(f"{folder}/summary")
    summaries(anomalies, keys).write.mode("overwrite").partitionBy("snap_id").option("header", True).option("escape", '"').csv(f"{folder}/snapshots")


