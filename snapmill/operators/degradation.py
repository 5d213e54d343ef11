"""Recent snapshots compared with those before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill.functions.stats import mean0, nearest
from snapmill.operators.anomalies import middle
from snapmill.operators.series import KEYS, of, split_windows

# Bounds of what counts as degraded.
TARGET_Z, TARGET_CHANGE, STRONG_CHANGE, TAIL = 3.0, 25.0, 100.0, 1.25
NAME_Z, NAME_CHANGE, NAME_R = 2.5, 20.0, 0.3


def _moved(stats: DataFrame) -> DataFrame:
    """Rise, change in percent and robust z."""
    rise = F.col("now_mean") - F.col("was_mean")
    percent = F.when(F.abs("was_mean") < 1e-9, F.when(rise > 0, 100.0).otherwise(0.0)).otherwise(rise / F.nullif(F.abs("was_mean"), F.lit(0.0)) * 100)
    z = F.when(F.col("mad") <= 1e-9, F.when(rise > 0, 99.0).otherwise(0.0)).otherwise((F.col("now_median") - F.col("was_median")) / F.nullif(1.4826 * F.col("mad"), F.lit(0.0)))
    return stats.withColumn("rise", rise).withColumn("percent", percent).withColumn("z", z)


def _compared(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``compared`` of rows that know their ``part``. Window and aggregates share one exchange."""
    was = F.when(F.col("part") == "baseline", F.col("value"))
    now = F.when(F.col("part") == "recent", F.col("value"))
    middle = rows.withColumn("was_median", F.median(was).over(of(keys, "name")))
    off = F.when(F.col("part") == "baseline", F.abs(F.col("value") - F.col("was_median")))
    stats = middle.groupBy(*keys, "name").agg(F.first("was_median").alias("was_median"), mean0(was).alias("was_mean"), nearest(was, 0.9).alias("was_p90"), F.median(off).alias("mad"), mean0(now).alias("now_mean"), F.coalesce(F.median(now), F.lit(0.0)).alias("now_median"), F.coalesce(F.greatest(F.max(now), F.lit(0.0)), F.lit(0.0)).alias("now_peak"))
    return _moved(stats.where("was_median is not null"))


def compared(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each dense series' recent part against its baseline: means, medians, peak, 90th percentile, change and robust z.

    ``series`` has a value for every snapshot. Without baseline deviation z is 99 for a rise and 0 otherwise.
    """
    parts = split_windows(series.select(*keys, "snap_id").distinct(), keys)
    return _compared(series.join(parts, [*keys, "snap_id"]), keys)


def verdict(target: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether the target itself (one name per key) is degraded."""
    tail = (F.col("percent") >= TARGET_CHANGE) & (F.col("now_peak") > F.col("was_p90") * TAIL)
    shift = (F.col("percent") >= STRONG_CHANGE) & (F.col("rise") > 0)
    robust = (F.col("z") >= TARGET_Z) & (F.col("percent") >= TARGET_CHANGE)
    return compared(target, keys).withColumn("degraded", robust | shift | tail)


def _sparse(facts: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What ``compared`` tells of the series made dense with zeros over the target's snapshots, with correlation and greatest size, from the rows
    that are there: zeros are added to a name's sorted values, which are as many as there are snapshots, and to its moments."""
    parts = split_windows(target.select(*keys, "snap_id").distinct(), keys)
    at = parts.join(target.select(*keys, "snap_id", F.col("value").alias("t")), [*keys, "snap_id"])
    of_part = lambda p, x: F.when(F.col("part") == p, x)
    whole = at.groupBy(*keys).agg(F.count(of_part("baseline", 1)).alias("nb"), F.count(of_part("recent", 1)).alias("nr"), F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean_t"), F.var_pop("t").alias("var_t"))
    rows = facts.where("value is not null").join(at, [*keys, "snap_id"])
    value = F.col("value")
    own = rows.groupBy(*keys, "name").agg(F.collect_list(of_part("baseline", value)).alias("b"), F.collect_list(of_part("recent", value)).alias("r"), F.count(value).alias("n1"), F.avg(value).alias("m1"), F.var_pop(value).alias("v1"), F.avg("t").alias("t1"), F.covar_pop("value", "t").alias("c1"), F.max(F.abs(value)).alias("most"))
    filled = lambda c, n: F.sort_array(F.concat(c, F.array_repeat(F.lit(0.0), F.greatest(F.col(n) - F.size(c), F.lit(0)).cast("int")))).alias(c)
    mean = lambda c, n: F.when(F.col(n) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.col(n)).otherwise(0.0)
    # lambda variables hold what is used more than once, and the explosion keeps the optimiser from writing it out again
    values = F.transform(F.array(F.struct(filled("b", "nb"), filled("r", "nr"))), lambda s: F.struct(s["b"].alias("b"), s["r"].alias("r"), middle(s["b"]).alias("m")))
    told = F.transform(values, lambda s: F.struct(
        s["m"].alias("was_median"), mean(s["b"], "nb").alias("was_mean"), F.get(s["b"], F.round((F.col("nb") - 1) * 0.9).cast("int")).alias("was_p90"),
        middle(F.sort_array(F.transform(s["b"], lambda x: F.abs(x - s["m"])))).alias("mad"),
        mean(s["r"], "nr").alias("now_mean"), F.coalesce(middle(s["r"]), F.lit(0.0)).alias("now_median"), F.coalesce(F.greatest(F.array_max(s["r"]), F.lit(0.0)), F.lit(0.0)).alias("now_peak"),
    ))
    n, n1 = F.col("n"), F.col("n1")
    n0 = n - n1
    zero_t = F.when(n0 > 0, (F.col("mean_t") * n - F.col("t1") * n1) / F.nullif(n0, F.lit(0))).otherwise(0.0)
    covariance = (F.col("c1") * n1 + F.col("m1") * (F.col("t1") - zero_t) * n1 * n0 / n) / n
    spread = F.sqrt((F.col("v1") * n1 + F.col("m1") * F.col("m1") * n1 * n0 / n) / n) * F.sqrt("var_t")
    r = F.when((n >= 2) & (spread * n > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), covariance / F.nullif(spread, F.lit(0.0))))).otherwise(0.0)
    dense = own.where("most > 1e-9").join(whole, [*keys])
    return _moved(dense.select(*keys, "name", "most", r.alias("_r"), F.explode(told).alias("s")).select(*keys, "name", "most", F.col("_r").alias("r"), "s.*").where("was_median is not null"))


def findings(facts: DataFrame, target: DataFrame, domain: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names that got worse over the target's snapshots, in which a name that is absent counts as 0, with their correlation and share of the
    target's rise. ``facts`` has a row at most per key, snapshot and name."""
    stats = _sparse(facts, target, keys)
    whole = compared(target, keys).select(*keys, F.col("rise").alias("target_rise"))
    rows = stats.join(whole, [*keys]).where("rise > 0")
    percent = F.col("percent")
    worse = (F.col("z") >= NAME_Z) | (percent >= STRONG_CHANGE) | ((percent >= NAME_CHANGE) & (F.abs("r") >= NAME_R)) | ((percent >= NAME_CHANGE) & (F.col("now_peak") > F.col("was_p90") * TAIL))
    share = F.when(F.col("target_rise") > 1e-9, F.least(F.greatest(F.col("rise") / F.nullif("target_rise", F.lit(0.0)), F.lit(0.0)), F.lit(9.99))).otherwise(0.0)
    level = F.when((F.col("z") >= 6) & (percent >= 100) & (F.col("share") >= 0.25) & (F.col("r") >= 0.5), "critical").when((F.col("z") >= 3) & (percent >= 50) & ((F.col("share") >= 0.1) | (F.col("r") >= 0.4)), "high").when((F.col("z") >= 2.5) | (percent >= 25) | (F.col("r") >= 0.3), "medium").otherwise("low")
    return rows.where(worse).withColumn("share", share).withColumn("severity", level).withColumn("domain", F.lit(domain)).select(*keys, "domain", "name", "was_mean", "now_mean", "rise", "percent", "z", "r", "share", "severity")


def top_findings(found: DataFrame, top: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """The ``top`` findings of each domain by share, then z."""
    rank = F.row_number().over(of(keys, "domain").orderBy(F.col("share").desc(), F.col("z").desc(), "name"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def by_domain(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Findings and their total rise by domain."""
    return found.groupBy(*keys, "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("rise", F.lit(0.0))).alias("rise"))
