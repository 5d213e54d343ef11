"""Summary tables of events, statements, segments, latches, IO functions and tracked statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmill.functions.stats import pearson
from snapmill.operators.series import KEYS, densify, of


def marked_share(series: DataFrame, snaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per name in how many, and what share, of its key's snapshots it is present."""
    every = snaps.select(*keys, "snap_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("snaps"))
    present = series.groupBy(*keys, "name").agg(F.count_distinct("snap_id").alias("n"))
    return present.join(every, [*keys]).withColumn("share", F.col("n") / F.col("snaps") * 100).drop("snaps")


def events(waits: DataFrame, target: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per event means and deviations over the snapshots that have it, and its correlation with the target over all snapshots, absent
    ones as 0. Mean wait per execution is a ratio of means, its deviation a ratio of deviations."""
    own = waits.groupBy(*keys, "name").agg(F.avg("value").alias("mean_s"), F.stddev_pop("value").alias("spread_s"), F.avg("waits").alias("mean_n"), F.stddev_pop("waits").alias("spread_n"), F.avg("pct").alias("mean_pct"), F.stddev_pop("pct").alias("spread_pct"), F.count(F.lit(1)).alias("n"))
    dense = densify(waits, 0.0, keys, snaps=target).join(target.select(*keys, "snap_id", F.col("value").alias("target")), [*keys, "snap_id"])
    r = dense.groupBy(*keys, "name").agg(pearson("value", "target").alias("r"))
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0.0)) * 1000, F.lit(0.0))
    return own.join(r, [*keys, "name"]).withColumn("mean_ms", per("mean_s", "mean_n")).withColumn("spread_ms", per("spread_s", "spread_n"))


def activity(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Active-session shares by statement and event (``sql_id, event_name, pct_activity``)."""
    return rows.groupBy(*keys, "sql_id", "event_name").agg(F.avg("pct_activity").alias("mean"), F.stddev_pop("pct_activity").alias("spread"), F.count(F.lit(1)).alias("n"))


def io_functions(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and deviation of each value over all snapshots of the key, absent ones as 0; functions that did nothing are left out."""
    snaps = rows.select(*keys, "snap_id").distinct()
    grid = snaps.join(rows.select(*keys, "name").distinct(), [*keys]).join(rows, [*keys, "snap_id", "name"], "left")
    zero = lambda v: F.coalesce(F.col(v), F.lit(0.0))
    sums = [c for v in values for c in (F.avg(zero(v)).alias(f"mean_{v}"), F.stddev_pop(zero(v)).alias(f"spread_{v}"))]
    return grid.groupBy(*keys, "name").agg(*sums).where(reduce(lambda a, b: a | b, (F.col(f"mean_{v}") != 0 for v in values)))


def latches(rows: DataFrame, snaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Misses and waits of latches weighed by their gets (``name, gets, miss, wait``), and in what share of snapshots they are."""
    used = rows.where("gets > 0").groupBy(*keys, "name").agg((F.sum(F.col("gets") * F.col("miss")) / F.sum("gets")).alias("miss"), (F.sum(F.col("gets") * F.col("wait")) / F.sum("gets")).alias("wait"), F.avg("gets").alias("gets"))
    return used.where("miss > 0").join(marked_share(rows, snaps, keys).select(*keys, "name", "share"), [*keys, "name"])


def segments(rows: DataFrame, snaps: DataFrame, top: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per category the ``top`` segments (``category, name, value``) by the share of snapshots they are in."""
    every = snaps.select(*keys, "snap_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("snaps"))
    own = rows.groupBy(*keys, "category", "name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.count(F.lit(1)).alias("n")).join(every, [*keys])
    ranked = own.withColumn("share", F.col("n") / F.col("snaps") * 100).withColumn("rank", F.row_number().over(of(keys, "category").orderBy(F.col("n").desc(), "name")))
    return ranked.where(F.col("rank") <= top).drop("snaps")


def elsewhere(names: DataFrame, sections: dict[str, DataFrame], snaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per name the share of snapshots in which each other section has it."""
    every = snaps.select(*keys, "snap_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("snaps"))
    out = names.select(*keys, "name").distinct().join(every, [*keys])
    for label, rows in sections.items():
        n = rows.groupBy(*keys, "name").agg(F.count_distinct("snap_id").alias("_n"))
        out = out.join(n, [*keys, "name"], "left").withColumn(f"in_{label}", F.coalesce(F.col("_n") / F.col("snaps") * 100, F.lit(0.0))).drop("_n")
    return out.drop("snaps")


def tracked(series: DataFrame, specs: Sequence[tuple[str, str, str, float]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Chosen statistics under own names and scales: ``(label, how, pattern, factor)``, how being ``is`` or ``starts``.

    Of several names that a pattern matches in a snapshot the first holds.
    """
    rule: Column | None = None
    for label, how, pattern, factor in specs:
        hit = F.col("name") == pattern if how == "is" else F.col("name").startswith(pattern)
        item = F.when(hit, F.struct(F.lit(label).alias("label"), F.lit(float(factor)).alias("factor")))
        rule = F.array(item) if rule is None else F.concat(rule, F.array(item))
    rows = series.select(*keys, "snap_id", "name", "value", F.explode(F.array_compact(rule)).alias("t"))
    return rows.groupBy(*keys, "snap_id", F.col("t.label").alias("label")).agg(F.min_by(F.col("value") * F.col("t.factor"), "name").alias("value"))


def cpu_changes(hosts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys whose number of processors changed."""
    return hosts.groupBy(*keys).agg(F.count_distinct("cpus").alias("values"), F.min("cpus").alias("least"), F.max("cpus").alias("most")).where(F.col("values") > 1)


def rank_ids(rows: DataFrame, top: int = 10) -> DataFrame:
    """Statement ids (``sql_id, elapsed, place``) by how often they are listed, then elapsed time, then who came first."""
    ranked = rows.groupBy("sql_id").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed").alias("elapsed"), F.min("place").alias("first_seen"))
    return ranked.orderBy(F.col("n").desc(), F.col("elapsed").desc(), "first_seen", "sql_id").limit(top)


def merged_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids of two lists (``id, place``), those of the first before those of the second, each once."""
    both = first.select("id", F.struct(F.lit(0).alias("list"), "place").alias("o")).unionByName(second.select("id", F.struct(F.lit(1).alias("list"), "place").alias("o")))
    return both.groupBy("id").agg(F.min("o").alias("o")).orderBy("o").select("id")


def modules(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per statement the module that its first snapshot names (``sql_id, module, snap_id``)."""
    return rows.where("module is not null").groupBy(*keys, "sql_id").agg(F.min_by("module", F.struct("snap_id", "module")).alias("module"))


def precedence(weak: DataFrame, strong: DataFrame, key: str) -> DataFrame:
    """Rows of either table by ``key``; where both have it, those of the stronger."""
    return strong.unionByName(weak.join(strong.select(key).distinct(), key, "left_anti"))


def box(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per name the numbers of a box chart: count, mean, deviation, quartiles, ends, and the last values within 1.5 quartile ranges."""
    q = series.groupBy(*keys, "name").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.var_pop("value").alias("variance"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    wide = series.join(q, [*keys, "name"])
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = lambda c: F.when(c, F.col("value"))
    out = wide.groupBy(*keys, "name", "n", "least", "mean", "most", "variance", "q").agg(F.min(inside(F.col("value") >= F.col("q")[0] - reach)).alias("lower"), F.max(inside(F.col("value") <= F.col("q")[2] + reach)).alias("upper"))
    return out.select(*keys, "name", "n", "least", "lower", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "upper", "most", "mean", "variance", F.sqrt("variance").alias("spread"))


def buckets(series: DataFrame, bins: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per name a histogram of its values in bins of one width."""
    ends = series.groupBy(*keys, "name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    return series.join(ends, [*keys, "name"]).withColumn("bin", bin_).groupBy(*keys, "name", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
