"""Queries of the metric operators over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmill.functions import stats as fs
from snapmill.operators import anomalies, correlation, degradation, gradient, series, topk
from snapmill.operators import domains as domain_rows
from snapmill.plans import views
from snapmill.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = "db_id, instance_num"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Series

_DENSE = """SELECT g.*, round(coalesce(f.value, {fill}), 6) AS value FROM
(SELECT s.*, n.name FROM (SELECT DISTINCT db_id, instance_num, snap_id FROM {t}) s JOIN (SELECT DISTINCT db_id, instance_num, name FROM {t}) n USING (db_id, instance_num)) g
LEFT JOIN {t} f USING (db_id, instance_num, snap_id, name)"""


@query(with_views("waits", _DENSE.format(t="waits", fill="0.0")))
def densify_zero(spark, d):
    return r6(series.densify(views.waits(spark, d), 0.0), "value")


@query(with_views("days", _DENSE.format(t="days", fill="-1.0")))
def densify_neg1(spark, d):
    return r6(series.densify(views.days(spark, d), -1.0), "value")


_DELTA = f"delta AS (SELECT * FROM (SELECT {K}, snap_id, name, value - lag(value) OVER (PARTITION BY {K}, name ORDER BY snap_id) AS delta FROM stats) WHERE delta IS NOT NULL)"


@query(with_views("stats", f"SELECT {K}, snap_id, name, round(delta, 6) AS delta FROM delta", _DELTA))
def series_delta(spark, d):
    return r6(series.delta(views.stats(spark, d)), "delta")


@query(with_views("stats", f"SELECT {K}, snap_id, name, round(delta, 6) AS delta, round((delta - avg(delta) OVER w) / CASE WHEN stddev_samp(delta) OVER w > 0 THEN stddev_samp(delta) OVER w ELSE 1e-12 END, 6) AS z FROM delta WINDOW w AS (PARTITION BY {K}, name)", _DELTA))
def standardized_delta(spark, d):
    return r6(series.standardized(series.delta(views.stats(spark, d))), "delta", "z")


@query(with_views("snaps", f"SELECT * FROM (SELECT {K}, snap_id AS begin_id, lead(snap_id) OVER (PARTITION BY {K} ORDER BY snap_id) AS end_id FROM snaps) WHERE end_id IS NOT NULL"))
def snapshot_pairs_lead(spark, d):
    return series.pairs(views.snaps(spark, d))


@query(with_views("snaps", f"SELECT * FROM (SELECT {K}, snap_id AS begin_id, lead(snap_id) OVER w AS end_id, (epoch(lead(CAST(ends AS TIMESTAMP)) OVER w) - epoch(CAST(ends AS TIMESTAMP))) / 60 AS minutes FROM snaps WINDOW w AS (PARTITION BY {K} ORDER BY snap_id)) WHERE end_id IS NOT NULL AND minutes >= 30"))
def snapshot_pairs_min_interval(spark, d):
    timed = views.snaps(spark, d).withColumn("at", F.col("ends").cast("timestamp"))
    return series.pairs(timed, least_minutes=30, at="at")


@query(with_views("stats", f"SELECT {K}, snap_id, name, round(value, 6) AS value, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) ELSE 0 END, 6) AS z FROM stats WINDOW w AS (PARTITION BY {K}, name)"))
def zscore(spark, d):
    return r6(series.zscore(views.stats(spark, d)), "value", "z")


@query(with_views("stats", f"SELECT {K}, snap_id, name, round(value, 6) AS value, round(CASE WHEN mad > 0 THEN (value - m) / nullif(1.4826 * mad, 0) ELSE 0 END, 6) AS z FROM stats JOIN c USING ({K}, name) JOIN e USING ({K}, name)", f"c AS (SELECT {K}, name, list_sort(list(value))[CAST(count(*) // 2 AS BIGINT) + 1] AS m FROM stats GROUP BY ALL), e AS (SELECT {K}, name, list_sort(list(abs(value - m)))[CAST(count(*) // 2 AS BIGINT) + 1] AS mad FROM stats JOIN c USING ({K}, name) GROUP BY ALL)"))
def robust_z(spark, d):
    return r6(series.robust_z(views.stats(spark, d)), "value", "z")


_MINMAX = f"SELECT {K}, snap_id, name, round(value, 6) AS value, round(CASE WHEN hi > lo THEN greatest(0, least(100, (x - lo) / nullif(hi - lo, 0) * 100)) ELSE 0 END, 6) AS scaled FROM (SELECT *, {{x}} AS x FROM stats) JOIN (SELECT {K}, name, quantile_cont({{x}}, 0.05) AS lo, quantile_cont({{x}}, 0.95) AS hi FROM stats GROUP BY ALL) USING ({K}, name)"


@query(with_views("stats", _MINMAX.format(x="value")))
def robust_minmax(spark, d):
    return r6(series.robust_minmax(views.stats(spark, d)), "value", "scaled")


@query(with_views("stats", _MINMAX.format(x="ln(1 + greatest(value, 0))")))
def log1p_minmax(spark, d):
    return r6(series.robust_minmax(views.stats(spark, d), log=True), "value", "scaled")


@query(with_views("snaps", f"SELECT {K}, snap_id, end_id, ends FROM snaps WHERE snap_id >= 20000 AND end_id <= 40000"))
def snap_range(spark, d):
    return series.in_range(views.snaps(spark, d), 20000, 40000, "snap_id", "end_id")


# Aggregates


def by_name(df: DataFrame, **columns) -> DataFrame:
    return df.groupBy("db_id", "instance_num", "name").agg(*(c.alias(n) for n, c in columns.items()))


def _stat(columns: str) -> str:
    return with_views("stats", f"SELECT {K}, name, {columns} FROM stats GROUP BY ALL")


@query(_stat("round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread, count(*) AS n"))
def mean_std_pop(spark, d):
    return by_name(views.stats(spark, d), mean=F.round(fs.mean0("value"), 6), spread=F.round(F.stddev_pop("value"), 6), n=F.count(F.lit(1)))


@query(_stat("round(median(value), 6) AS median"))
def median_by_name(spark, d):
    return by_name(views.stats(spark, d), median=F.round(F.median("value"), 6))


@query(_stat("round(mad(value), 6) AS mad"))
def mad_by_name(spark, d):
    df = views.stats(spark, d)
    off = df.join(by_name(df, m=F.median("value")), ["db_id", "instance_num", "name"])
    return by_name(off, mad=F.round(F.median(F.abs(F.col("value") - F.col("m"))), 6))


@query(_stat("round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.25), 6) AS p25"))
def pct_linear(spark, d):
    return by_name(views.stats(spark, d), p90=F.round(fs.linear("value", 0.9), 6), p25=F.round(fs.linear("value", 0.25), 6))


@query(_stat("round(quantile_cont(abs(value), 0.9), 6) AS p90, round(quantile_cont(abs(value), 0.99), 6) AS p99"))
def abs_pct_p90_p99(spark, d):
    return by_name(views.stats(spark, d), p90=F.round(fs.abs_linear("value", 0.9), 6), p99=F.round(fs.abs_linear("value", 0.99), 6))


@query(_stat("round(list_sort(list(value))[CAST(round((count(*) - 1) * 0.9) AS BIGINT) + 1], 6) AS p90"))
def pct_nearest(spark, d):
    return by_name(views.stats(spark, d), p90=F.round(fs.nearest("value", 0.9), 6))


@query(_stat("round(list_sort(list(value))[CAST(ceil(count(*) * 0.95) AS BIGINT)], 6) AS p95"))
def pct_ceil_p95(spark, d):
    return by_name(views.stats(spark, d), p95=F.round(fs.ceiling("value", 0.95), 6))


@query(with_views("waits", f"SELECT {K}, name, count(*) AS n, CAST(count_if(pct >= 5) AS BIGINT) AS n5, CAST(count_if(pct >= 20) AS BIGINT) AS n20, round(count_if(pct >= 5) / count(*) * 100, 6) AS share5 FROM waits WHERE pct IS NOT NULL GROUP BY ALL"))
def threshold_counts(spark, d):
    n = F.count(F.lit(1))
    return by_name(views.waits(spark, d).where("pct is not null"), n=n, n5=F.count_if(F.col("pct") >= 5), n20=F.count_if(F.col("pct") >= 20), share5=F.round(F.count_if(F.col("pct") >= 5) / n * 100, 6))


@query(with_views("stats", f"SELECT {K}, name, n, round(least_, 6) AS least, round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) AS lower_fence, round(q1, 6) AS q1, round(mean + 1e-7, 5) AS mean, round(q2, 6) AS q2, round(q3, 6) AS q3, round(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) AS upper_fence, round(most, 6) AS most, round(sqrt(var), 4) AS spread FROM stats JOIN q USING ({K}, name) GROUP BY {K}, name, n, least_, q1, mean, q2, q3, most, var", f"q AS (SELECT {K}, name, count(*) AS n, min(value) AS least_, quantile_cont(value, 0.25) AS q1, avg(value) AS mean, median(value) AS q2, quantile_cont(value, 0.75) AS q3, max(value) AS most, var_pop(value) AS var FROM stats GROUP BY ALL)"))
def five_number_fences(spark, d):
    df = views.stats(spark, d)
    q = by_name(df, n=F.count(F.lit(1)), least=F.min("value"), q=F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), mean=F.avg("value"), most=F.max("value"), variance=F.var_pop("value"))
    wide = df.join(q, ["db_id", "instance_num", "name"]).withColumns({"q1": F.col("q")[0], "q2": F.col("q")[1], "q3": F.col("q")[2]})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = wide.groupBy("db_id", "instance_num", "name", "n", "least", "q1", "mean", "q2", "q3", "most", "variance").agg(F.min(F.when(F.col("value") >= F.col("q1") - reach, F.col("value"))).alias("lower_fence"), F.max(F.when(F.col("value") <= F.col("q3") + reach, F.col("value"))).alias("upper_fence"))
    return r6(fences, "least", "q1", "q2", "q3", "most", "lower_fence", "upper_fence").withColumns({"spread": F.round(F.sqrt("variance"), 4), "mean": F.round(F.col("mean") + 1e-7, 5)}).drop("variance")


# Anomalies


def _mad(view: str, threshold: float, top: int) -> str:
    return f"""m AS (SELECT {K}, name, median(value) AS m, mad(value) AS mad FROM {view} GROUP BY ALL),
found AS (SELECT *, row_number() OVER (PARTITION BY {K}, name ORDER BY score DESC, snap_id) AS rank FROM
  (SELECT {K}, snap_id, name, value, abs(value - m) / nullif(mad, 0) AS score FROM {view} JOIN m USING ({K}, name) WHERE mad > 0) WHERE score > {threshold} AND value >= 0 QUALIFY rank <= {top})"""


_FOUND = f"SELECT {K}, snap_id, name, round(value, 6) AS value, round(score, 6) AS score, rank FROM found"


def rounded(found: DataFrame) -> DataFrame:
    return r6(found, "value", "score").withColumn("rank", F.col("rank").cast("bigint"))


@query(with_views("days", _FOUND, "dense AS (" + _DENSE.format(t="days", fill="-1.0") + "),\n" + _mad("dense", 7, 10)))
def mad_global(spark, d):
    return rounded(anomalies.mad_global(r6(series.densify(views.days(spark, d), -1.0), "value")))


@query(with_views("stats", _FOUND, _mad("stats", 7, 3)))
def mad_topn(spark, d):
    return rounded(anomalies.mad_global(views.stats(spark, d), top=3))


_SLIDE = f"""i AS (SELECT *, row_number() OVER (PARTITION BY {K}, name ORDER BY snap_id) - 1 AS i, count(*) OVER (PARTITION BY {K}, name) AS n FROM stats),
m AS (SELECT a.{K.replace(', ', ', a.')}, a.snap_id, a.name, a.value, median(b.value) AS m, mad(b.value) AS mad FROM i a JOIN i b ON a.db_id = b.db_id AND a.instance_num = b.instance_num AND a.name = b.name
  AND b.i >= greatest(0, a.i - 10) AND b.i < least(greatest(0, a.i - 10) + 20, a.n) GROUP BY ALL),
found AS (SELECT *, row_number() OVER (PARTITION BY {K}, name ORDER BY score DESC, snap_id) AS rank FROM (SELECT *, abs(value - m) / nullif(mad, 0) AS score FROM m WHERE mad > 0) WHERE score > 7 AND value >= 0 QUALIFY rank <= 10)"""


@query(with_views("stats", _FOUND, _SLIDE))
def mad_sliding_w20(spark, d):
    return rounded(anomalies.mad_sliding(views.stats(spark, d), 20, 100))


def domains(spark, d) -> DataFrame:
    return domain_rows.found_anomalies(views.metrics(spark, d))


def _part(view: str) -> str:
    return _mad(view, 7, 10).replace("m AS (", f"m_{view} AS (", 1).replace("JOIN m USING", f"JOIN m_{view} USING").replace("found AS", f"found_{view} AS")


_ALL = ",\n".join(_part(v) for v in ("waits", "backs", "stats")) + f""",
every AS (SELECT {K}, snap_id, name, score, 'foreground' AS domain FROM found_waits UNION ALL SELECT {K}, snap_id, name, score, 'background' FROM found_backs UNION ALL SELECT {K}, snap_id, name, score, 'load_profile' FROM found_stats),
sized AS (SELECT {K}, snap_id, count(*) AS size, count(DISTINCT domain) AS domains, round(max(score), 6) AS most FROM every GROUP BY ALL)"""


@query(with_views("waits backs stats", f"SELECT {K}, snap_id, domain, name, round(score, 6) AS score FROM every", _ALL))
def anomaly_domains(spark, d):
    return r6(domains(spark, d), "score").select(*views.AT, "domain", "name", "score")


@query(with_views("waits backs stats", f"SELECT {K}, snap_id, domain, name, round(score, 6) AS score FROM every QUALIFY row_number() OVER (PARTITION BY {K}, snap_id, domain ORDER BY score DESC, name) <= 2", _ALL))
def category_trim(spark, d):
    return r6(anomalies.trim(domains(spark, d), 2), "score").select(*views.AT, "domain", "name", "score")


@query(with_views("waits backs stats", "SELECT * FROM sized", _ALL))
def anomaly_clusters(spark, d):
    return r6(anomalies.clusters(domains(spark, d)), "most")


@query(with_views("waits backs stats", f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY size DESC, snap_id) AS place FROM sized QUALIFY place <= 3", _ALL))
def cluster_top_n(spark, d):
    return r6(anomalies.top_clusters(anomalies.clusters(domains(spark, d)), 3), "most").withColumn("place", F.col("place").cast("bigint"))


@query(with_views("waits backs stats", f"SELECT {K}, snap_id, count(*) FILTER (domain = 'foreground') AS foreground, count(*) FILTER (domain = 'background') AS background, count(*) FILTER (domain = 'load_profile') AS load_profile FROM (SELECT DISTINCT {K}, snap_id FROM stats) LEFT JOIN every USING ({K}, snap_id) GROUP BY ALL", _ALL))
def anomaly_heatmap(spark, d):
    return anomalies.heatmap(domains(spark, d), views.stats(spark, d), ["foreground", "background", "load_profile"])


@query(with_views("stats", f"SELECT {K}, snap_id, count(*) AS n, list_aggregate(list_sort(list('load_profile ' || name)), 'string_agg', '; ') AS names FROM found GROUP BY ALL", _mad("stats", 7, 10)))
def anomaly_csv_summary(spark, d):
    found = anomalies.union_domains({"load_profile": anomalies.mad_global(views.stats(spark, d))})
    return found.groupBy(*views.AT).agg(F.count(F.lit(1)).alias("n"), F.concat_ws("; ", F.array_sort(F.collect_list(F.concat_ws(" ", "domain", "name")))).alias("names"))


@query(with_views("waits", f"SELECT {K}, f.snap_id, f.name, round(f.value, 6) AS value, round(f.score, 6) AS score, f.rank, w.waits, w.pct FROM found f JOIN waits w USING ({K}, snap_id, name)", _mad("waits", 7, 10)))
def anomaly_facts(spark, d):
    own = views.waits(spark, d)
    return rounded(domain_rows.with_facts(anomalies.mad_global(own.select(*views.AT, "name", "value")), own, ["waits", "pct"]))


@query(with_views("stats", f"SELECT {K}, f.snap_id, f.name, round(f.value, 6) AS value, round(f.score, 6) AS score, f.rank, round(m.mean, 6) AS mean FROM found f JOIN (SELECT {K}, name, avg(value) AS mean FROM stats GROUP BY ALL) m USING ({K}, name)", _mad("stats", 7, 10)))
def load_profile_anomalies(spark, d):
    own = views.stats(spark, d)
    return r6(rounded(domain_rows.with_means(anomalies.mad_global(own), own)), "mean")


# Peaks and rankings

_PEAKS = f"SELECT {K}, snap_id, t.value AS dbtime, c.value AS dbcpu, c.value / t.value AS ratio FROM dbtime t JOIN dbcpu c USING ({K}, snap_id) WHERE t.value > 0 AND c.value > 0 AND c.value / t.value < 0.4"


def peaks(spark, d) -> DataFrame:
    return topk.peaks(views.named(spark, d, "DB Time(s)"), views.named(spark, d, "DB CPU(s)"), 0.4)


@query(with_views("stats dbtime dbcpu", f"SELECT {K}, snap_id, round(dbtime, 6) AS dbtime, round(dbcpu, 6) AS dbcpu, round(ratio, 6) AS ratio FROM ({_PEAKS})"))
def peak_snapshots(spark, d):
    return r6(peaks(spark, d), "dbtime", "dbcpu", "ratio")


@query(with_views("stats dbtime dbcpu waits", f"SELECT {K}, snap_id, name, value, row_number() OVER w AS rank FROM waits SEMI JOIN ({_PEAKS}) p USING ({K}, snap_id) WINDOW w AS (PARTITION BY {K}, snap_id ORDER BY floor(value) DESC, name) QUALIFY row_number() OVER w <= 10 AND count(*) OVER (PARTITION BY {K}, snap_id) > 10"))
def top10_events_per_peak(spark, d):
    at_peaks = views.waits(spark, d).select(*views.AT, "name", "value").join(peaks(spark, d).select(*views.AT), views.AT, "left_semi")
    return topk.top_per_snapshot(at_peaks, 10, only_if_more=10, whole=True).withColumn("rank", F.col("rank").cast("bigint"))


@query(with_views("waits", f"SELECT {K}, snap_id, name, value, row_number() OVER w AS rank FROM waits WINDOW w AS (PARTITION BY {K}, snap_id ORDER BY value DESC, name) QUALIFY row_number() OVER w <= 5 AND count(*) OVER (PARTITION BY {K}, snap_id) > 1"))
def top5_entities(spark, d):
    return topk.top_per_snapshot(views.waits(spark, d).select(*views.AT, "name", "value"), 5, only_if_more=1).withColumn("rank", F.col("rank").cast("bigint"))


@query(with_views("stats dbtime", f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY value DESC, snap_id) AS rank FROM dbtime QUALIFY rank <= 10"))
def busiest_snapshots(spark, d):
    return topk.busiest(views.named(spark, d, "DB Time(s)"), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query(with_views("waits", f"SELECT {K}, snap_id, name, pct AS value FROM waits WHERE pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {K}, snap_id ORDER BY pct DESC, name DESC) = 1"))
def argmax_event(spark, d):
    return topk.leader(views.waits(spark, d), "pct")


@query(with_views("waits", f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY total DESC, name) AS rank FROM (SELECT {K}, name, CAST(sum(floor(value)) AS BIGINT) AS total FROM waits GROUP BY ALL)"))
def rank_by_total(spark, d):
    return topk.rank_by_total(views.waits(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query(with_views("days", f"SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY present DESC, name) AS rank FROM (SELECT {K}, name, CAST(count_if(value > 0) AS BIGINT) AS present FROM days GROUP BY ALL)"))
def rank_by_presence(spark, d):
    return topk.rank_by_presence(views.days(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query(with_views("stats dbtime dbcpu waits", f"SELECT DISTINCT {K}, name FROM found UNION SELECT DISTINCT {K}, name FROM (SELECT {K}, name FROM waits SEMI JOIN ({_PEAKS}) p USING ({K}, snap_id) QUALIFY row_number() OVER (PARTITION BY {K}, snap_id ORDER BY floor(value) DESC, name) <= 10 AND count(*) OVER (PARTITION BY {K}, snap_id) > 10)", _mad("waits", 7, 10)))
def top_union(spark, d):
    own = views.waits(spark, d).select(*views.AT, "name", "value")
    at_peaks = own.join(peaks(spark, d).select(*views.AT), views.AT, "left_semi")
    return topk.selected(anomalies.mad_global(own), topk.top_per_snapshot(at_peaks, 10, only_if_more=10, whole=True))


# Correlation

_R = "coalesce(CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END, 0)"
_TO = f"c AS (SELECT {K}, s.name, {_R.format(x='s.value', y='t.value')} AS r, sum(s.value) AS total, avg(s.value) AS mean, stddev_samp(s.value) AS spread, count(*) AS n FROM {{t}} s JOIN dbtime t USING ({K}, snap_id) GROUP BY ALL)"


def to_dbtime(spark, d, df: DataFrame) -> DataFrame:
    return correlation.to_target(df, views.named(spark, d, "DB Time(s)"))


@query(with_views("stats dbtime", f"SELECT {K}, name, round(r, 6) AS r, n FROM c", _TO.format(t="stats")))
def pearson_dbtime(spark, d):
    return r6(to_dbtime(spark, d, views.stats(spark, d)), "r").select("db_id", "instance_num", "name", "r", "n")


@query(with_views("stats dbtime waits", f"SELECT {K}, name, round(r, 6) AS r, round(total, 4) AS total, round(mean, 6) AS mean, round(spread, 6) AS spread, n FROM c WHERE r >= 0.2", _TO.format(t="waits")))
def corr_sql_having(spark, d):
    found = to_dbtime(spark, d, views.waits(spark, d)).where("r >= 0.2")
    return r6(found, "r", "mean", "spread").withColumn("total", F.round("total", 4))


_QUANTILE = "t - ({top}) / ({bottom})".format(top=" + ".join(f"{c} * t ** {i}" for i, c in enumerate(fs.QUANTILE_TOP)), bottom=" + ".join(f"{c} * t ** {i}" for i, c in enumerate(fs.QUANTILE_BOTTOM)))


@query(with_views("stats dbtime waits", f"""SELECT {K}, name, round(r, 6) AS r FROM (SELECT *, {_QUANTILE} AS z FROM (SELECT *, sqrt(-2 * ln(0.05 / (2 * count(*) OVER (PARTITION BY {K})))) AS t FROM c JOIN (SELECT {K}, count(DISTINCT snap_id) AS pairs FROM dbtime GROUP BY ALL) USING ({K})))
WHERE abs(r) >= greatest(0.5, CASE WHEN pairs >= 4 THEN z / sqrt(z * z + pairs - 2) ELSE 0.5 END)""", _TO.format(t="waits")))
def bonferroni_filter(spark, d):
    target = views.named(spark, d, "DB Time(s)")
    return r6(correlation.significant(correlation.to_target(views.waits(spark, d), target), target), "r").select("db_id", "instance_num", "name", "r")


@query(with_views("stats waits", f"SELECT {K}, w.name AS left_name, s.name AS right_name, round({_R.format(x='w.value', y='s.value')}, 6) AS r FROM waits w JOIN stats s USING ({K}, snap_id) GROUP BY ALL HAVING abs({_R.format(x='w.value', y='s.value')}) >= 0.333"))
def pearson_pairs_strong(spark, d):
    return r6(correlation.strong_pairs(views.waits(spark, d), views.stats(spark, d)), "r")


@query(with_views("stats dbtime", f"SELECT DISTINCT {K}, name, round(r, 6) AS r FROM (SELECT {K}, s.name, covar_pop(s.value, t.value) OVER w / nullif(stddev_pop(s.value) OVER w * stddev_pop(t.value) OVER w, 0) AS r FROM stats s JOIN dbtime t USING ({K}, snap_id) WINDOW w AS (PARTITION BY {K}, s.name)) WHERE r >= 0.45"))
def corr_over_partition(spark, d):
    return correlation.over_partition(views.stats(spark, d), views.named(spark, d, "DB Time(s)"), 0.45)


@query(with_views("stats", f"SELECT {K}, round(avg(ratio), 6) AS mean, round(stddev_pop(ratio), 6) AS spread, count(ratio) AS n FROM (SELECT {K}, CASE WHEN b <> 0 THEN a / nullif(b, 0) ELSE 0 END AS ratio FROM (SELECT {K}, snap_id, sum(value) FILTER (name = 'User calls') AS a, sum(value) FILTER (name IN ('Executes (SQL)', 'Hard parses (SQL)')) AS b FROM stats WHERE name IN ('User calls', 'Executes (SQL)', 'Hard parses (SQL)') GROUP BY ALL)) GROUP BY ALL"))
def commit_ratio(spark, d):
    return r6(correlation.ratio_stats(views.stats(spark, d), "User calls", ["Executes (SQL)", "Hard parses (SQL)"]), "mean", "spread")


@query(with_views("stats dbtime", f"SELECT {K}, snap_id, name, value, count(value) OVER w AS n, round(avg(value) OVER w, 6) AS mean, round(stddev_samp(value) OVER w, 6) AS spread, max(value) OVER w AS most, min(value) OVER w AS least FROM dbtime WINDOW w AS (PARTITION BY {K}, name)"))
def partition_stats(spark, d):
    return r6(correlation.partition_stats(views.named(spark, d, "DB Time(s)")), "mean", "spread")


@query(with_views("stats", f"SELECT {K}, count(DISTINCT snap_id) AS snaps, count(DISTINCT name) AS names FROM stats GROUP BY ALL"))
def distinct_counts(spark, d):
    return views.stats(spark, d).groupBy("db_id", "instance_num").agg(F.count_distinct("snap_id").alias("snaps"), F.count_distinct("name").alias("names"))


# Degradation

_SPLIT = f"""split AS (SELECT {K}, snap_id, CASE WHEN i > n - CASE WHEN n - r < 3 THEN greatest(n - 3, 0) ELSE r END THEN 'recent' ELSE 'baseline' END AS part FROM (SELECT *, least(greatest(CAST(ceil(n * 0.25) AS BIGINT), 2), 48) AS r FROM (SELECT {K}, snap_id, row_number() OVER (PARTITION BY {K} ORDER BY snap_id) AS i, count(*) OVER (PARTITION BY {K}) AS n FROM (SELECT DISTINCT {K}, snap_id FROM {{t}}))))"""
_CMP = f"""{{p}}rows AS (SELECT * FROM {{t}} JOIN {{s}} USING ({K}, snap_id)),
{{p}}cmp AS (SELECT *, CASE WHEN abs(was_mean) < 1e-9 THEN CASE WHEN rise > 0 THEN 100 ELSE 0 END ELSE rise / nullif(abs(was_mean), 0) * 100 END AS percent, CASE WHEN mad <= 1e-9 THEN CASE WHEN rise > 0 THEN 99 ELSE 0 END ELSE (now_median - was_median) / nullif(1.4826 * mad, 0) END AS z FROM
 (SELECT {K}, name, median(value) FILTER (part = 'baseline') AS was_median, coalesce(avg(value) FILTER (part = 'baseline'), 0) AS was_mean, mad(value) FILTER (part = 'baseline') AS mad,
  list_sort(list(value) FILTER (part = 'baseline'))[CAST(round((count(*) FILTER (part = 'baseline') - 1) * 0.9) AS BIGINT) + 1] AS was_p90,
  coalesce(avg(value) FILTER (part = 'recent'), 0) AS now_mean, coalesce(median(value) FILTER (part = 'recent'), 0) AS now_median, greatest(coalesce(max(value) FILTER (part = 'recent'), 0), 0) AS now_peak,
  coalesce(avg(value) FILTER (part = 'recent'), 0) - coalesce(avg(value) FILTER (part = 'baseline'), 0) AS rise FROM {{p}}rows GROUP BY ALL) WHERE was_median IS NOT NULL)"""
_NUMBERS = "round(was_mean, 6) AS was_mean, round(now_mean, 6) AS now_mean, round(rise, 6) AS rise, round(percent, 6) AS percent, round(z, 6) AS z"


@query(with_views("stats", "SELECT * FROM split", _SPLIT.format(t="stats")))
def window_split(spark, d):
    return series.split_windows(views.stats(spark, d).select(*views.AT).distinct())


@query(with_views("stats", f"SELECT {K}, name, {_NUMBERS} FROM cmp", _SPLIT.format(t="stats") + ",\n" + _CMP.format(p="", t="stats", s="split")))
def window_compare(spark, d):
    found = degradation.compared(views.stats(spark, d))
    return r6(found, "was_mean", "now_mean", "rise", "percent", "z").select("db_id", "instance_num", "name", "was_mean", "now_mean", "rise", "percent", "z")


@query(with_views("stats dbtime", f"SELECT {K}, name, {_NUMBERS}, (z >= 3 AND percent >= 25) OR (percent >= 100 AND rise > 0) OR (percent >= 25 AND now_peak > was_p90 * 1.25) AS degraded FROM cmp", _SPLIT.format(t="dbtime") + ",\n" + _CMP.format(p="", t="dbtime", s="split")))
def dbtime_verdict(spark, d):
    found = degradation.verdict(views.named(spark, d, "DB Time(s)"))
    return r6(found, "was_mean", "now_mean", "rise", "percent", "z").select("db_id", "instance_num", "name", "was_mean", "now_mean", "rise", "percent", "z", "degraded")


_SAFE = "CASE WHEN count(*) >= 2 AND stddev_pop(value) * stddev_pop(target) * count(*) > 1e-12 THEN greatest(-1, least(1, covar_pop(value, target) / nullif(stddev_pop(value) * stddev_pop(target), 0))) ELSE 0 END"
_FINDINGS = f"""named AS (SELECT {K}, snap_id, 'foreground ' || name AS name, value FROM waits UNION ALL SELECT {K}, snap_id, 'background ' || name, value FROM backs UNION ALL SELECT {K}, snap_id, 'load_profile ' || name, value FROM stats),
dense AS (SELECT g.*, coalesce(f.value, 0.0) AS value FROM (SELECT s.*, n.name FROM (SELECT DISTINCT {K}, snap_id FROM dbtime) s JOIN (SELECT DISTINCT {K}, name FROM named) n USING ({K})) g LEFT JOIN named f USING ({K}, snap_id, name)),
{_SPLIT.format(t="dense")}, {_CMP.format(p="", t="dense", s="split")}, {_SPLIT.format(t="dbtime").replace("split AS", "tsplit AS")}, {_CMP.format(p="t", t="dbtime", s="tsplit")},
corr_ AS (SELECT {K}, w.name, {_SAFE.replace('(value', '(w.value').replace('target', 't.value')} AS r, max(abs(w.value)) AS top FROM dense w JOIN dbtime t USING ({K}, snap_id) GROUP BY ALL),
findings AS (SELECT {K}, string_split(c.name, ' ')[1] AS domain, substr(c.name, length(string_split(c.name, ' ')[1]) + 2) AS name, c.was_mean, c.now_mean, c.rise, c.percent, c.z, k.r, CASE WHEN t.rise > 1e-9 THEN least(greatest(c.rise / nullif(t.rise, 0), 0), 9.99) ELSE 0 END AS share
 FROM cmp c JOIN corr_ k USING ({K}, name) JOIN (SELECT {K}, rise FROM tcmp) t USING ({K})
 WHERE k.top > 1e-9 AND c.rise > 0 AND (c.z >= 2.5 OR c.percent >= 100 OR (c.percent >= 20 AND abs(k.r) >= 0.3) OR (c.percent >= 20 AND c.now_peak > c.was_p90 * 1.25)))"""


def findings(spark, d) -> DataFrame:
    """Of all domains that the tables hold; SQL statements, instance statistics and the time model are in none of them."""
    return domain_rows.degraded(views.metrics(spark, d))


@query(with_views("stats dbtime waits backs", f"SELECT {K}, domain, name, {_NUMBERS}, round(r, 6) AS r, round(share, 6) AS share, row_number() OVER (PARTITION BY {K}, domain ORDER BY share DESC, z DESC, name) AS rank FROM findings QUALIFY rank <= 10", _FINDINGS))
def degraded_findings(spark, d):
    found = degradation.top_findings(findings(spark, d)).drop("severity").withColumn("rank", F.col("rank").cast("bigint"))
    return r6(found, "was_mean", "now_mean", "rise", "percent", "z", "r", "share")


@query(with_views("stats dbtime waits backs", f"SELECT {K}, domain, count(*) AS n, round(sum(greatest(rise, 0)), 6) AS rise FROM findings GROUP BY ALL", _FINDINGS))
def degraded_domains(spark, d):
    return r6(degradation.by_domain(findings(spark, d)), "rise")


# Gradients

_MOVED = f"""wide AS (SELECT g.*, coalesce(f.value, 0.0) AS value FROM (SELECT s.*, n.name FROM (SELECT DISTINCT {K}, snap_id FROM dbtime) s JOIN (SELECT DISTINCT {K}, name FROM stats WHERE name <> 'DB Time(s)') n USING ({K})) g LEFT JOIN stats f USING ({K}, snap_id, name)),
moved0 AS (SELECT * FROM (SELECT {K}, snap_id, name, value - lag(value) OVER (PARTITION BY {K}, name ORDER BY snap_id) AS delta FROM wide) WHERE delta IS NOT NULL),
goal AS (SELECT {K}, snap_id, delta - avg(delta) OVER (PARTITION BY {K}) AS target FROM (SELECT {K}, snap_id, value - lag(value) OVER (PARTITION BY {K} ORDER BY snap_id) AS delta FROM dbtime) WHERE delta IS NOT NULL),
moved AS (SELECT *, (delta - avg(delta) OVER w) / CASE WHEN stddev_samp(delta) OVER w > 0 THEN stddev_samp(delta) OVER w ELSE 1e-12 END AS z FROM moved0 JOIN goal USING ({K}, snap_id) WINDOW w AS (PARTITION BY {K}, name))"""


def moved(spark, d) -> DataFrame:
    return gradient.differences(views.stats(spark, d).where("name <> 'DB Time(s)'"), views.named(spark, d, "DB Time(s)"))


@query(with_views("stats dbtime", f"SELECT {K}, x.name AS a, y.name AS b, round(sum(x.z * y.z), 5) AS product FROM moved x JOIN moved y USING ({K}, snap_id) WHERE x.name <= y.name GROUP BY ALL", _MOVED))
def gram_matrix(spark, d):
    return gradient.gram(moved(spark, d)).withColumn("product", F.round("product", 5))


@query(with_views("stats dbtime", f"SELECT {K}, name, round(sum(z * target), 5) AS product FROM moved GROUP BY ALL", _MOVED))
def xty_vector(spark, d):
    return gradient.toward_target(moved(spark, d)).withColumn("product", F.round("product", 5))


_SCALES = f"scales AS (SELECT {K}, name, mad(delta) AS mad, quantile_cont(abs(delta), 0.9) AS p90, quantile_cont(abs(delta), 0.99) AS p99 FROM moved GROUP BY ALL)"


@query(with_views("stats dbtime", f"SELECT {K}, name, round(mad, 6) AS mad, round(p90, 6) AS p90, round(p99, 6) AS p99 FROM scales", f"{_MOVED}, {_SCALES}"))
def delta_scales(spark, d):
    return r6(gradient.scales(moved(spark, d)), "mad", "p90", "p99")


@query(with_views("stats dbtime", f"""SELECT {K}, 'fixed' AS model, name, coefficient, round(abs(coefficient) * mad, 6) AS impact, round(abs(coefficient) * p90, 6) AS active, round(abs(coefficient) * p99, 6) AS peak,
round(CASE WHEN coefficient > 0 THEN coalesce(coefficient * p90 / nullif(sum(CASE WHEN coefficient > 0 THEN coefficient * p90 END) OVER (PARTITION BY {K}), 0), 0) ELSE 0 END, 6) AS share, round(coefficient * p90, 6) AS signed,
row_number() OVER (PARTITION BY {K} ORDER BY coefficient * p90 DESC, name) AS rank FROM (SELECT *, (length(name) % 5 - 1) / 2.0 AS coefficient FROM scales)""", f"{_MOVED}, {_SCALES}"))
def impact_ranking(spark, d):
    own = gradient.scales(moved(spark, d))
    fixed = own.select("db_id", "instance_num", F.lit("fixed").alias("model"), "name", ((F.length("name") % 5 - 1) / 2.0).alias("coefficient"))
    return r6(gradient.impacts(fixed, own), "impact", "active", "peak", "share", "signed").withColumn("rank", F.col("rank").cast("bigint"))


@query(with_views("stats dbtime", f"""SELECT {K}, round((b2 * g11 - b1 * g12) / det, 6) AS beta_calls, round((b1 * g22 - b2 * g12) / det, 6) AS beta_cpu, round(CASE WHEN 1 - r * r <= 1e-6 THEN 1e6 ELSE 1 / (1 - r * r) END, 4) AS vif FROM (
SELECT *, (g11 * g22 - g12 * g12) AS det, (g12) / sqrt((g11 - 50) * (g22 - 50)) AS r FROM (
SELECT {K}, sum(a.z * a.z) + 50 AS g11, sum(b.z * b.z) + 50 AS g22, sum(a.z * b.z) AS g12, sum(a.z * a.target) AS b1, sum(b.z * b.target) AS b2 FROM moved a JOIN moved b USING ({K}, snap_id) WHERE a.name = 'DB CPU(s)' AND b.name = 'User calls' GROUP BY ALL HAVING count(*) >= 3))""", _MOVED))
def ridge_two_predictors(spark, d):
    two = moved(spark, d).where(F.col("name").isin("DB CPU(s)", "User calls"))
    fitted = gradient.fit(two)
    wide = fitted.groupBy("db_id", "instance_num").agg(F.max(F.when(F.col("name") == "User calls", F.col("ridge"))).alias("beta_calls"), F.max(F.when(F.col("name") == "DB CPU(s)", F.col("ridge"))).alias("beta_cpu"), F.max("vif").alias("vif"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    return r6(wide, "beta_calls", "beta_cpu").withColumn("vif", F.round("vif", 4))


@query(with_views("stats dbtime", f"SELECT {K}, 'fewer than 3 differences' AS note FROM moved GROUP BY ALL HAVING count(DISTINCT snap_id) < 3", _MOVED))
def gradient_notes(spark, d):
    return gradient.skipped(moved(spark, d))


@query(with_views("stats dbtime waits", f"""SELECT {K}, section, count(DISTINCT name) AS names, count(DISTINCT snap_id) AS snaps, round(sum(delta), 3) AS moved FROM (
SELECT {K}, 'fg_wait_events' AS section, snap_id, name, value - lag(value) OVER (PARTITION BY {K}, name ORDER BY snap_id) AS delta FROM dense) WHERE delta IS NOT NULL GROUP BY ALL""", f"dense AS (SELECT g.*, coalesce(f.value, 0.0) AS value FROM (SELECT s.*, n.name FROM (SELECT DISTINCT {K}, snap_id FROM dbtime) s JOIN (SELECT DISTINCT {K}, name FROM waits) n USING ({K})) g LEFT JOIN waits f USING ({K}, snap_id, name))"))
def gradient_section_sums(spark, d):
    rows = domain_rows.gradient_sections(views.metrics(spark, d))
    return rows.groupBy("db_id", "instance_num", "section").agg(F.count_distinct("name").alias("names"), F.count_distinct("snap_id").alias("snaps"), F.round(F.sum("delta"), 3).alias("moved"))


@query()
def gradient_section_models(spark, d):
    return gradient.fit(domain_rows.gradient_sections(views.metrics(spark, d)), keys=(*series.KEYS, "section"))


@query()
def gradient_models(spark, d):
    return gradient.fit(moved(spark, d))


@query()
def gradient_impacts(spark, d):
    own = moved(spark, d)
    return gradient.impacts(gradient.long_coefficients(gradient.fit(own)), gradient.scales(own))


@query()
def cross_model_labels(spark, d):
    return gradient.agreement(gradient_impacts(spark, d), 5)


@query()
def vif_report(spark, d):
    return gradient.collinear(gradient.fit(moved(spark, d)), least=1.5, severe=10)


@query()
def collinear_groups(spark, d):
    own = moved(spark, d)
    return gradient.groups(own, gradient.fit(own), inflated=1.2, alike=0.5)
