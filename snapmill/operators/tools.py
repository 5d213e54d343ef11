"""The lookup, ranking, search, timeline and comparison queries over parsed reports (``collection.snapshots``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmill.common import join_same
from snapmill.functions.text import ora_code, ora_text
from snapmill.operators import textscan
from snapmill.sources.attachments import os_files, plans
from snapmill.sources.collection import SECTIONS, histogram, metrics, section

AT = ["db_id", "instance_num", "snap_id"]
TOP, LIMIT, ROWS = 100, 500, 1000
SQL_METRICS = {"elapsed": ("sql_elapsed_time", "elapsed_time_s"), "cpu": ("sql_cpu_time", "cpu_time_s"), "io": ("sql_io_time", "io_time_s"), "gets": ("sql_gets", "buffer_gets"), "reads": ("sql_reads", "physical_reads")}
WAIT_RANKS = {"time": "total_wait_time_s", "waits": "waits", "avg": "avg_wait", "pct": "pct_dbtime"}
LATCH_RANKS = {"gets": "get_requests", "miss": "get_pct_miss", "wait": "wait_time"}


def same(a: Column | str, text: str) -> Column:
    return F.lower(F.trim(F.col(a) if isinstance(a, str) else a)) == text.strip().lower()


def holds(a: Column | str, text: str) -> Column:
    return F.lower(F.col(a) if isinstance(a, str) else a).contains(text.lower())


def headers(reports: DataFrame) -> DataFrame:
    """Per snapshot its ids, times, database time, CPU, their ratio, and the leading event."""
    time = section(reports, "time_model_stats")
    of = lambda name: F.max(F.when(same("stat_name", name), F.col("time_s")))
    model = time.groupBy(*AT).agg(of("DB time").alias("db_time_s"), of("DB CPU").alias("db_cpu_s"))
    lead = section(reports, "foreground_wait_events").groupBy(*AT).agg(F.max_by("event", F.struct("pct_dbtime", "event")).alias("top_event"), F.max("pct_dbtime").alias("top_pct"))
    base = reports.select(*AT, "end_id", "begins", "ends", "file_name", "status")
    ratio = F.when(F.col("db_time_s") > 0, F.col("db_cpu_s") / F.nullif("db_time_s", F.lit(0.0))).otherwise(0.0)
    return join_same(join_same(base, model, AT, "left"), lead, AT, "left").withColumn("cpu_ratio", ratio)


def list_snapshots(reports: DataFrame, first: int | None = None, last: int | None = None, limit: int = 50) -> DataFrame:
    rows = headers(reports)
    rows = rows if first is None else rows.where(F.col("snap_id") >= first)
    rows = rows if last is None else rows.where(F.col("end_id") <= last)
    return rows.orderBy(*AT).limit(min(limit, LIMIT))


def database_load_summary(reports: DataFrame, top_n: int = 10) -> dict[str, DataFrame]:
    """Totals, busiest snapshots and heaviest events."""
    rows, n = headers(reports), min(top_n, TOP)
    ratio = F.col("db_cpu_s") / F.nullif("db_time_s", F.lit(0.0))
    totals = rows.agg(F.count(F.lit(1)).alias("snapshots"), F.sum("db_time_s").alias("db_time_s"), F.sum("db_cpu_s").alias("db_cpu_s")).withColumn("cpu_ratio", F.coalesce(ratio, F.lit(0.0)))
    waits = section(reports, "foreground_wait_events").groupBy("event").agg(F.sum("total_wait_time_s").alias("time_s"), F.sum("waits").alias("waits"))
    return {"totals": totals, "busiest": rows.orderBy(F.col("db_time_s").desc_nulls_last(), *AT).limit(n), "events": waits.orderBy(F.col("time_s").desc(), "event").limit(n)}


def snapshot_summary(reports: DataFrame, snap_id: int) -> dict[str, DataFrame]:
    own = reports.where(F.col("snap_id") == snap_id)
    return {"header": headers(own), "events": top_wait_events(reports, snap_id), "sqls": top_sqls(reports, snap_id)}


def snapshot_details(reports: DataFrame, snap_id: int, sections: Sequence[str]) -> DataFrame:
    """Only the wanted sections of a snapshot; others aren't read."""
    known = [s for s in sections if s in SECTIONS]
    return reports.where(F.col("snap_id") == snap_id).select(*AT, "end_id", *known)


def top(df: DataFrame, snap_id: int, by: str, name: str, n: int) -> DataFrame:
    return df.where(F.col("snap_id") == snap_id).orderBy(F.col(by).desc_nulls_last(), name).limit(min(n, TOP))


def top_sqls(reports: DataFrame, snap_id: int, metric: str = "elapsed", n: int = 10) -> DataFrame:
    table, by = SQL_METRICS[metric]
    return top(section(reports, table), snap_id, by, "sql_id", n)


def top_wait_events(reports: DataFrame, snap_id: int, kind: str = "foreground", n: int = 10, by: str = "time") -> DataFrame:
    return top(section(reports, f"{kind}_wait_events"), snap_id, WAIT_RANKS[by], "event", n)


def top_segments(reports: DataFrame, snap_id: int, category: str, n: int = 10) -> DataFrame:
    return top(section(reports, "segment_stats").where(same("category", category)), snap_id, "stat_vlalue", "object_name", n)


def top_latches(reports: DataFrame, snap_id: int, by: str = "gets", n: int = 10) -> DataFrame:
    return top(section(reports, "latch_activity"), snap_id, LATCH_RANKS[by], "statname", n)


def sql_text(texts: DataFrame, sql_id: str) -> DataFrame:
    return texts.where(F.col("sql_id") == sql_id)


def search_sql_text(texts: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    from snapmill.functions.text import snippet

    return texts.where(holds("text", pattern)).select("sql_id", snippet(F.col("text")).alias("s")).select("sql_id", "s.*").orderBy("sql_id").limit(min(limit, LIMIT))


def sqls_touching(texts: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Statements whose text names an object."""
    return search_sql_text(texts, name, limit)


def init_parameters(parameters: DataFrame, names: Sequence[str] = (), pattern: str = "", limit: int = 50) -> DataFrame:
    """Parameters by name, absent ones as ``<not present>``, or by pattern (``name, value``)."""
    if not names:
        return parameters.where(holds("name", pattern)).orderBy("name").limit(min(limit, LIMIT))
    wanted = parameters.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    return wanted.join(parameters, "name", "left").orderBy("i").select("name", F.coalesce("value", F.lit("<not present>")).alias("value"))


def snapshots_with_event(reports: DataFrame, event: str, kind: str = "foreground", min_pct: float = 1.0) -> DataFrame:
    return section(reports, f"{kind}_wait_events").where(same("event", event) & (F.col("pct_dbtime") >= min_pct)).select(*AT, "event", "waits", "total_wait_time_s", "pct_dbtime")


def sql_timeline(reports: DataFrame, sql_id: str) -> DataFrame:
    """What every SQL section has of a statement, one row per snapshot that any has; executions of the first section with it."""
    parts = []
    for name, (table, value) in SQL_METRICS.items():
        df = section(reports, table).where(F.col("sql_id") == sql_id)
        parts.append(df.select(*AT, F.lit(name).alias("part"), F.col(value).alias("value"), "executions", "pct_total"))
    activity = section(reports, "top_sql_with_top_events").where(F.col("sql_id") == sql_id).select(*AT, F.lit("activity").alias("part"), F.col("pct_activity").alias("value"), "executions", F.lit(None).cast("double").alias("pct_total"))
    rows = reduce(DataFrame.unionByName, [*parts, activity])
    order = {p: i for i, p in enumerate([*SQL_METRICS, "activity"])}
    place = reduce(lambda c, kv: c.when(F.col("part") == kv[0], kv[1]), order.items(), F.when(F.lit(False), -1))
    values = [F.max(F.when(F.col("part") == p, F.col("value"))).alias(p) for p in order]
    return rows.groupBy(*AT).agg(*values, F.min_by("executions", place).alias("executions"), F.min_by("pct_total", place).alias("pct_total"))


snapshots_with_sql = sql_timeline


def sqls_by_module(reports: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Statements of modules that hold a pattern, each once with its first snapshot, elapsed before CPU."""
    parts = [section(reports, t).select("sql_id", "sql_module", "snap_id", F.lit(i).alias("part")) for i, t in enumerate(("sql_elapsed_time", "sql_cpu_time"))]
    rows = parts[0].unionByName(parts[1]).where(holds("sql_module", pattern))
    first = F.struct("part", "snap_id", "sql_module")
    return rows.groupBy("sql_id").agg(F.min(first).alias("f")).select("sql_id", "f.sql_module", "f.snap_id").orderBy("sql_id").limit(min(limit, LIMIT))


def metric_series(reports: DataFrame, kind: str, name: str, field: str) -> DataFrame:
    return metrics(reports).where((F.col("kind") == kind) & same("name", name) & (F.col("field") == field)).select(*AT, "name", "value")


def event_timeline(reports: DataFrame, event: str, kind: str = "foreground") -> DataFrame:
    return section(reports, f"{kind}_wait_events").where(same("event", event)).select(*AT, "waits", "total_wait_time_s", "avg_wait", "pct_dbtime")


def compare(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], how: str, limit: int = 20) -> DataFrame:
    """Two snapshots' rows of a section by name: values of both, absent ones 0, and their differences, greatest first.

    ``how`` is ``full`` (names of either) or ``right`` (names of the second).
    """
    x = a.groupBy(key).agg(*(F.sum(f).alias(f"a_{f}") for f in fields))
    y = b.groupBy(key).agg(*(F.sum(f).alias(f"b_{f}") for f in fields))
    both = x.join(y, key, how).na.fill(0, [*(f"a_{f}" for f in fields), *(f"b_{f}" for f in fields)])
    rows = both.withColumns({f"delta_{f}": F.col(f"b_{f}") - F.col(f"a_{f}") for f in fields})
    return rows.orderBy(F.abs(f"delta_{fields[0]}").desc(), key).limit(limit)


def compare_snapshots(reports: DataFrame, first: int, second: int, focus: Sequence[str] = ("load", "waits", "sqls", "latches")) -> dict[str, DataFrame]:
    what = {"load": ("load_profile", "stat_name", ["per_second"], "right", 20), "waits": ("foreground_wait_events", "event", ["total_wait_time_s", "waits"], "right", 20), "sqls": ("sql_elapsed_time", "sql_id", ["elapsed_time_s", "executions"], "full", 20), "latches": ("latch_activity", "statname", ["get_requests"], "right", 15)}
    out = {}
    for f in focus:
        table, key, fields, how, limit = what[f]
        rows = section(reports, table)
        out[f] = compare(rows.where(F.col("snap_id") == first), rows.where(F.col("snap_id") == second), key, fields, how, limit)
    return out


def event_histogram(reports: DataFrame, snap_id: int, event: str, kind: str = "foreground") -> DataFrame:
    return histogram(reports, kind).where((F.col("snap_id") == snap_id) & same("event", event)).orderBy("bucket_no")


def available_metrics(reports: DataFrame, kind: str = "", pattern: str = "", limit: int = 200) -> DataFrame:
    rows = metrics(reports).select("kind", "name").distinct()
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.where(holds("name", pattern)).orderBy("kind", "name").limit(min(limit, ROWS))


def alert_errors(lines: DataFrame, first: str | None = None, last: str | None = None, code: str = "", limit: int = 200) -> DataFrame:
    """Alert events by kind and day, with number, first and last time and a sample."""
    rows = textscan.between_days(textscan.alert_events(textscan.with_times(lines)), first, last).where(holds("event", code))
    return rows.groupBy("event", F.to_date("logged_at").alias("day")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("logged_at").alias("first"), F.max("logged_at").alias("last"), F.min_by(F.substring("line", 1, 240), F.struct("logged_at", "line_no")).alias("sample")).orderBy(F.col("occurrences").desc(), "event", "day").limit(min(limit, ROWS))


def parse_error_details(lines: DataFrame, first: str | None = None, last: str | None = None, code: str = "", limit: int = 200) -> DataFrame:
    """Details of warnings on too many parse errors: when, how many, of which statement, error, user, application and action."""
    timed = textscan.with_times(lines)
    opened = textscan.between_days(timed.where(F.col("logged_at").isNotNull()), first, last).select("log_name", "line_no", "logged_at", F.substring("line", 1, 240).alias("sample"))
    rows = textscan.parse_error_blocks(lines).join(opened, ["log_name", "line_no"])
    known = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    named = rows.select("log_name", "line_no", "logged_at", "total", known(F.lower("sql_hash")).alias("sql_hash"), known(ora_code(F.col("code").cast("string"))).alias("code"), ora_text(F.col("code")).alias("description"), known(F.lower("sqlid")).alias("sqlid"), *(known(F.col(c)).alias(c) for c in ("username", "application", "action")), "sample")
    return named.where(holds("code", code) | holds("description", code)).orderBy("logged_at", "log_name", "line_no").limit(min(limit, ROWS))


def cpu_entitlement(files: DataFrame) -> DataFrame:
    """How near systems run to their entitlement, of ``os_texts``; of ``os_files`` only the readings in its excerpts count."""
    from snapmill.functions.text import cpu_bound

    stats = textscan.reading_stats(textscan.aix_readings(files))
    of = lambda reading, c: F.max(F.when(F.col("reading") == reading, F.col(c)))
    return stats.agg(of("entc_pct", "most").alias("most"), of("entc_pct", "p95").alias("p95"), of("entc_pct", "mean").alias("mean"), of("cpu_busy_pct", "most").alias("busy")).withColumn("assessment", cpu_bound(F.col("most"), F.col("p95"), F.col("mean"), F.col("busy")))


def instance_info(collections: DataFrame) -> DataFrame:
    return collections.select("db_instance_information.*")


#: All queries by name; what they take is in their signatures.
TOOLS: dict[str, Callable] = {
    "get_database_load_summary": database_load_summary, "get_snapshot_summary": snapshot_summary, "get_snapshot_details": snapshot_details, "get_sql_text": sql_text, "get_init_parameter": init_parameters,
    "get_db_instance_info": instance_info, "list_available_sql_plans": plans, "get_sql_execution_plan": plans, "list_aix_os_attachments": os_files, "get_aix_os_attachment": os_files, "get_aix_cpu_entitlement_summary": cpu_entitlement,
    "get_alertlog_errors": alert_errors, "get_alertlog_parse_errors": parse_error_details, "list_snapshots": list_snapshots, "list_snapshots_in_range": list_snapshots, "top_sqls_in_snapshot": top_sqls, "top_wait_events_in_snapshot": top_wait_events, "top_segments_in_snapshot": top_segments,
    "top_latches_in_snapshot": top_latches, "search_sql_text": search_sql_text, "find_sqls_touching_object": sqls_touching, "find_snapshots_with_event": snapshots_with_event, "find_snapshots_with_sql": snapshots_with_sql, "find_sqls_by_module": sqls_by_module,
    "get_metric_time_series": metric_series, "get_wait_event_timeline": event_timeline, "get_sql_timeline": sql_timeline, "compare_snapshots": compare_snapshots, "get_wait_event_histogram": event_histogram, "list_available_metrics": available_metrics,
}


def call(name: str, *args, **kwargs):
    """A query by name; a wrong name or argument gives ``{"error": ...}`` rather than an exception."""
    try:
        return TOOLS[name](*args, **kwargs)
    except KeyError as problem:
        return {"error": f"unknown: {problem}"}
    except (TypeError, ValueError) as problem:
        return {"error": str(problem)}


