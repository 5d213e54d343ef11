"""What an analysis compares, by domain: anomalies, degradation, tracked statistics, gradient sections, statements and their tables.

All domains are rows of one long table (``collection.metrics``: keys, ``snap_id, kind, name, field, value``), so that each analysis of
all of them is one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill import dims
from snapmill.functions import text
from snapmill.operators import anomalies, correlation, degradation, gradient, summaries
from snapmill.operators.series import KEYS, densify, of

# The section and field that each domain compares.
DOMAINS = {
    "foreground": ("foreground_wait_events", "total_wait_time_s"),
    "background": ("background_wait_events", "total_wait_time_s"),
    "sql": ("sql_elapsed_time", "elapsed_time_s"),
    "load_profile": ("load_profile", "per_second"),
    "instance_stats": ("instance_stats", "total"),
    "dictionary_cache": ("dictionary_cache", "get_requests"),
    "library_cache": ("library_cache", "pin_requests"),
    "latch": ("latch_activity", "get_requests"),
    "time_model": ("time_model_stats", "time_s"),
}
# The domains whose degradation counts.
DEGRADING = ("load_profile", "time_model", "foreground", "background", "sql")
# The statistics that gradients are taken against.
TARGETS = {"time": "DB Time(s)", "cpu": "DB CPU(s)"}
# The tracked statistics: label, section, whether the name must be equal or begin so, the name, its scale (blocks: as MB by the
# block size), and whether it counts only where log file sync is a top event.
TRACKED = (
    ("User Calls/s", "load_profile", "starts", "User calls", 1.0, False),
    ("Transactions/s", "load_profile", "starts", "Transactions", 1.0, False),
    ("Executes/s", "load_profile", "starts", "Executes", 1.0, False),
    ("Block changes/s", "load_profile", "starts", "Block changes", 1.0, False),
    ("Parses/s", "load_profile", "starts", "Parses", 1.0, False),
    ("Hard Parses/s", "load_profile", "starts", "Hard parses", 1.0, False),
    ("Redo MB/s", "load_profile", "starts", "Redo size", 1 / 1024 / 1024, False),
    ("Logical Read MB/s", "load_profile", "starts", "Logical read", "blocks", False),
    ("Physical Read MB/s", "load_profile", "starts", "Physical read", "blocks", False),
    ("Physical Write MB/s", "load_profile", "starts", "Physical write", "blocks", False),
    ("User Commits", "instance_stats", "is", "user commits", 1.0, False),
    ("User Rollbacks", "instance_stats", "is", "user rollbacks", 1.0, False),
    ("Failed Parses", "instance_stats", "is", "parse count (failures)", 1.0, True),
    ("User Logons", "instance_stats", "is", "user logons cumulative", 1.0, False),
    ("User Logouts", "instance_stats", "is", "user logouts cumulative", 1.0, False),
    ("User Calls (cum.)", "instance_stats", "is", "user calls", 1.0, True),
    ("Cleanout KTUGCT", "instance_stats", "starts", "cleanout - number of ktugct calls", 1.0, True),
    ("Cleanouts CR Only", "instance_stats", "starts", "cleanouts only - consistent read", 1.0, True),
    ("Table Fetch Cont Row", "instance_stats", "is", "table fetch continued row", 1.0, False),
    ("Table Fetch by Rowid", "instance_stats", "is", "table fetch by rowid", 1.0, False),
    ("Table Scan Blocks", "instance_stats", "is", "table scan blocks gotten", 1.0, False),
    ("Table Scan Rows", "instance_stats", "is", "table scan rows gotten", 1.0, False),
    ("Redo Log Switches/h", "redo_log", "is", "log switches (derived)", 1.0, True),
)
EXCESSIVE, GATE = "Excessive Commits", "log file sync"
# Gradient sections: name, target, section and field of the features, and the group of statistics they must be of.
SECTIONS = (
    ("fg_wait_events", "time", "foreground_wait_events", "total_wait_time_s", None),
    ("instance_stats_counters", "time", "instance_stats", "total", "counters"),
    ("instance_stats_volumes", "time", "instance_stats", "total", "volume"),
    ("instance_stats_time", "time", "instance_stats", "total", "time"),
    ("sql_elapsed_time", "time", "sql_elapsed_time", "elapsed_time_s", None),
    ("cpu_instance_stats", "cpu", "instance_stats", "total", "cpu"),
    ("cpu_sql_cpu_time", "cpu", "sql_cpu_time", "cpu_time_s", None),
)
# The sections of a chosen target, and what the target is taken from.
CUSTOM = (("instance_stats_for_sql_or_event", "instance_stats", "total"), ("wait_event_for_sql_or_event", "foreground_wait_events", "total_wait_time_s"))
CUSTOM_TARGETS = {"SQL": ("sql_elapsed_time", "elapsed_time_s"), "WAIT": ("foreground_wait_events", "total_wait_time_s")}


def picked(metrics: DataFrame, kind: str, field: str) -> DataFrame:
    """One field of one section as a series; a name that is listed twice in a snapshot counts with its sum."""
    own = metrics.where((F.col("kind") == kind) & (F.col("field") == field))
    return own.groupBy(*KEYS, "snap_id", "name").agg(F.sum("value").alias("value"))


def target(metrics: DataFrame, name: str) -> DataFrame:
    """A load-profile statistic as the series that others are compared with."""
    return picked(metrics, "load_profile", "per_second").where(F.col("name") == name)


def series(metrics: DataFrame, domains: Sequence[str] = tuple(DOMAINS)) -> DataFrame:
    """``keys, snap_id, domain, name, value`` of the domains."""
    wanted = reduce(lambda a, b: a | b, ((F.col("kind") == DOMAINS[d][0]) & (F.col("field") == DOMAINS[d][1]) for d in domains))
    rows = metrics.where(wanted & F.col("name").isNotNull() & F.col("value").isNotNull()).groupBy(*KEYS, "snap_id", "kind", "name").agg(F.sum("value").alias("value"))
    label = reduce(lambda c, d: c.when(F.col("kind") == DOMAINS[d][0], d), domains[1:], F.when(F.col("kind") == DOMAINS[domains[0]][0], domains[0]))
    return rows.select(*KEYS, "snap_id", label.alias("domain"), "name", "value")


def found_anomalies(metrics: DataFrame, threshold: float = anomalies.THRESHOLD, top: int = anomalies.TOP, dense: bool = False) -> DataFrame:
    """Anomalies of all nine domains: ``keys, snap_id, domain, name, value, score, rank``. With ``dense``, snapshots without a name count as -1."""
    rows, keys = series(metrics), (*KEYS, "domain")
    if dense:
        snaps = metrics.select(*KEYS, "snap_id").distinct().join(rows.select(*keys).distinct(), [*KEYS])
        rows = densify(rows, -1.0, keys, snaps=snaps)
    return anomalies.mad_global(rows, threshold, top, keys)


def with_facts(found: DataFrame, facts: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Anomalies with the numbers of their name in their snapshot; of a name that is listed twice there the greatest numbers hold."""
    once = facts.groupBy(*keys, "snap_id", "name").agg(*(F.max(c).alias(c) for c in columns))
    return found.join(once, [*keys, "snap_id", "name"], "left")


def with_means(found: DataFrame, rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Anomalies with the mean of their series."""
    return found.join(rows.groupBy(*keys, "name").agg(F.avg("value").alias("mean")), [*keys, "name"])


def degraded(metrics: DataFrame, domains: Sequence[str] = DEGRADING) -> DataFrame:
    """Names of the five domains that got worse against the database time, as ``degradation.findings``."""
    goal = target(metrics, TARGETS["time"])
    rows = series(metrics, domains).withColumn("name", F.concat_ws(" ", "domain", "name")).drop("domain")
    found = degradation.findings(rows, goal, "")
    return found.withColumn("domain", F.substring_index("name", " ", 1)).withColumn("name", F.expr("substring(name, length(domain) + 2)"))


def promoted(metrics: DataFrame, modules: DataFrame) -> DataFrame:
    """All degraded statements, however many, with their module (``keys, sql_id, module``): they join the top statements."""
    own = degraded(metrics, ("sql",)).select(*KEYS, F.col("name").alias("sql_id"), "share", "z")
    return own.join(modules, [*KEYS, "sql_id"], "left").withColumn("module", F.coalesce("module", F.lit("")))


def tracked(metrics: DataFrame, block_sizes: DataFrame, gated: DataFrame) -> DataFrame:
    """The tracked statistics: ``keys, snap_id, label, value``.

    ``block_sizes`` has the instances' ``db_block_size``; ``gated`` the keys in which log file sync is a top event, where the gated statistics count,
    among them calls per commit or rollback (0 without either). Of several names that a pattern meets in a snapshot the first holds.
    """
    rows = metrics.join(block_sizes.groupBy(*KEYS).agg(F.max("db_block_size").alias("_block")), [*KEYS], "left").join(gated.select(*KEYS).distinct().withColumn("_gated", F.lit(True)), [*KEYS], "left")
    items = []
    for label, kind, how, name, factor, gate in TRACKED:
        hit = (F.col("kind") == kind) & (F.col("name") == name if how == "is" else F.col("name").startswith(name)) & (F.col("_gated").isNotNull() if gate else F.lit(True))
        items.append(F.when(hit, F.struct(F.lit(label).alias("label"), (F.col("_block") / 1024 / 1024 if factor == "blocks" else F.lit(factor)).cast("double").alias("factor"))))
    own = rows.where(F.col("field").isin("per_second", "total", "per_hour")).select(*KEYS, "snap_id", "name", "value", "_gated", F.explode(F.array_compact(F.array(*items))).alias("t"))
    found = own.groupBy(*KEYS, "snap_id", F.col("t.label").alias("label")).agg(F.min_by(F.col("value") * F.col("t.factor"), "name").alias("value"))
    of_ = lambda label: F.coalesce(F.max(F.when(F.col("label") == label, F.col("value"))), F.lit(0.0))
    ends = found.join(gated.select(*KEYS).distinct(), [*KEYS], "left_semi").groupBy(*KEYS, "snap_id").agg(of_("User Calls (cum.)").alias("c"), (of_("User Commits") + of_("User Rollbacks")).alias("e"))
    return found.unionByName(ends.select(*KEYS, "snap_id", F.lit(EXCESSIVE).alias("label"), F.when(F.col("e") > 0, F.col("c") / F.nullif("e", F.lit(0.0))).otherwise(0.0).alias("value")))


def gradient_sections(metrics: DataFrame, custom: str | None = None) -> DataFrame:
    """Differences of all gradient sections with those of their targets, as ``gradient.differences`` with ``section`` as one more key.

    ``custom`` names a target of its own, ``SQL=id`` or ``WAIT=event``, for two further sections: all statistics, and all other events.
    """
    keys = (*KEYS, "section")
    parts, goals = [], []
    specs = [(s, target(metrics, TARGETS[goal]), picked(metrics, kind, field), group) for s, goal, kind, field, group in SECTIONS]
    if custom is not None:
        what, _, name = custom.strip().partition("=")
        if what not in CUSTOM_TARGETS or not name:
            raise ValueError("a custom target is SQL=id or WAIT=event")
        goal = picked(metrics, *CUSTOM_TARGETS[what]).where(F.col("name") == name)
        specs += [(s, goal, picked(metrics, kind, field).where(F.col("name") != name), None) for s, kind, field in CUSTOM]
    for section, goal, features, group in specs:
        parts.append((features if group is None else dims.of_group(features, group)).withColumn("section", F.lit(section)))
        goals.append(goal.withColumn("section", F.lit(section)))
    union = lambda tables: reduce(DataFrame.unionByName, tables)
    return gradient.differences(union(parts), union(goals), keys)


def sql_ids(reports: DataFrame, texts: DataFrame, sections: Sequence[str] = ("sql_elapsed_time", "sql_cpu_time", "sql_io_time", "sql_gets", "sql_reads", "top_sql_with_top_events")) -> DataFrame:
    """Every statement id of the sections (columns of ``snapshots``) and of the texts (``sql_id``), each once."""
    from snapmill.sources.collection import section

    out = texts.select("sql_id")
    for name in sections:
        rows = section(reports, name)
        out = out.unionByName(rows.select(F.coalesce("sql_id", *(["category"] if "category" in rows.columns else [])).alias("sql_id")))
    return out.where("sql_id is not null").distinct()


def top_sqls(metrics: DataFrame, chosen: DataFrame, modules: DataFrame, activity: DataFrame, waits: DataFrame) -> DataFrame:
    """A row per chosen statement (``keys, sql_id``): its elapsed time, its correlation with the database time, in what share of snapshots the
    other sections list it, its module, its active-session events (``activity``: ``keys, sql_id, event_name, mean``) and the foreground events that
    correlate strongly with it."""
    elapsed = picked(metrics, "sql_elapsed_time", "elapsed_time_s").join(chosen.select(*KEYS, F.col("sql_id").alias("name")).distinct(), [*KEYS, "name"], "left_semi")
    goal = target(metrics, TARGETS["time"])
    own = elapsed.groupBy(*KEYS, "name").agg(F.avg("value").alias("mean_s"), F.stddev_pop("value").alias("spread_s"), F.count(F.lit(1)).alias("n"))
    r = correlation.to_target(densify(elapsed, 0.0, snaps=goal), goal).select(*KEYS, "name", "r")
    others = {label: metrics.where(F.col("kind") == kind) for label, kind in (("cpu", "sql_cpu_time"), ("io", "sql_io_time"), ("gets", "sql_gets"), ("reads", "sql_reads"))}
    shares = summaries.elsewhere(elapsed, others, metrics)
    events = activity.groupBy(*KEYS, F.col("sql_id").alias("name")).agg(F.array_sort(F.collect_list(F.struct("event_name", F.round("mean", 6).alias("mean")))).alias("session_events"))
    strong = correlation.strong_pairs(elapsed, waits).groupBy(*KEYS, F.col("left_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct(F.col("right_name").alias("event_name"), F.round("r", 6).alias("r")))).alias("strong_events"))
    module = modules.select(*KEYS, F.col("sql_id").alias("name"), "module")
    return reduce(lambda a, b: a.join(b, [*KEYS, "name"], "left"), (r, shares, module, events, strong), own).withColumnRenamed("name", "sql_id")


def event_tables(statements: DataFrame, texts: DataFrame) -> DataFrame:
    """Tables that an event's statements name: ``keys, event_name, tables``.

    ``statements`` is of ``top_sqls``: an event has the statements with it in their active sessions and those that correlate strongly with it.
    ``texts`` has ``sql_id, text``. Events whose statements name no table are left out.
    """
    both = F.array_distinct(F.concat(*(F.coalesce(F.transform(c, lambda x: x["event_name"]), F.array().cast("array<string>")) for c in ("session_events", "strong_events"))))
    pairs = statements.select(*KEYS, "sql_id", F.explode(both).alias("event_name"))
    named = texts.select("sql_id", F.explode(text.tables(F.col("text"))).alias("table_name"))
    return pairs.join(named, "sql_id").groupBy(*KEYS, "event_name").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def largest_file(files: DataFrame) -> DataFrame:
    """The largest of several files (``path, length``), the first path of equal ones."""
    return files.orderBy(F.col("length").desc(), "path").limit(1)


def trimmed(rows: DataFrame, by: str, top: int, within: Sequence[str] = KEYS, tie: str = "name") -> DataFrame:
    """The ``top`` rows of each group by a column, as a report's lists are cut; ties by name."""
    rank = F.row_number().over(of(within).orderBy(F.col(by).desc_nulls_last(), tie))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank")


def without_descriptions(rows: DataFrame) -> DataFrame:
    """A report's table without its descriptions, at the top or inside its lists of structs."""
    out = rows.drop("description")
    for f in out.schema.fields:
        inner = getattr(f.dataType, "elementType", None)
        if hasattr(inner, "names") and "description" in inner.names:
            out = out.withColumn(f.name, F.transform(f.name, lambda x: x.dropFields("description")))
    return out
