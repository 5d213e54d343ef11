"""Queries of the summary, text and lookup operators over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmill import dims
from snapmill.common import load, spread
from snapmill.functions import text
from snapmill.operators import domains, report, series, summaries, textscan, tools
from snapmill.plans import views
from snapmill.plans.metrics import K, _R, r6
from snapmill.plans.views import with_views
from snapmill.sources import attachments, collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Summaries


@query(with_views("stats dbtime waits", f"""SELECT {K}, name, n, round(mean_s, 6) AS mean_s, round(spread_s, 6) AS spread_s, round(mean_pct, 6) AS mean_pct, round(r, 6) AS r, round(coalesce(mean_s / nullif(mean_n, 0) * 1000, 0), 6) AS mean_ms, round(coalesce(spread_s / nullif(spread_n, 0) * 1000, 0), 6) AS spread_ms FROM
(SELECT {K}, name, avg(value) AS mean_s, stddev_pop(value) AS spread_s, avg(waits) AS mean_n, stddev_pop(waits) AS spread_n, avg(pct) AS mean_pct, count(*) AS n FROM waits GROUP BY ALL) JOIN
(SELECT {K}, d.name, {_R.format(x='d.value', y='t.value')} AS r FROM dense d JOIN dbtime t USING ({K}, snap_id) GROUP BY ALL) USING ({K}, name)""", f"dense AS (SELECT g.*, coalesce(f.value, 0.0) AS value FROM (SELECT s.*, n.name FROM (SELECT DISTINCT {K}, snap_id FROM dbtime) s JOIN (SELECT DISTINCT {K}, name FROM waits) n USING ({K})) g LEFT JOIN waits f USING ({K}, snap_id, name))"))
def event_summary(spark, d):
    rows = summaries.events(views.waits(spark, d), views.named(spark, d, "DB Time(s)"))
    return r6(rows, "mean_s", "spread_s", "mean_pct", "r", "mean_ms", "spread_ms").drop("mean_n", "spread_n", "spread_pct")


@query(with_views("stats waits", f"SELECT {K}, name, n, round(n / snaps * 100, 6) AS share FROM (SELECT {K}, name, count(DISTINCT snap_id) AS n FROM waits GROUP BY ALL) JOIN (SELECT {K}, count(DISTINCT snap_id) AS snaps FROM stats GROUP BY ALL) USING ({K})"))
def marked_pct(spark, d):
    return r6(summaries.marked_share(views.waits(spark, d), views.stats(spark, d)), "share")


_LATCH = "latch AS (SELECT CAST(1 AS BIGINT) AS db_id, CAST(1 AS BIGINT) AS instance_num, year(l_shipdate) * 12 + month(l_shipdate) AS snap_id, CAST(l_linenumber AS VARCHAR) AS name, sum(l_quantity) AS gets, avg(l_discount) AS miss, avg(l_tax) AS wait FROM lineitem GROUP BY ALL)"


@query(f"WITH {_LATCH} SELECT {K}, name, round(sum(gets * miss) / sum(gets), 6) AS miss, round(sum(gets * wait) / sum(gets), 6) AS wait, round(avg(gets), 6) AS gets, round(count(*) / (SELECT count(DISTINCT snap_id) FROM latch) * 100, 6) AS share FROM latch WHERE gets > 0 GROUP BY ALL HAVING sum(gets * miss) > 0")
def latch_weighted(spark, d):
    rows = load(spark, d, "lineitem").groupBy(F.lit(1).cast("bigint").alias("db_id"), F.lit(1).cast("bigint").alias("instance_num"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("snap_id"), F.col("l_linenumber").cast("string").alias("name")).agg(F.sum("l_quantity").alias("gets"), F.avg("l_discount").alias("miss"), F.avg("l_tax").alias("wait"))
    return r6(summaries.latches(rows, rows), "miss", "wait", "gets", "share")


@query(f"""WITH seg AS (SELECT CAST(1 AS BIGINT) AS db_id, CAST(1 AS BIGINT) AS instance_num, year(l_shipdate) * 12 + month(l_shipdate) AS snap_id, l_returnflag AS category, CAST(l_suppkey AS VARCHAR) AS name, sum(l_extendedprice) AS value FROM lineitem GROUP BY ALL)
SELECT {K}, category, name, round(mean + 1e-6, 4) AS mean, round(spread + 1e-6, 4) AS spread, n, round(n / (SELECT count(DISTINCT snap_id) FROM seg) * 100, 6) AS share, row_number() OVER (PARTITION BY category ORDER BY n DESC, name) AS rank FROM (SELECT {K}, category, name, avg(value) AS mean, stddev_pop(value) AS spread, count(*) AS n FROM seg GROUP BY ALL) QUALIFY rank <= 10""")
def segment_top10(spark, d):
    rows = load(spark, d, "lineitem").groupBy(F.lit(1).cast("bigint").alias("db_id"), F.lit(1).cast("bigint").alias("instance_num"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("snap_id"), F.col("l_returnflag").alias("category"), F.col("l_suppkey").cast("string").alias("name")).agg(F.sum("l_extendedprice").alias("value"))
    found = summaries.segments(rows, rows).withColumn("rank", F.col("rank").cast("bigint"))
    return found.withColumns({"mean": F.round(F.col("mean") + 1e-6, 4), "spread": F.round(F.col("spread") + 1e-6, 4), "share": F.round("share", 6)})


@query(f"""WITH io AS (SELECT CAST(1 AS BIGINT) AS db_id, CAST(1 AS BIGINT) AS instance_num, year(o_orderdate) * 12 + month(o_orderdate) AS snap_id, o_orderpriority AS name, sum(o_totalprice) AS volume, CAST(count(*) AS DOUBLE) AS requests FROM orders GROUP BY ALL),
g AS (SELECT s.*, n.name FROM (SELECT DISTINCT {K}, snap_id FROM io) s JOIN (SELECT DISTINCT {K}, name FROM io) n USING ({K}))
SELECT {K}, name, round(avg(coalesce(volume, 0)), 2) AS mean_volume, round(stddev_pop(coalesce(volume, 0)), 2) AS spread_volume, round(avg(coalesce(requests, 0)), 6) AS mean_requests, round(stddev_pop(coalesce(requests, 0)), 6) AS spread_requests FROM g LEFT JOIN io USING ({K}, snap_id, name) GROUP BY ALL""")
def io_function_summary(spark, d):
    rows = load(spark, d, "orders").groupBy(F.lit(1).cast("bigint").alias("db_id"), F.lit(1).cast("bigint").alias("instance_num"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("snap_id"), F.col("o_orderpriority").alias("name")).agg(F.sum("o_totalprice").alias("volume"), F.count(F.lit(1)).cast("double").alias("requests"))
    return r6(summaries.io_functions(rows, ["volume", "requests"]), "mean_requests", "spread_requests").withColumns({c: F.round(c, 2) for c in ("mean_volume", "spread_volume")})


@query(f"SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, wait_kind AS sql_id, event AS event_name, round(avg(pct_dbtime), 6) AS mean, round(stddev_pop(pct_dbtime), 6) AS spread, count(*) AS n FROM wait_events WHERE pct_dbtime IS NOT NULL GROUP BY ALL")
def ash_summary(spark, d):
    rows = load(spark, d, "wait_events").where("pct_dbtime is not null").select("db_id", F.col("instance_num").cast("bigint").alias("instance_num"), F.col("wait_kind").alias("sql_id"), F.col("event").alias("event_name"), F.col("pct_dbtime").alias("pct_activity"))
    return r6(summaries.activity(rows), "mean", "spread")


@query(with_views("waits backs stats", f"SELECT {K}, name, round(coalesce(b.n, 0) / s.snaps * 100, 6) AS in_background FROM (SELECT DISTINCT {K}, name FROM waits) JOIN (SELECT {K}, count(DISTINCT snap_id) AS snaps FROM stats GROUP BY ALL) s USING ({K}) LEFT JOIN (SELECT {K}, name, count(DISTINCT snap_id) AS n FROM backs GROUP BY ALL) b USING ({K}, name)"))
def other_sections_pct(spark, d):
    found = summaries.elsewhere(views.waits(spark, d), {"background": views.waits(spark, d, "background")}, views.stats(spark, d))
    return r6(found, "in_background")


_BLOCKS = f"b AS (SELECT {K}, max(db_block_size) / 1048576.0 AS factor FROM (SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, db_block_size FROM db_instance) GROUP BY ALL)"
_PER_SECOND = ", ".join(f"('{label}', '{name}', {'NULL' if factor == 'blocks' else repr(factor)})" for label, kind, _, name, factor, _ in domains.TRACKED if kind == "load_profile")


@query(with_views("stats waits", f"""SELECT {K}, snap_id, label, round(arg_min(value * coalesce(v.factor, b.factor), name), 6) AS value FROM stats JOIN (VALUES {_PER_SECOND}) v(label, pattern, factor) ON starts_with(name, pattern) LEFT JOIN b USING ({K}) GROUP BY ALL
UNION ALL SELECT {K}, snap_id, '{domains.EXCESSIVE}', 0.0 FROM (SELECT DISTINCT {K}, snap_id FROM stats JOIN (VALUES {_PER_SECOND}) v(label, pattern, factor) ON starts_with(name, pattern)) SEMI JOIN (SELECT {K} FROM waits WHERE name = '{domains.GATE}') USING ({K})""", _BLOCKS))
def tracked_series(spark, d):
    sizes = load(spark, d, "db_instance").select("db_id", F.col("instance_num").cast("bigint").alias("instance_num"), "db_block_size")
    gated = views.waits(spark, d).where(F.col("name") == domains.GATE)
    return r6(domains.tracked(views.metrics(spark, d), sizes, gated), "value")


@query("SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, count(DISTINCT cpus) AS \"values\", min(cpus) AS least, max(cpus) AS most FROM host_cpu GROUP BY 1, 2 HAVING count(DISTINCT cpus) > 1")
def cpu_changes(spark, d):
    return summaries.cpu_changes(load(spark, d, "host_cpu").withColumn("instance_num", F.col("instance_num").cast("bigint")))


@query("SELECT DISTINCT db_id, begin_snap_id, end_snap_id, cpus, cores, pct_user, pct_idle FROM host_cpu WHERE load_avg_begin IS NOT NULL AND pct_idle < 20")
def busy_hosts(spark, d):
    return load(spark, d, "host_cpu").where("load_avg_begin is not null and pct_idle < 20").select("db_id", "begin_snap_id", "end_snap_id", "cpus", "cores", "pct_user", "pct_idle").distinct()


@query("SELECT event, count(*) AS n FROM wait_events WHERE NOT (" + " OR ".join(f"starts_with('{n.replace(chr(39), chr(39) * 2)}', event)" for n in dims.IDLE) + ") GROUP BY ALL")
def idle_prefix_antijoin(spark, d):
    return load(spark, d, "wait_events").where(~dims.is_idle("event")).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


# Texts


@query(r"SELECT line_id, l AS logged_at, regexp_extract(line, '(?i)\b(ORA-\d{4,5})\b', 1) AS ora FROM (SELECT *, coalesce(try_strptime(nullif(concat_ws(' ', regexp_extract(line, '^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})', 1), regexp_extract(line, '^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})', 2)), ' '), '%Y-%m-%d %H:%M:%S'), try_strptime(concat_ws(' ', regexp_extract(line, '^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$', 4), regexp_extract(line, '^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$', 1), regexp_extract(line, '^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$', 2), regexp_extract(line, '^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$', 3)), '%Y %b %d %H:%M:%S')) AS own, last_value(own IGNORE NULLS) OVER (PARTITION BY log_name ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS l FROM alert_lines)")
def forward_fill_ts(spark, d):
    rows = textscan.with_times(load(spark, d, "alert_lines"))
    return rows.select("line_id", F.col("logged_at").cast("timestamp_ntz").alias("logged_at"), F.regexp_extract("line", r"(?i)\b(ORA-\d{4,5})\b", 1).alias("ora"))


_EVENT = "CASE WHEN regexp_matches(line, '(?i)\\bWARNING:\\s*too many parse errors,\\s*count=\\d+\\b') THEN 'WARNING_TOO_MANY_PARSE_ERRORS' WHEN regexp_matches(line, '(?i)\\bPARSE\\s+ERROR:\\s*ospid=\\d+,\\s*error=\\d+\\b') THEN 'PARSE_ERROR_ORA-' || lpad(regexp_extract(line, '(?i)\\bPARSE\\s+ERROR:\\s*ospid=\\d+,\\s*error=(\\d+)\\b', 1), 5, '0') WHEN regexp_matches(line, '(?i)\\bORA-\\d{4,5}\\b') THEN upper(regexp_extract(line, '(?i)\\b(ORA-\\d{4,5})\\b', 1)) WHEN regexp_matches(line, '(?i)\\bTNS-\\d{5}\\b') THEN upper(regexp_extract(line, '(?i)\\b(TNS-\\d{5})\\b', 1)) " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in text.SPECIAL) + " END"


@query(f"SELECT event, count(*) AS n FROM (SELECT {_EVENT} AS event FROM alert_lines) WHERE event IS NOT NULL GROUP BY ALL")
def error_classify(spark, d):
    return load(spark, d, "alert_lines").withColumn("event", text.alert_event(F.col("line"))).where("event is not null").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


_TIMED = f"(regexp_matches(line, '{textscan.ISO}') OR regexp_matches(line, '{textscan.LEGACY}'))"
_SAYS = "max(nullif(regexp_extract(line, '{}', {}), '')) AS {}"


@query(f"""WITH s AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '{text.TOO_MANY}') THEN line_no END IGNORE NULLS) OVER (PARTITION BY log_name ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM alert_lines),
near AS (SELECT * FROM s WHERE block IS NOT NULL QUALIFY row_number() OVER (PARTITION BY log_name, block ORDER BY line_no) <= 6),
k AS (SELECT *, coalesce(sum(CASE WHEN {_TIMED} OR regexp_matches(line, '{textscan.APPLICATION}') THEN 1 ELSE 0 END) OVER (PARTITION BY log_name, block ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM near)
SELECT log_name, min(line_no) AS line_no, CAST(max(nullif(regexp_extract(line, '{text.TOO_MANY}', 1), '')) AS BIGINT) AS total, {_SAYS.format(textscan.SQL_HASH, 1, "sql_hash")}, {_SAYS.format(text.PARSE_ERROR, 1, "code")}, {_SAYS.format(textscan.SQLID, 1, "sqlid")}, {_SAYS.format(textscan.USERNAME, 1, "username")}, {_SAYS.format(textscan.APPLICATION, 1, "application")}, {_SAYS.format(textscan.APPLICATION, 2, "action")}
FROM k WHERE ended = 0 AND NOT {_TIMED} GROUP BY log_name, block""")
def block_sessionize(spark, d):
    return textscan.parse_error_blocks(load(spark, d, "alert_lines")).withColumn("code", F.col("code").cast("string"))


@query(r"SELECT doc_id, t AS table_name FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\n\r\t]', ' ', 'g'), '--[^\n]*', ' ', 'g'), '/\*[\s\S]*?\*/', ' ', 'g'), '''[^'']*''', ' ', 'g'), '\s+', ' ', 'g')), '\b(?:FROM|JOIN|UPDATE|INTO|MERGE\s+INTO|DELETE(?:\s+FROM)?)\s+([A-Z_$#][A-Z0-9_$#]*(?:\.[A-Z_$#][A-Z0-9_$#]*)*)', 1), lambda x: NOT list_contains(string_split('" + " ".join(text.NO_TABLE) + r"', ' '), list_extract(string_split(x, '.'), -1)) AND NOT starts_with(x, 'SYS.') AND NOT starts_with(x, 'SYSTEM.') AND (contains(x, '.') OR length(x) > 1)))) AS t FROM documents WHERE regexp_matches(regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '" + text.STATEMENT + r"'))")
def table_name_extract(spark, d):
    own = spread(load(spark, d, "documents").select("doc_id", "text")).where(text.has_statement(F.col("text")))
    return own.select("doc_id", F.explode(text.tables(F.col("text"))).alias("table_name"))


@query("SELECT doc_id, CASE WHEN starts_with(upper(ltrim(text)), 'UPDATE') THEN 'UPDATE' WHEN starts_with(upper(ltrim(text)), 'DELETE') THEN 'DELETE' WHEN starts_with(upper(ltrim(text)), 'INSERT') THEN 'INSERT' WHEN starts_with(upper(ltrim(text)), 'MERGE') THEN 'MERGE' WHEN starts_with(upper(ltrim(text)), 'BEGIN') OR starts_with(upper(ltrim(text)), 'DECLARE') OR starts_with(upper(ltrim(text)), 'CALL') THEN 'PL/SQL' ELSE 'SELECT' END AS kind, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, substr(text, 1, 500) AS snippet, CAST(strlen(text) AS INTEGER) AS full_len FROM documents WHERE text ILIKE '%restart%'")
def search_text(spark, d):
    own = load(spark, d, "documents").where(tools.holds("text", "restart"))
    return own.select("doc_id", text.statement(F.col("text")).alias("kind"), text.token_estimate(F.col("text")).alias("tokens"), text.snippet(F.col("text")).alias("s")).select("doc_id", "kind", "tokens", "s.*")


_UNIT = "round(try_cast(regexp_replace(x, '[A-Za-z]+$', '') AS DOUBLE) * CASE regexp_extract(x, '([A-Za-z]+)$', 1) {cases} WHEN '' THEN 1 END, 6)"


@query("SELECT doc_id, " + _UNIT.format(cases="WHEN 'K' THEN 1 / 1024.0 WHEN 'M' THEN 1 WHEN 'G' THEN 1024 WHEN 'T' THEN 1048576") + " AS mb FROM (SELECT doc_id, n_chars || CASE doc_id % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'G' WHEN 3 THEN 'T' ELSE '' END AS x FROM documents)")
def size_suffix_to_mb(spark, d):
    own = load(spark, d, "documents")
    unit = F.element_at(F.array(*map(F.lit, ("K", "M", "G", "T", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return own.select("doc_id", F.round(text.size_mb(F.concat(F.col("n_chars").cast("string"), unit)), 6).alias("mb"))


@query("SELECT doc_id, " + _UNIT.format(cases="WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'g' THEN 1e9") + " AS n FROM (SELECT doc_id, n_chars || CASE doc_id % 4 WHEN 0 THEN 'k' WHEN 1 THEN 'm' WHEN 2 THEN 'g' ELSE '' END AS x FROM documents)")
def count_suffix(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("k", "m", "g", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", F.round(text.count(F.concat(F.col("n_chars").cast("string"), unit)), 6).alias("n"))


@query("SELECT doc_id, " + _UNIT.format(cases="WHEN 'us' THEN 1e-3 WHEN 'ms' THEN 1 WHEN 's' THEN 1e3 WHEN 'ns' THEN 1e-6") + " AS ms FROM (SELECT doc_id, n_chars || CASE doc_id % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'ms' WHEN 2 THEN 's' ELSE 'ns' END AS x FROM documents)")
def wait_suffix_to_ms(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("us", "ms", "s", "ns"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", text.wait_ms(F.concat(F.col("n_chars").cast("string"), unit)).alias("ms"))


@query("SELECT row_id, c AS code, CASE c WHEN 904 THEN 'invalid identifier' WHEN 942 THEN 'table or view does not exist' WHEN 6550 THEN 'PL/SQL compilation error' WHEN 1722 THEN 'invalid number' WHEN 1403 THEN 'no data found' WHEN 1008 THEN 'not all variables bound' WHEN 1036 THEN 'illegal variable name/number' ELSE '' END AS meaning, 'ORA-' || lpad(CAST(c AS VARCHAR), 5, '0') AS name FROM (SELECT row_id, CAST(regexp_extract(code, '(\\d+)$', 1) AS INTEGER) AS c FROM alertlog_event WHERE regexp_matches(code, '(?i)^ORA-\\d+$'))")
def ora_descriptions(spark, d):
    own = load(spark, d, "alertlog_event").where(F.col("code").rlike(r"(?i)^ORA-\d+$")).withColumn("c", F.regexp_extract("code", r"(\d+)$", 1).cast("int"))
    return own.select("row_id", F.col("c").alias("code"), text.ora_text(F.col("c")).alias("meaning"), text.ora_code(F.col("c").cast("string")).alias("name"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE props->>'$.k' IS NOT NULL")
def json_props(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k is not null")


# Lookups over collections


def reports(spark, d) -> DataFrame:
    """The collections of report_files in the declared shape; fields that drifted, ids among them, are null."""
    docs = load(spark, d, "report_files").select(F.from_json("payload", collection.SCHEMA).alias("d")).select("d.*")
    return collection.snapshots(docs)


_LONG = """every AS (SELECT CASE WHEN json_type(payload->'$.db_instance_information.db_id') LIKE '%BIGINT' THEN CAST(payload->>'$.db_instance_information.db_id' AS BIGINT) END AS db_id,
 CASE WHEN json_type(payload->'$.db_instance_information.instance_num') LIKE '%BIGINT' THEN CAST(payload->>'$.db_instance_information.instance_num' AS SMALLINT) END AS instance_num,
 CASE WHEN json_type(a->'$.snap_info.begin_snap_id') LIKE '%BIGINT' THEN CAST(a->>'$.snap_info.begin_snap_id' AS BIGINT) END AS snap_id, e->>'$.event' AS event,
 CASE WHEN json_type(e->'$.waits') LIKE '%BIGINT' THEN CAST(e->>'$.waits' AS BIGINT) END AS waits,
 CASE WHEN json_type(e->'$.total_wait_time_s') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(e->>'$.total_wait_time_s' AS DOUBLE) END AS total_wait_time_s,
 CASE WHEN json_type(e->'$.pct_dbtime') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(e->>'$.pct_dbtime' AS DOUBLE) END AS pct_dbtime, e->'$.waitevent_histogram_ms' AS h
 FROM (SELECT payload, a, unnest(CAST(a->'$.foreground_wait_events' AS JSON[])) AS e FROM (SELECT payload, unnest(CAST(payload->'$.awrs' AS JSON[])) AS a FROM report_files))),
long AS (SELECT * FROM every)"""


@query(f"WITH {_LONG} SELECT db_id, instance_num, snap_id, event, waits, total_wait_time_s, pct_dbtime FROM long WHERE lower(event) = 'db file sequential read' AND pct_dbtime >= 5")
def find_snapshots_with_event(spark, d):
    return tools.snapshots_with_event(reports(spark, d), " DB file sequential read", min_pct=5.0)


@query(f"WITH {_LONG} SELECT event, round(sum(total_wait_time_s), 4) AS time_s, CAST(sum(waits) AS BIGINT) AS waits FROM long GROUP BY ALL ORDER BY sum(total_wait_time_s) DESC, event LIMIT 10")
def load_summary(spark, d):
    return tools.database_load_summary(reports(spark, d))["events"].withColumn("time_s", F.round("time_s", 4))


@query(f"WITH {_LONG} SELECT db_id, instance_num, snap_id, event, k || '' AS bucket, round(CAST(json_extract_string(h, '$.\"' || k || '\"') AS DOUBLE), 3) AS pct, CAST(string_split(k, ':')[1] AS INTEGER) AS bucket_no, trim(string_split(k, ':')[-1]) AS label FROM (SELECT *, unnest(json_keys(h)) AS k FROM long WHERE json_type(h) = 'OBJECT')")
def histogram_explode(spark, d):
    return collection.histogram(reports(spark, d)).withColumn("pct", F.round(F.col("pct").cast("double"), 3))


@query(f"WITH {_LONG} SELECT DISTINCT 'foreground_wait_events' AS kind, event AS name FROM long WHERE event ILIKE '%latch%' AND (waits IS NOT NULL OR total_wait_time_s IS NOT NULL OR pct_dbtime IS NOT NULL)")
def list_metrics(spark, d):
    return tools.available_metrics(reports(spark, d), "foreground_wait_events", "LATCH")


@query(f"WITH {_LONG} SELECT db_id, instance_num, snap_id, event AS name, pct_dbtime AS value FROM long WHERE event = 'log file sync' AND pct_dbtime IS NOT NULL")
def metric_time_series(spark, d):
    return tools.metric_series(reports(spark, d), "foreground_wait_events", "log file sync", "pct_dbtime")


def _two(spark, d, side: str) -> DataFrame:
    own = views.waits(spark, d)
    edge = own.groupBy("db_id", "instance_num").agg((F.min if side == "a" else F.max)("snap_id").alias("edge"))
    return own.join(edge, ["db_id", "instance_num"]).where("snap_id = edge").select(F.concat_ws("/", "db_id", "instance_num", "name").alias("name"), "value")


_TWO = f"""a AS (SELECT concat_ws('/', {K}, name) AS name, value FROM waits JOIN (SELECT {K}, min(snap_id) AS snap_id FROM waits GROUP BY ALL) USING ({K}, snap_id)),
b AS (SELECT concat_ws('/', {K}, name) AS name, value FROM waits JOIN (SELECT {K}, max(snap_id) AS snap_id FROM waits GROUP BY ALL) USING ({K}, snap_id))"""
_DIFF = "SELECT name, round(coalesce(a.value, 0), 6) AS a_value, round(coalesce(b.value, 0), 6) AS b_value, round(coalesce(b.value, 0) - coalesce(a.value, 0), 6) AS delta_value FROM a {how} JOIN b USING (name) ORDER BY abs(coalesce(b.value, 0) - coalesce(a.value, 0)) DESC, name LIMIT 20"


@query(with_views("waits", _DIFF.format(how="FULL"), _TWO))
def compare_full_outer(spark, d):
    return r6(tools.compare(_two(spark, d, "a"), _two(spark, d, "b"), "name", ["value"], "full"), "a_value", "b_value", "delta_value")


@query(with_views("waits", _DIFF.format(how="RIGHT"), _TWO))
def compare_left(spark, d):
    return r6(tools.compare(_two(spark, d, "a"), _two(spark, d, "b"), "name", ["value"], "right"), "a_value", "b_value", "delta_value")


@query("SELECT n AS name, coalesce(CAST(v.capacity_tokens AS VARCHAR), '<not present>') AS value FROM (VALUES ('short_pack'), ('no_pack')) w(n) LEFT JOIN pack_sizes v ON v.pack_name = n")
def init_param_lookup(spark, d):
    parameters = load(spark, d, "pack_sizes").select(F.col("pack_name").alias("name"), F.col("capacity_tokens").cast("string").alias("value"))
    return tools.init_parameters(parameters, ["short_pack", "no_pack"])


@query("""WITH s AS (SELECT db_id, instance_num, begin_snap_id AS snap_id, max(loaded_at) AS moment FROM snap_info GROUP BY ALL), l AS (SELECT db_id, instance_num, max(loaded_at) - INTERVAL 3650 DAY AS started FROM snap_info GROUP BY ALL)
SELECT db_id, instance_num, begin_id, end_id, minutes FROM (SELECT db_id, instance_num, snap_id AS begin_id, lead(snap_id) OVER w AS end_id, (floor(epoch(lead(moment) OVER w)) - floor(epoch(moment))) / 60 AS minutes FROM s JOIN l USING (db_id, instance_num) WHERE moment >= started WINDOW w AS (PARTITION BY db_id, instance_num ORDER BY snap_id)) WHERE end_id IS NOT NULL AND minutes >= 30""")
def snapshot_pairs_since_start(spark, d):
    own = load(spark, d, "snap_info")
    snaps = own.groupBy("db_id", "instance_num", F.col("begin_snap_id").alias("snap_id")).agg(F.max("loaded_at").cast("timestamp").alias("at"))
    starts = own.groupBy("db_id", "instance_num").agg((F.max("loaded_at").cast("timestamp") - F.expr("INTERVAL 3650 DAY")).alias("started"))
    return attachments.report_pairs(snaps, starts)


@query()
def json_rows(spark, d):
    own = views.stats(spark, d)
    return own.select(*views.AT, F.to_json(F.struct("name", report.rounded_column(F.col("value"), own.schema["value"].dataType).alias("value"))).alias("json"))


@query(with_views("stats", "SELECT name, used FROM (SELECT name, CAST(sum(ceil(length(name) / 4)) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM (SELECT DISTINCT name FROM stats)) WHERE used <= 12"))
def budget_prefix(spark, d):
    names = views.stats(spark, d).select("name").distinct()
    return series.prefix_within(names, text.token_estimate(F.col("name")), 12, [F.col("name")])


@query(with_views("waits", f"SELECT {K}, name, n, round(least, 6) AS least, round(min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END), 6) AS lower, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END), 6) AS upper, round(most, 6) AS most, round(mean, 6) AS mean FROM waits JOIN q USING ({K}, name) GROUP BY {K}, name, n, least, q1, median, q3, most, mean", f"q AS (SELECT {K}, name, count(value) AS n, min(value) AS least, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS most, avg(value) AS mean FROM waits GROUP BY ALL)"))
def event_boxes(spark, d):
    return r6(summaries.box(views.waits(spark, d)), "least", "lower", "q1", "median", "q3", "upper", "most", "mean").drop("variance", "spread")


@query(with_views("waits", f"SELECT {K}, name, bin, count(*) AS n, min(value) AS least, max(value) AS most FROM (SELECT *, CASE WHEN hi > lo THEN least(CAST(floor((value - lo) / nullif((hi - lo) / 20, 0)) AS BIGINT), 19) ELSE 0 END AS bin FROM waits JOIN (SELECT {K}, name, min(value) AS lo, max(value) AS hi FROM waits GROUP BY ALL) USING ({K}, name)) GROUP BY ALL"))
def event_buckets(spark, d):
    return summaries.buckets(views.waits(spark, d))


@query("SELECT event AS sql_id, count(*) AS n, round(sum(total_wait_time_s), 4) AS elapsed, min(row_id) AS first_seen FROM wait_events WHERE total_wait_time_s IS NOT NULL GROUP BY ALL ORDER BY n DESC, sum(total_wait_time_s) DESC, first_seen, sql_id LIMIT 10")
def id_ranking(spark, d):
    rows = load(spark, d, "wait_events").where("total_wait_time_s is not null").select(F.col("event").alias("sql_id"), F.col("total_wait_time_s").alias("elapsed"), F.col("row_id").alias("place"))
    return summaries.rank_ids(rows).withColumn("elapsed", F.round("elapsed", 4))


@query("WITH f AS (SELECT DISTINCT event AS id, min(row_id) AS place, 0 AS l FROM wait_events WHERE wait_kind = 'foreground' GROUP BY ALL), b AS (SELECT DISTINCT event AS id, min(row_id) AS place, 1 AS l FROM wait_events WHERE wait_kind = 'background' GROUP BY ALL) SELECT DISTINCT id FROM (SELECT * FROM f UNION ALL SELECT * FROM b)")
def merged_ids(spark, d):
    rows = load(spark, d, "wait_events")
    of = lambda kind: rows.where(F.col("wait_kind") == kind).groupBy(F.col("event").alias("id")).agg(F.min("row_id").alias("place"))
    return summaries.merged_ids(of("foreground"), of("background"))


@query("SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, event AS sql_id, arg_min(wait_kind, {'s': begin_snap_id, 'm': wait_kind}) AS module FROM wait_events WHERE wait_kind IS NOT NULL GROUP BY ALL")
def first_modules(spark, d):
    rows = load(spark, d, "wait_events").select("db_id", F.col("instance_num").cast("bigint").alias("instance_num"), F.col("event").alias("sql_id"), F.col("wait_kind").alias("module"), F.col("begin_snap_id").alias("snap_id"))
    return summaries.modules(rows)


@query("SELECT event AS name, 'foreground' AS kind FROM (SELECT DISTINCT event FROM wait_events WHERE wait_kind = 'foreground') UNION ALL SELECT event, 'background' FROM (SELECT DISTINCT event FROM wait_events WHERE wait_kind = 'background' AND event NOT IN (SELECT event FROM wait_events WHERE wait_kind = 'foreground'))")
def stronger_list(spark, d):
    rows = load(spark, d, "wait_events").select(F.col("event").alias("name"), F.col("wait_kind").alias("kind")).distinct()
    return summaries.precedence(rows.where("kind = 'background'"), rows.where("kind = 'foreground'"), "name")


@query("SELECT DISTINCT stat_name AS name FROM load_profile WHERE lower(trim(stat_name)) IN ('" + "', '".join(n.replace("'", "''") for n in (*dims.COUNTERS, "user calls")) + "')")
def stat_group_filter(spark, d):
    return dims.of_group(load(spark, d, "load_profile").select(F.col("stat_name").alias("name")).distinct(), "counters")


@query(f"WITH {_LONG} SELECT db_id, instance_num, snap_id, waits, total_wait_time_s, pct_dbtime FROM long WHERE lower(event) = 'log file sync'")
def event_timeline(spark, d):
    return tools.event_timeline(reports(spark, d), "LOG FILE SYNC").drop("avg_wait")


@query(f"WITH {_LONG} SELECT event, waits FROM long WHERE snap_id = (SELECT min(snap_id) FROM long WHERE waits IS NOT NULL) AND waits IS NOT NULL ORDER BY waits DESC, event LIMIT 5")
def top_waits_in_snapshot(spark, d):
    own = collection.section(reports(spark, d), "foreground_wait_events").where("waits is not null")
    first = own.agg(F.min("snap_id").alias("snap_id"))
    return own.join(first, "snap_id", "left_semi").orderBy(F.col("waits").desc(), "event").limit(5).select("event", "waits")


@query("SELECT db_id, instance_num, snap_id, cpus, pct_user, pct_idle FROM (SELECT CASE WHEN json_type(payload->'$.db_instance_information.db_id') LIKE '%BIGINT' THEN CAST(payload->>'$.db_instance_information.db_id' AS BIGINT) END AS db_id, CASE WHEN json_type(payload->'$.db_instance_information.instance_num') LIKE '%BIGINT' THEN CAST(payload->>'$.db_instance_information.instance_num' AS SMALLINT) END AS instance_num, CASE WHEN json_type(a->'$.snap_info.begin_snap_id') LIKE '%BIGINT' THEN CAST(a->>'$.snap_info.begin_snap_id' AS BIGINT) END AS snap_id, CASE WHEN json_type(a->'$.host_cpu.cpus') LIKE '%BIGINT' THEN CAST(a->>'$.host_cpu.cpus' AS BIGINT) END AS cpus, CASE WHEN json_type(a->'$.host_cpu.pct_user') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(a->>'$.host_cpu.pct_user' AS DOUBLE) END AS pct_user, CASE WHEN json_type(a->'$.host_cpu.pct_idle') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(a->>'$.host_cpu.pct_idle' AS DOUBLE) END AS pct_idle FROM (SELECT payload, unnest(CAST(payload->'$.awrs' AS JSON[])) AS a FROM report_files))")
def host_cpu_section(spark, d):
    return collection.section(reports(spark, d), "host_cpu").select("db_id", "instance_num", "snap_id", "cpus", "pct_user", "pct_idle")
