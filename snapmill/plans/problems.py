"""The queries pN_ of the core problems 1 to 7 and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmill.common import load, utc_text
from snapmill.operators import drift, instants, intervals, logentries, regular, rejects, spikes

ENTITY = ["db_id", "instance_num"]


def p1_parsed(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_records(load(spark, d, "raw_rows"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(p1_parsed(spark, d))


def p1_host_cpu(spark: SparkSession, d: str) -> DataFrame:
    return rejects.typed(p1_parsed(spark, d), "host_cpu")


def p1_wait_events(spark: SparkSession, d: str) -> DataFrame:
    return rejects.typed(p1_parsed(spark, d), "wait_events")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return rejects.reject_report(p1_parsed(spark, d))


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    return logentries.log_lines(load(spark, d, "alert_lines"), load(spark, d, "alertlog_parse_detail"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return logentries.entries(p2_lines(spark, d)).select("log_name", "first_line", "logged_at", "log_level", "component", "code")


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    lines = p2_lines(spark, d)
    return logentries.with_messages(lines, logentries.entries(lines)).drop("origin")


def p2_layouts(spark: SparkSession, d: str) -> DataFrame:
    layouts = logentries.mined_layouts(logentries.read(p2_lines(spark, d)))
    return layouts.groupBy("lead", "layout").agg(F.count(F.lit(1)).alias("sequences"), F.max("level_at").alias("level_at"), F.max("component_at").alias("component_at"))


def p3_instants(spark: SparkSession, d: str) -> DataFrame:
    instances = load(spark, d, "db_instance")
    return instants.to_utc(instants.time_fields(load(spark, d, "snap_info"), instances, load(spark, d, "alertlog_event")), instances)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_instants(spark, d).where("utc_time is not null").select("source_table", "row_id", "utc_time")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return p3_instants(spark, d).groupBy("source_table", "mask", "how").agg(F.count(F.lit(1)).alias("n"), F.count("utc_time").alias("readable"))


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(load(spark, d, "report_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    declared = p4_changes(spark, d).where(F.col("section").isin(*drift.DECLARED))
    return declared.select("file_id", F.concat_ws(".", "section", "field").alias("field_path"), "change_kind")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return drift.kinds_of(load(spark, d, "report_files"))


def p4_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return drift.unreadable(load(spark, d, "report_files"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.table(load(spark, d, "report_files"), drift.other_names(p4_changes(spark, d)))


def p4_failed_casts(spark: SparkSession, d: str) -> DataFrame:
    return p4_table(spark, d).select("file_id", "section", F.explode("failed").alias("failed"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals.periods_and_gaps(load(spark, d, "snap_info"), ENTITY, "begin_snap_id", "end_snap_id", "end_snap_time")
    return spans.select("db_id", F.col("instance_num").cast("bigint").alias("instance_num"), "span_kind", F.col("from_id").alias("from_snap_id"), F.col("to_id").alias("to_snap_id"), F.coalesce("ends_at", F.lit("-")).alias("ends_at"))


def p6_hours(spark: SparkSession, d: str) -> DataFrame:
    readings = regular.readings_at_ends(load(spark, d, "load_profile"), load(spark, d, "snap_info"))
    return regular.hourly_series(readings, [*ENTITY, "stat_name"], "read_at", "per_second", least=0.0)


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    return p6_hours(spark, d).where("status <> 'observed'")


def p6_series(spark: SparkSession, d: str) -> DataFrame:
    """The observed hours of the series; those between them are ``p6_filled``."""
    seen = p6_hours(spark, d).where("status = 'observed'")
    return seen.select(*ENTITY, "stat_name", F.to_utc_timestamp("hour_start", F.current_timezone()).cast("timestamp_ntz").alias("hour_start"), "n", F.round("value", 6).alias("value"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    missing = p6_hours(spark, d).where(F.col("status").isin("filled", "marked"))
    return missing.select(*ENTITY, "stat_name", utc_text("hour_start").alias("hour_start"))


def p7_faulty(spark: SparkSession, d: str) -> DataFrame:
    return spikes.faulty(*spikes.snapshot_readings(load(spark, d, "load_profile"), load(spark, d, "wait_events"), load(spark, d, "db_instance"), load(spark, d, "snap_info")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_faulty(spark, d).select("source_table", "field_name", "row_id")


def p7_impossible(spark: SparkSession, d: str) -> DataFrame:
    return p7_faulty(spark, d).where("why = 'impossible'").drop("why")


def p7_stuck(spark: SparkSession, d: str) -> DataFrame:
    return p7_faulty(spark, d).where("why = 'stuck'").drop("why")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return p7_faulty(spark, d).groupBy("source_table", "field_name", "why").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_host_cpu, p1_wait_events, p1_report, p2_found, p2_messages, p2_layouts, p3_found, p3_forms, p4_found, p4_kinds, p4_unreadable, p4_table, p4_failed_casts, p5_found, p6_found, p6_series, p6_filled, p7_found, p7_impossible, p7_stuck, p7_report)}

_CELL = '("([^"]|"")*"|[^",]*)'
_P1_CELLS = f"""
WITH split AS (
  SELECT row_id, file_name, section_name, coalesce(line, '') AS line,
    regexp_full_match(coalesce(line, ''), '{_CELL}(,{_CELL})*') AS quoted_well,
    CASE section_name WHEN 'host_cpu' THEN 11 WHEN 'wait_events' THEN 7 END AS wanted,
    list_transform(regexp_extract_all(',' || coalesce(line, ''), ',("([^"]|"")*"|[^",]*)', 1),
      lambda x: trim(CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END, ' \t')) AS c
  FROM raw_rows),
checked AS (
  SELECT *, quoted_well AND len(c) = wanted AS shaped,
    CASE section_name
      WHEN 'host_cpu' THEN
        list_bool_and(list_transform(c[1:5], lambda x: regexp_full_match(x, '[+]?[0-9]+') AND try_cast(x AS BIGINT) IS NOT NULL))
        AND list_bool_and(list_transform(c[6:7], lambda x: x = '' OR (regexp_full_match(x, '[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(try_cast(x AS DOUBLE)), false))))
        AND list_bool_and(list_transform(c[8:11], lambda x: regexp_full_match(x, '[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast(x AS DOUBLE) <= 100, false)))
      WHEN 'wait_events' THEN
        list_bool_and(list_transform(c[1:2], lambda x: regexp_full_match(x, '[+]?[0-9]+') AND try_cast(x AS BIGINT) IS NOT NULL))
        AND c[3] <> ''
        AND regexp_full_match(c[4], '[+]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)') AND try_cast(replace(c[4], ',', '') AS BIGINT) IS NOT NULL
        AND list_bool_and(list_transform(c[5:6], lambda x: regexp_full_match(x, '[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(try_cast(x AS DOUBLE)), false)))
        AND regexp_full_match(c[7], '[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(try_cast(c[7] AS DOUBLE) <= 100, false)
      END AS fits
  FROM split),
judged AS (
  SELECT row_id, file_name, section_name, c,
    CASE WHEN NOT quoted_well THEN 'quoting' WHEN NOT coalesce(shaped, false) THEN 'column_count' WHEN NOT coalesce(fits, false) THEN 'invalid_value' END AS reason
  FROM checked)
"""

_P7_READINGS = """
WITH cpu AS (SELECT db_id, instance_num, max(cpus) AS cpus FROM db_instance GROUP BY ALL),
r AS (
  SELECT 'load_profile' AS source_table, 'per_second' AS field_name, l.row_id, l.db_id, l.instance_num, l.stat_name AS source, l.begin_snap_id AS place, coalesce(l.end_snap_id, -1) AS tie, l.per_second AS v, CASE WHEN l.stat_name = 'DB CPU(s)' THEN cpu.cpus END AS high FROM load_profile l LEFT JOIN cpu USING (db_id, instance_num)
  UNION ALL SELECT 'wait_events', 'total_wait_time_s', row_id, db_id, instance_num, concat_ws('/', wait_kind, event), begin_snap_id, coalesce(end_snap_id, -1), total_wait_time_s, NULL FROM wait_events
  UNION ALL SELECT 'wait_events', 'pct_dbtime', row_id, db_id, instance_num, concat_ws('/', wait_kind, event), begin_snap_id, coalesce(end_snap_id, -1), pct_dbtime, 100 FROM wait_events),
used AS (SELECT *, coalesce(v < 0 OR v > high, false) AS bad, max(abs(v)) OVER (PARTITION BY source_table, field_name, db_id, instance_num, source) AS most FROM r WHERE v IS NOT NULL AND db_id IS NOT NULL AND instance_num IS NOT NULL AND place IS NOT NULL AND source IS NOT NULL AND source <> '')
"""

SQL = {
    "p1_found": _P1_CELLS + "SELECT row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_host_cpu": _P1_CELLS + """
SELECT row_id, file_name, CAST(c[1] AS BIGINT) AS db_id, CAST(c[2] AS BIGINT) AS begin_snap_id, CAST(c[3] AS BIGINT) AS cpus, CAST(c[4] AS BIGINT) AS cores, CAST(c[5] AS BIGINT) AS sockets,
  CAST(nullif(c[6], '') AS DOUBLE) AS load_avg_begin, CAST(nullif(c[7], '') AS DOUBLE) AS load_avg_end, CAST(c[8] AS DOUBLE) AS pct_user, CAST(c[9] AS DOUBLE) AS pct_system, CAST(c[10] AS DOUBLE) AS pct_wio, CAST(c[11] AS DOUBLE) AS pct_idle
FROM judged WHERE reason IS NULL AND section_name = 'host_cpu'""",
    "p1_wait_events": _P1_CELLS + """
SELECT row_id, file_name, CAST(c[1] AS BIGINT) AS db_id, CAST(c[2] AS BIGINT) AS begin_snap_id, c[3] AS event, CAST(replace(c[4], ',', '') AS BIGINT) AS waits, CAST(c[5] AS DOUBLE) AS total_wait_time_s, CAST(c[6] AS DOUBLE) AS avg_wait, CAST(c[7] AS DOUBLE) AS pct_dbtime
FROM judged WHERE reason IS NULL AND section_name = 'wait_events'""",
    "p1_report": _P1_CELLS + "SELECT file_name, section_name, coalesce(reason, 'ok') AS reason, count(*) AS n FROM judged GROUP BY ALL",
    "p4_unreadable": "SELECT file_id, CASE WHEN payload IS NULL THEN 'missing' WHEN NOT json_valid(payload) THEN 'no JSON' ELSE 'no object' END AS reason FROM report_files WHERE payload IS NULL OR NOT json_valid(payload) OR json_type(payload) <> 'OBJECT'",
    "p4_kinds": """
WITH doc AS (SELECT file_id, CAST(payload AS JSON) AS p FROM report_files WHERE json_valid(payload)),
item AS (SELECT file_id, unnest(CAST(p->'$.awrs' AS JSON[])) AS a FROM doc WHERE json_type(p->'$.awrs') = 'ARRAY'),
record AS (
  SELECT file_id, '$' AS section, p AS r FROM doc UNION ALL SELECT file_id, 'awrs', a FROM item
  UNION ALL SELECT file_id, 'db_instance_information', p->'$.db_instance_information' FROM doc UNION ALL SELECT file_id, 'awrs.snap_info', a->'$.snap_info' FROM item UNION ALL SELECT file_id, 'awrs.host_cpu', a->'$.host_cpu' FROM item
  UNION ALL SELECT file_id, 'awrs.foreground_wait_events', unnest(CAST(a->'$.foreground_wait_events' AS JSON[])) FROM item WHERE json_type(a->'$.foreground_wait_events') = 'ARRAY'),
field AS (SELECT file_id, section, r, unnest(json_keys(r)) AS field FROM record WHERE json_type(r) = 'OBJECT'),
kind AS (SELECT file_id, section, field, CASE json_type(r, '$."' || field || '"') WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'truth' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM field)
SELECT file_id, section, field, kind, count(*) AS n FROM kind WHERE kind IS NOT NULL GROUP BY ALL""",
    "p5_found": """
WITH r AS (
  SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, begin_snap_id AS b, end_snap_id AS e, max(end_snap_time) AS t
  FROM snap_info WHERE end_snap_id > begin_snap_id GROUP BY ALL),
m AS (SELECT *, max(e) OVER (PARTITION BY db_id, instance_num ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR b > before THEN 1 ELSE 0 END) OVER (PARTITION BY db_id, instance_num ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT db_id, instance_num, k, min(b) AS b, max(e) AS e, coalesce(max(t), '-') AS t FROM g GROUP BY ALL),
n AS (SELECT *, lead(b) OVER (PARTITION BY db_id, instance_num ORDER BY k) AS next_b FROM p)
SELECT db_id, instance_num, 'period' AS span_kind, b AS from_snap_id, e AS to_snap_id, t AS ends_at FROM n
UNION ALL SELECT db_id, instance_num, 'gap', e, next_b, t FROM n WHERE next_b IS NOT NULL""",
    "p7_impossible": _P7_READINGS + "SELECT source_table, field_name, row_id FROM used WHERE bad AND most <> 0",
    "p7_stuck": _P7_READINGS + """,
once AS (SELECT DISTINCT source_table, field_name, db_id, instance_num, source, place, tie, v FROM used WHERE most <> 0),
step AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS fresh FROM once WINDOW w AS (PARTITION BY source_table, field_name, db_id, instance_num, source ORDER BY place, tie, v)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY source_table, field_name, db_id, instance_num, source ORDER BY place, tie, v ROWS UNBOUNDED PRECEDING) AS k FROM step),
long AS (SELECT *, count(*) OVER (PARTITION BY source_table, field_name, db_id, instance_num, source, k) AS n FROM run)
SELECT u.source_table, u.field_name, u.row_id FROM used u JOIN long l ON u.source_table = l.source_table AND u.field_name = l.field_name AND u.db_id = l.db_id AND u.instance_num = l.instance_num AND u.source = l.source AND u.place = l.place AND u.tie = l.tie AND u.v = l.v
WHERE l.n >= 5 AND NOT u.bad""",
    "p6_series": """
WITH s AS (SELECT DISTINCT db_id, instance_num, begin_snap_id, end_snap_id, try_strptime(end_snap_time, '%Y-%m-%d %H:%M:%S') AS t FROM snap_info),
r AS (SELECT DISTINCT l.db_id, l.instance_num, l.stat_name, l.begin_snap_id, l.end_snap_id, l.per_second, s.t FROM load_profile l JOIN s USING (db_id, instance_num, begin_snap_id, end_snap_id) WHERE per_second IS NOT NULL AND s.t IS NOT NULL)
SELECT db_id, CAST(instance_num AS BIGINT) AS instance_num, stat_name, date_trunc('hour', t) AS hour_start, count(*) AS n, round(avg(per_second), 6) AS value FROM r GROUP BY ALL""",
    "p6_found": """
WITH s AS (SELECT DISTINCT db_id, CAST(instance_num AS BIGINT) AS instance_num, begin_snap_id, end_snap_id, date_trunc('hour', try_strptime(end_snap_time, '%Y-%m-%d %H:%M:%S')) AS h FROM snap_info),
r AS (SELECT DISTINCT l.db_id, s.instance_num, l.stat_name, s.h FROM load_profile l JOIN s ON l.db_id = s.db_id AND l.instance_num = s.instance_num AND l.begin_snap_id = s.begin_snap_id AND l.end_snap_id = s.end_snap_id WHERE l.per_second IS NOT NULL AND s.h IS NOT NULL),
e AS (SELECT db_id, instance_num, stat_name, min(h) AS a, max(h) AS z FROM r GROUP BY ALL),
f AS (SELECT db_id, instance_num, stat_name, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS h FROM e)
SELECT db_id, instance_num, stat_name, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_start FROM f ANTI JOIN r USING (db_id, instance_num, stat_name, h)""",
}
