"""Domains of a small collection of reports, from its JSON to the analyses."""

import json

import pytest
from pyspark.sql import functions as F

from snapmill.operators import domains, gradient
from snapmill.sources import collection


def report(i):
    late = i >= 30
    wave = 1.0 + (i * 7 % 5) / 10
    load = [{"stat_name": n, "per_second": v, "per_transaction": 0.0} for n, v in (("DB Time(s)", wave * (6 if late else 1)), ("DB CPU(s)", wave / 2), ("User calls", 10.0 + i), ("Redo size (bytes)", 2.0**20 * i), ("Physical read (blocks)", 128.0), ("Physical reads direct", 1.0))]
    sql = [{"sql_id": "slow1", "elapsed_time_s": wave * (50 if late else 5), "executions": 1, "sql_module": "app"}, {"sql_id": "even2", "elapsed_time_s": 3.0 + i % 2, "executions": 1, "sql_module": None}]
    return {
        "file_name": f"f{i}", "status": "OK", "snap_info": {"begin_snap_id": i, "end_snap_id": i + 1, "begin_snap_time": "t", "end_snap_time": "u"},
        "load_profile": load,
        "redo_log": {"stat_name": "log switches (derived)", "per_hour": 4.0},
        "time_model_stats": [{"stat_name": "parse time elapsed", "time_s": 1.0 if not late else 9.0, "pct_dbtime": 1.0}],
        "foreground_wait_events": [{"event": e, "waits": 5, "total_wait_time_s": v, "avg_wait": 1.0, "pct_dbtime": 2.0} for e, v in (("log file sync", wave * (8 if late else 1)), ("direct path read", 2.0 + i % 3))],
        "background_wait_events": [{"event": "log file parallel write", "waits": 5, "total_wait_time_s": 1.0 + i % 4 / 8 if i != 20 else 400.0, "avg_wait": 1.0, "pct_dbtime": 2.0}],
        "sql_elapsed_time": sql,
        "sql_cpu_time": {"slow1": {"sql_id": "slow1", "cpu_time_s": wave, "executions": 1}},
        "sql_io_time": {"io3": {"sql_id": "io3", "io_time_s": 1.0, "executions": 1}}, "sql_gets": {}, "sql_reads": {},
        "top_sql_with_top_events": {"slow1": {"sql_id": "slow1", "pct_activity": 40.0 + i % 2, "event_name": "direct path read", "pct_event": 1.0}},
        "instance_stats": [{"statname": n, "total": v} for n, v in (("user calls", 100 * (i + 1)), ("user commits", 10), ("user rollbacks", 10), ("redo size", 1000 + 17 * (i % 6)), ("physical reads", 50 + i % 9 if i != 25 else 9000), ("table fetch by rowid", 7))],
        "dictionary_cache": [{"statname": "dc_users", "get_requests": 10 + i % 3 if i != 15 else 5000, "final_usage": 1}],
        "library_cache": [{"statname": "BODY", "get_requests": 1, "get_pct_miss": 0.1, "pin_requests": 10 + i % 3 if i != 15 else 7000}],
        "latch_activity": [{"statname": "shared pool", "get_requests": 10 + i % 5 if i != 15 else 9000, "get_pct_miss": 0.1, "wait_time": 0.0}],
        "io_stats_byfunc": {}, "segment_stats": {}, "instance_efficiency": [], "wait_classes": [], "host_cpu": {"cpus": 4},
    }


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    doc = {"db_instance_information": {"db_id": 1, "instance_num": 1, "db_block_size": 8192}, "initialization_parameters": {}, "sql_text": {"slow1": "select * from app.orders o join app.lines l on 1=1", "text4": "x"}, "awrs": [report(i) for i in range(40)]}
    path = tmp_path_factory.mktemp("collection") / "c.json"
    path.write_text(json.dumps(doc))
    return collection.snapshots(collection.read_collections(spark, str(path))).cache()


@pytest.fixture(scope="module")
def metrics(reports):
    return collection.metrics(reports).cache()


def test_nine_domains(metrics):
    assert {r.domain for r in domains.series(metrics).select("domain").distinct().collect()} == set(domains.DOMAINS)
    found = {(r.domain, r.name, r.snap_id) for r in domains.found_anomalies(metrics).where("rank = 1").collect()}
    assert {("background", "log file parallel write", 20), ("instance_stats", "physical reads", 25), ("dictionary_cache", "dc_users", 15), ("library_cache", "BODY", 15), ("latch", "shared pool", 15)} <= found
    assert {d for d, _, _ in found} >= {"foreground", "sql", "load_profile"}
    assert domains.found_anomalies(metrics, dense=True).where("domain = 'latch'").first().snap_id == 15


def test_five_degrading_domains_and_promotion(metrics, spark):
    found = {(r.domain, r.name) for r in domains.degraded(metrics).collect()}
    assert {("foreground", "log file sync"), ("sql", "slow1"), ("time_model", "parse time elapsed"), ("load_profile", "DB Time(s)")} <= found
    assert not {d for d, _ in found} & {"instance_stats", "latch"} and ("sql", "even2") not in found
    modules = spark.createDataFrame([(1, 1, "slow1", "app")], "db_id bigint, instance_num smallint, sql_id string, module string")
    assert [(r.sql_id, r.module) for r in domains.promoted(metrics, modules).collect()] == [("slow1", "app")]


def test_tracked_statistics_and_gate(metrics, spark):
    sizes = spark.createDataFrame([(1, 1, 8192)], "db_id bigint, instance_num smallint, db_block_size int")
    gated = spark.createDataFrame([(1, 1)], "db_id bigint, instance_num smallint")
    got = {(r.label, r.snap_id): r.value for r in domains.tracked(metrics, sizes, gated).collect()}
    assert got["Redo MB/s", 3] == pytest.approx(3.0) and got["Physical Read MB/s", 3] == pytest.approx(1.0)
    assert got["User Calls (cum.)", 3] == 400 and got["Excessive Commits", 3] == 20 and got["Redo Log Switches/h", 3] == 4 and got["User Calls/s", 3] == 13
    closed = {r.label for r in domains.tracked(metrics, sizes, gated.limit(0)).collect()}
    assert closed == {label for label, *_, gate in domains.TRACKED if not gate and (label, 3) in got}
    assert len(domains.TRACKED) + 1 == 24


def test_gradient_sections(metrics):
    rows = domains.gradient_sections(metrics, "WAIT=log file sync")
    names = {}
    for r in rows.select("section", "name").distinct().collect():
        names.setdefault(r.section, set()).add(r.name)
    assert names["fg_wait_events"] == {"log file sync", "direct path read"} and names["wait_event_for_sql_or_event"] == {"direct path read"}
    assert names["instance_stats_volumes"] == {"redo size"} and names["sql_elapsed_time"] == {"slow1", "even2"} and names["cpu_sql_cpu_time"] == {"slow1"}
    assert len(names["instance_stats_for_sql_or_event"]) == 6
    fitted = gradient.fit(rows, keys=("db_id", "instance_num", "section"))
    best = {r.section: r for r in fitted.where("name in ('log file sync', 'slow1')").collect()}
    assert best["fg_wait_events"].ridge > 0 and best["sql_elapsed_time"].ridge > 0
    assert gradient.skipped(rows.where("snap_id < 3"), ("db_id", "instance_num", "section")).where("note = 'fewer than 3 differences'").count() == len(names)
    with pytest.raises(ValueError):
        domains.gradient_sections(metrics, "TABLE=x")


def test_statements_and_their_tables(metrics, reports, spark):
    texts = spark.createDataFrame([("slow1", "select * from app.orders o join app.lines l on 1=1"), ("text4", "x")], "sql_id string, text string")
    assert {r.sql_id for r in domains.sql_ids(reports, texts).collect()} == {"slow1", "even2", "io3", "text4"}
    chosen = spark.createDataFrame([(1, 1, "slow1"), (1, 1, "even2")], "db_id bigint, instance_num smallint, sql_id string")
    modules = spark.createDataFrame([(1, 1, "slow1", "app")], "db_id bigint, instance_num smallint, sql_id string, module string")
    activity = collection.section(reports, "top_sql_with_top_events").groupBy("db_id", "instance_num", "sql_id", "event_name").agg(F.avg("pct_activity").alias("mean"))
    top = domains.top_sqls(metrics, chosen, modules, activity, domains.picked(metrics, "foreground_wait_events", "total_wait_time_s"))
    got = {r.sql_id: r for r in top.collect()}
    assert got["slow1"].in_cpu == 100 and got["slow1"].in_io == 0 and got["slow1"].module == "app" and got["slow1"].r > 0.9
    assert got["slow1"].session_events == [("direct path read", 40.5)] and [e.event_name for e in got["slow1"].strong_events] == ["log file sync"]
    tables = {r.event_name: r.tables for r in domains.event_tables(top, texts).collect()}
    assert tables == {"direct path read": ["APP.LINES", "APP.ORDERS"], "log file sync": ["APP.LINES", "APP.ORDERS"]}


def test_small_rules(spark):
    files = spark.createDataFrame([("b", 5), ("a", 5), ("c", 1)], "path string, length bigint")
    assert domains.largest_file(files).first().path == "a"
    rows = spark.createDataFrame([(1, 1, n, v, "d", [("x", "long")]) for n, v in (("p", 3.0), ("q", None), ("r", 9.0), ("a", 3.0))], "db_id bigint, instance_num int, name string, value double, description string, items array<struct<name:string,description:string>>")
    assert {r.name for r in domains.trimmed(rows, "value", 2).collect()} == {"r", "a"}
    assert domains.without_descriptions(rows).schema.simpleString().count("description") == 0
