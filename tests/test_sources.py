import json

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from snapmill.common import load
from snapmill.operators import report, tools
from snapmill.plans import reference
from snapmill.sources import attachments, collection, datasource, reports
from snapmill.streaming import alerts

S = "This table displays "


def table(summary, *data, head=()):
    cells = lambda r, t: "".join(f"<{t}>{c}</{t}>" for c in r)
    return f'<table summary="{S}{summary}"><tr>{cells(head, "th")}</tr>' + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in data) + "</table>"


SEVEN = ("WAITS", "1,234", "0", "56.7", "2.5ms", "1", "12.5")
HTML = "<html>" + "".join([
    table("database instance information", ("ORCL", "42", "orcl", "1", "01-Jan-24 00:00", "19.3.0.0.0", "NO"), head=("DB Name", "DB Id", "Instance", "Inst num", "Startup Time", "Release", "RAC")),
    table("snapshot information", ("Begin Snap:", "11", "02-Jan-24 10:00:00", "1", "2"), ("End Snap:", "12", "02-Jan-24 11:00:00", "1", "2")),
    table("load profile", ("DB Time(s):", "1,002.5", "0.1", "", ""), ("too", "short")),
    table("instance efficiency percentages", ("Buffer Hit %:", "99.5", "Soft Parse %:", "-1")),
    table("system load statistics", ("8", "4", "2", "1.5", "2.5", "10", "20", "3", "67")),
    table("different time model statistics.", ("DB time", "3,600.5", "100"), ("DB CPU", "1,200", "33.3")),
    table("Foreground Wait Events and their wait statistics", ("db file sequential read", *SEVEN[1:]), ("SQL*Net message from client", *SEVEN[1:])),
    table("background wait events statistics", ("log file parallel write", "5", "0", "1", "200us", "1", "0.5")),
    table("total number of waits, and information about total wait time, for each wait event", ("db file sequential read", "9", "1", "2", "3", "4", "5", "6", "7", "8"), head=("Event", "Total", "<1ms", "<2ms", "<4ms", "<8ms", "<16ms", "<32ms", "<=1s", ">1s")),
    table("top SQL by elapsed time", ("10.5", "2", "5.25", "50", "40", "10", "abc1", "mod", "update t set x=1")),
    table("top SQL by CPU time", ("7", "2", "3.5", "50", "", "40", "10", "abc1", "mod", "x"), ("8", "2", "3.5", "50", "", "40", "10", "abc1", "other", "x")),
    table("Instance activity statistics.", ("user commits", "-5", "1", "1"), ("user calls", "1,000", "1", "1")),
    table("the IO Statistics for different functions.", ("Buffer Cache Re", "1.5G", "2k", "10M", "0M", "3", "0M", "4k", "250us"), ("LGWR", "1M", "1", "1M", "1M", "1", "1M", "1", ""), ("TOTAL:", *["1"] * 8)),
    table("thread activity stats in the instance.", ("log switches (derived)", "4", "2.5")),
    table("dictionary cache statistics.", ("dc_users", "100", "1", "1", "1", "1", "55")),
    table("library cache statistics.", ("BODY", "10", "1.5", "20", "1", "1", "1")),
    table("latch statistics.", ("cache buffers chains", "1,000", "0.5", "1", "2.5", "1", "1")),
    table("top segments by logical reads. Owner,", ("own", "ts", "TAB1", "", "TABLE", "7", "8", "900", "10")),
    table("top segments by physical reads. Owner,", ("own", "ts", "TAB2", "", "TABLE", "500", "1")),
    table("the Top SQL by Top Wait Events", ("abc1", "99", "3", "12.5", "db file sequential read", "10", "TABLE ACCESS", "9", "x")),
    table("the text of the SQL", ("abc1", "update t set x=1")),
    table("name and value of init.ora parameters", ("cpu_count", "8", "16"), ("sga_target", "1G", "")),
]) + "</html>"


def padded(*parts):
    """Texts at places of a line."""
    line = ""
    for place, item in parts:
        line = line.ljust(place) + item
    return line


TEXT = "\n".join([
    "Database    DB Id    Instance     Inst Num  Startup Time   Release     RAC", "~~~~~~~~ ----------- ------------ -------- --------------- ----------- ---", "           77777777 orcl                1 01-Jan-24 09:00 19.3.0.0.0  NO", "Host Name: h   Num CPUs: 8   Std Block Size:         16K",
    "\x0cSnapshot       Snap Id     Snap Time", "~~~~", "Begin Snap:         21 03-Jan-24 10:00:00        5", "  End Snap:         22 03-Jan-24 11:00:00        5", "Cache Sizes",
    "Load Profile", "      DB time(s):        1,234.5        0.5", "Instance Efficiency", "  Buffer Nowait %:  100.00  Redo NoWait %: -1.0", "Top ADDM Findings",
    "\x0cHost CPU", "  1.5   2.5  10.0  20.0  67.0   3.0", "Instance CPU",
    "\x0cForeground Wait Events", padded((0, "db file sequential read"), (29, "1,234"), (46, "56"), (57, "2.5ms"), (73, "12.5")), "\x0cBackground Wait Events", padded((0, "smon timer"), (29, "9"), (46, "9"), (57, "1"), (73, "1.0  ")),
    "Wait Event Histogram", padded((0, "db file sequential read"), (33, "10.5"), (39, "89.5"), (75, "0")),
    "Time Model System Stats", padded((0, "DB time"), (35, "3,600.5"), (56, "100.0")), padded((0, "junk line that is long enough to pass the test"), (60, "x")),
    "Instance Activity Stats", padded((0, "user calls"), (35, "1,000")), padded((0, "wrapped"), (35, "-7")),
    "Dictionary Cache Stats", padded((0, "dc_users"), (26, "100"), (69, "55")), "Library Cache Activity", "BODY", "        10    1.5      20", "Latch Activity", padded((0, "cache buffers chains"), (25, "1,000"), (40, "0.5"), (54, "2.5"), (72, "1")),
    "SQL ordered by Elapsed", "10.5 2 5.25 50.0 7.0 900 abc1", "Module: my module", "SQL ordered by Reads", "500 2 250 50.0 7.0 9 abc1", "  nothing",
    "\x0cinit.ora Parameters", padded((0, "cpu_count"), (30, "8"), (64, "16")), padded((0, "long"), (30, "part1")), padded((30, "part2")), "End of Report", "log switches (derived)   4   2.5",
])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("reports")
    (path / "a.html").write_text(HTML)
    (path / "b.txt").write_text(TEXT)
    (path / "broken.html").write_text("<html><table summary='x'><tr><td>")
    (path / ".hidden.html").write_text(HTML)
    (path / "other.log").write_text("x")
    return str(path)


def test_html(spark, folder):
    read = reports.read_reports(spark, folder).where("file_name = 'a.html'").cache()
    own = reports.snapshots_of(read)
    assert rows(own.select("db_id", "snap_id", "end_id", "begins")) == [(42, 11, 12, "02-Jan-24 10:00:00")]
    of = lambda s, *c: rows(collection.section(own, s).select(*c))
    assert of("load_profile", "stat_name", "per_second") == [("DB Time(s)", 1002.5)]
    assert of("instance_efficiency", "eff_stat", "eff_pct") == [("Buffer Hit %", 99.5), ("Soft Parse %", None)]
    assert of("host_cpu", "cpus", "pct_wio", "pct_idle") == [(8, 3.0, 67.0)]
    assert of("foreground_wait_events", "event", "waits", "total_wait_time_s", "avg_wait") == [("db file sequential read", 1234, 56.7, 2.5)]
    assert of("background_wait_events", "avg_wait") == [(0.2,)]
    assert rows(collection.histogram(own).select("bucket_no", "label", "pct")) == [(i, x, float(i + 1)) for i, x in enumerate(("<1ms", "<2ms", "<4ms", "<8ms", "<16ms", "<32ms", "<=1s", ">1s"))]
    assert of("sql_elapsed_time", "sql_id", "sql_type") == [("abc1", "UPDATE")]
    assert of("sql_cpu_time", "cpu_time_s", "sql_module") == [(7.0, "mod")]
    assert of("instance_stats", "statname", "total") == [("user calls", 1000), ("user commits", 0)]
    assert of("io_stats_byfunc", "category", "reads_data", "reads_req_s", "avg_time") == [("Buffer Cache Reads", 1536.0, 2000.0, 0.25), ("LGWR", 1.0, 1.0, None)]
    assert of("segment_stats", "category", "object_name", "obj", "stat_vlalue") == [("logical reads", "TAB1", 7, 900.0), ("physical reads", "TAB2", 0, 500.0)]
    assert of("top_sql_with_top_events", "sql_id", "pct_activity") == [("abc1", 12.5)]
    assert of("redo_log", "per_hour") == [(2.5,)] and of("latch_activity", "wait_time") == [(2.5,)] and of("dictionary_cache", "final_usage") == [(55,)] and of("library_cache", "pin_requests") == [(20,)]
    assert rows(read.select("sql_text", "parameters")) == [({"abc1": "update t set x=1"}, {"cpu_count": "16", "sga_target": "1G"})]
    assert rows(collection.section(collection.masked(own, 0), "segment_stats").select("object_name").distinct()) == [("#",)]
    assert {r.field for r in collection.metrics(own).where("kind = 'latch_activity'").collect()} == {"get_requests", "get_pct_miss", "wait_time"}
    read.unpersist()


def test_text(spark, folder):
    own = reports.snapshots_of(reports.read_reports(spark, folder).where("file_name = 'b.txt'"))
    of = lambda s, *c: rows(collection.section(own, s).select(*c))
    info = reports.read_reports(spark, folder).where("file_name = 'b.txt'").select("instance.*").first()
    assert (info.db_id, info.instance_num, info.release, info.cpus, info.db_block_size) == (77777777, 1, "19.3.0.0.0", 8, 16384)
    assert rows(own.select("snap_id", "end_id", "ends")) == [(21, 22, "03-Jan-24 11:00:00")]
    assert of("load_profile", "stat_name", "per_second") == [("DB time(s)", 1234.5)]
    assert of("instance_efficiency", "eff_pct") == [(100.0,), (None,)]
    assert of("host_cpu", "pct_idle", "pct_wio") == [(67.0, 3.0)]
    assert of("foreground_wait_events", "event", "waits", "avg_wait", "pct_dbtime") == [("db file sequential read", 1234, 2.5, 12.5)] and of("background_wait_events", "event") == []
    assert rows(collection.histogram(own).where("pct > 0").select("bucket", "pct")) == [("1: <1ms", 10.5), ("2: <2ms", 89.5)]
    assert of("time_model_stats", "stat_name", "time_s") == [("DB time", 3600.5)]
    assert of("instance_stats", "statname") == [("user calls",)] and of("dictionary_cache", "final_usage") == [(55,)] and of("library_cache", "statname", "pin_requests") == [("BODY", 20)] and of("latch_activity", "wait_time") == [(2.5,)]
    assert of("sql_elapsed_time", "sql_id", "sql_module", "pct_cpu") == [("abc1", "my module", -1.0)] and of("sql_reads", "physical_reads", "cpu_time_pct", "pct_io") == [(500.0, 7.0, -1.0)]
    assert rows(reports.read_reports(spark, folder).where("file_name = 'b.txt'").select("parameters")) == [({"cpu_count": "16", "long": "part1part2"},)]


def test_folder_reads(spark, folder, tmp_path):
    assert reports.read_reports(spark, folder).count() == 3
    datasource.register(spark)
    assert rows(spark.read.format("snapreport").load(folder).select("file_name", "begin_snap_id")) == [("a.html", 11), ("b.txt", 21), ("broken.html", None)]
    kept = []
    alerts.stream_reports(spark, folder, str(tmp_path / "c"), lambda df, i: kept.append(df.count())).awaitTermination()
    assert sum(kept) == 3


def test_negative_counters_are_zero(spark, tmp_path):
    doc = {"db_instance_information": {"db_id": 1, "instance_num": 1}, "awrs": [{"snap_info": {"begin_snap_id": 1, "end_snap_id": 2}, "library_cache": [{"statname": "BODY", "pin_requests": -4254126895, "get_pct_miss": -1.5}], "instance_stats": [{"statname": "x", "total": -1}]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    own = collection.snapshots(collection.read_collections(spark, str(tmp_path / "c.json")))
    assert rows(collection.section(own, "library_cache").select("pin_requests", "get_pct_miss")) == [(0, -1.5)]
    assert rows(collection.section(own, "instance_stats").select("total")) == [(0,)]


def test_attachments(spark, tmp_path):
    (tmp_path / "AIX").mkdir()
    (tmp_path / "AIX" / "lparstat.out").write_text("Entc%=99 idle=10")
    (tmp_path / "abc1.xplan").write_text("plan " * 3)
    assert rows(attachments.plans(spark, str(tmp_path)).select("sql_id", "truncated")) == [("abc1", False)]
    files = attachments.os_files(spark, str(tmp_path / "AIX"), most_bytes=8)
    assert rows(files.select("path", "text", "truncated")) == [("lparstat.out", "Entc%=99", True)]
    assert tools.cpu_entitlement(attachments.os_files(spark, str(tmp_path / "AIX"))).first().assessment == "confirmed"
    mapping = spark.createDataFrame([("e", '[{"action":"read","url":"u"}]'), ("f", "[]")], "entity string, links string")
    assert rows(attachments.links(mapping, spark.createDataFrame([("e",)], "name string"))) == [("e", "read", "u")]


def test_entitlement_of_whole_files(spark, tmp_path):
    (tmp_path / "lparstat.out").write_text("Entc%=10 idle=90\n" * 6000 + "Entc%=99 idle=1\n")
    files = attachments.os_texts(spark, str(tmp_path))
    assert rows(files.select("path", "truncated")) == [("lparstat.out", False)]
    found = tools.cpu_entitlement(files).first()
    assert (found.most, found.assessment) == (99.0, "confirmed")


def test_tools(spark, folder):
    own = reports.snapshots_of(reports.read_reports(spark, folder)).cache()
    head = tools.list_snapshots(own.where("snap_id = 11")).first()
    assert (head.db_time_s, head.db_cpu_s, head.top_event) == (3600.5, 1200.0, "db file sequential read")
    assert tools.sql_timeline(own, "abc1").where("snap_id = 11").first().asDict()["elapsed"] == 10.5
    assert tools.sqls_by_module(own, "MOD").count() == 1
    assert tools.top_sqls(own, 11, "cpu").count() == 1 and tools.top_segments(own, 11, "Logical Reads").count() == 1 and tools.top_latches(own, 11).count() == 1 and tools.top_wait_events(own, 11, by="waits").count() == 1
    assert tools.event_histogram(own, 11, "DB file sequential read").count() == 8
    assert tools.snapshot_details(own, 11, ["host_cpu", "nothing"]).columns == ["db_id", "instance_num", "snap_id", "end_id", "host_cpu"]
    assert {k: v.count() for k, v in tools.compare_snapshots(own, 11, 21).items()} == {"load": 1, "waits": 1, "sqls": 1, "latches": 1}
    totals = tools.database_load_summary(own)["totals"].first()
    assert (totals.snapshots, totals.db_time_s, round(totals.cpu_ratio, 6)) == (own.count(), 7201.0, round(1200 / 7201, 6))
    assert tools.call("nothing") == {"error": "unknown: 'nothing'"} and "error" in tools.call("get_sql_text")
    assert len(tools.TOOLS) >= 29
    own.unpersist()


def test_lookup_queries_agree_with_tools(spark):
    d = f"{DATA}/sf0.001"
    assert tools.snapshot_summary(reference.reports(spark, d), -1)["header"].count() == 0


def test_report_texts(spark):
    nested = {"float": 23.54664676448, "integer": 23, "text": "23.54664676448", "nested": [{"negative_zero": -0.0001}]}
    got = report.rounded(nested)
    assert got == {"float": 23.547, "integer": 23, "text": "23.54664676448", "nested": [{"negative_zero": 0.0}]} and str(got["nested"][0]["negative_zero"]) == "0.0"
    assert report.compact({"a": [{"x": 1, "y": "p,q"}, {"x": 2, "y": "r"}], "b": [1, 2], "c": {"d": None}}) == 'a[2]{x,y}:\n  1,"p,q"\n  2,r\nb[2]: 1,2\nc:\n  d: null'
    assert report.fitting(["x" * 400] * 10, 300) == 3 and report.fitting(["x"], 100) == 0
    assert [len(x) for x in report.shortened(["a" * 9000, "b" * 10], 600)] == [2048, 10]
    df = spark.createDataFrame([(1.23456, [1.0006], {"k": -0.0001})], "a double, b array<double>, c map<string,double>")
    assert report.as_json(df).first()[0] == '{"a":1.235,"b":[1.001],"c":{"k":0.0}}'


def test_stream_of_alerts(spark, tmp_path):
    lines = spark.createDataFrame([("ORA-00600 x", "2024-01-01 10:10:00"), ("ORA-00600 y", "2024-01-01 10:50:00"), ("fine", "2024-01-01 10:50:00")], "line string, t string")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")).withColumn("logged_at", F.col("t").cast("timestamp"))
    q = alerts.hourly_events(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("hourly").select("event", "n")) == [("ORA-00600", 2)]


def test_csv_sinks(spark, tmp_path):
    from snapmill.operators import anomalies

    found = spark.createDataFrame([(1, 1, 5, "waits", 'a "b", c', 9.5)], "db_id bigint, instance_num bigint, snap_id bigint, domain string, name string, score double")
    anomalies.write_csv(found, str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out/snapshots")).first().summary == 'waits a "b", c 9.50'
    assert load(spark, f"{DATA}/sf0.001", "pack_sizes").count() == 2


def test_statement_texts_over_pages():
    """The text of a statement goes on after the head of the next page; the longest text of an id counts."""
    lines = [
        "SQL ordered by CPU  DB/Inst: X/x  Snaps: 1-2", "-> Resources", "  CPU   Old", "---------- ----",
        "      10.5      3       3.5    1.0    11.2    5,000  1234567890", "Module: app", "SELECT a,", "  b", "", "\x0cSQL ordered by CPU  DB/Inst: X/x  Snaps: 1-2", "-> again", "FROM t",
        "       5.0      1       5.0    1.0     5.2      100  abc9def01", "noise", "begin null; end;", "       5.0      1       5.0    1.0     5.2      100  abc9def01", "begin; end",
        "       1.0      1       5.0    1.0     5.2      100  nothing99", "Module: x",
    ]
    assert reports.statement_texts([x.lstrip("\x0c") for x in lines]) == {"1234567890": "SELECT a,\nb\nFROM t", "abc9def01": "begin null; end;"}
