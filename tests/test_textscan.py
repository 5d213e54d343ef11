from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from snapmill.functions import text
from snapmill.operators import textscan


def one(content):
    return textscan.readings("f", content)[-1]


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("%user %sys %wait %idle physc %entc lbusy app vcsw phint\n10.0 5.0 0.0 85.0 3.8 95.0 40.0 0.2 123 4", {"entc_pct": 95, "physc": 3.8, "cpu_user_pct": 10, "cpu_sys_pct": 5, "cpu_idle_pct": 85}),
        ("Entc%=92.5 physc=3.4 ent=4.0 idle=70.0", {"entc_pct": 92.5, "physc": 3.4, "entitled_capacity": 4.0, "cpu_busy_pct": 30}),
        ("r b avm us sy id wa pc ec\n1 0 99 31 42 28 0 8.93 89.3", {"cpu_user_pct": 31, "cpu_sys_pct": 42, "cpu_idle_pct": 28, "cpu_busy_pct": 72, "physc": 8.93, "entc_pct": 89.3}),
        ("LPAR,T,PhysicalCPU,virtualCPUs,entitled,CPU_user%,CPU_sys%,CPU_wait%,CPU_idle%\nLPAR,T0001,9.81,20,10,30,43,0,27", {"physc": 9.81, "entitled_capacity": 10, "entc_pct": 98.1, "cpu_user_pct": 30, "cpu_sys_pct": 43, "cpu_wait_pct": 0, "cpu_idle_pct": 27}),
        ("CPU User% Kern% Wait% Idle% Physc Entc%\n\x1b[1mTotal\x1b[0m 29.1 45.0 0.3 25.6 9.85 98.5292924", {"cpu_user_pct": 29.1, "cpu_sys_pct": 45.0, "physc": 9.85, "entc_pct": 98.5292924}),
    ],
)
def test_readings(content, want):
    got = one(content)
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_implausible_screen_line():
    assert textscan.readings("f", "Total 99 99 99 99 1 1") == []


def test_reading_stats(spark):
    files = spark.createDataFrame([("a", "Entc%=90 idle=10\nEntc%=99 idle=5"), ("b", None), ("c", "")], "path string, text string")
    found = textscan.aix_readings(files)
    assert [r.source_file for r in found.collect()] == ["a", "a"]
    assert {r.reading: (r.n, r.p95) for r in textscan.reading_stats(found).collect()}["entc_pct"] == (2, 99.0)


def test_times_slice_and_days(spark):
    lines = ["before", "2024-01-01T10:00:00.5+01:00", "x", "Tue Jan 02 11:00:00 2024", "ORA-00600 y", "z"]
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(lines)] + [("n", 0, "no time")], "log_name string, line_no bigint, line string")
    timed = textscan.with_times(df)
    t1, t2 = datetime(2024, 1, 1, 10), datetime(2024, 1, 2, 11)
    assert [r.logged_at for r in timed.where("log_name = 'l'").orderBy("line_no").collect()] == [None, t1, t1, t2, t2, t2]
    assert textscan.time_slice(timed, "2024-01-01 00:00:00", "2024-01-01 09:59:30").count() == 3
    events = textscan.alert_events(timed)
    assert rows(events.select("event", "logged_at")) == [("ORA-00600", t2)]
    assert textscan.between_days(events, "2024-01-03").count() == 0 and textscan.between_days(events, "2024-01-02", "2024-01-02").count() == 1
    with pytest.raises(ValueError):
        textscan.between_days(events, "2024-01-03", "2024-01-02")


def test_parse_error_blocks(spark):
    lines = ["WARNING: too many parse errors, count=700 SQL hash=0xab12", "PARSE ERROR: ospid=1, error=942 for statement:", "SELECT 1", "Additional information: sqlid=abc9", "...Current username=SCOTT", "...Application: sql tool Action: load it", "sqlid=late", "WARNING: too many parse errors, count=5", "2024-01-01T00:00:00Z", "PARSE ERROR: ospid=2, error=904 for"]
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(lines)], "log_name string, line_no bigint, line string")
    assert rows(textscan.parse_error_blocks(df)) == [("l", 0, 700, "0xab12", 942, "abc9", "SCOTT", "sql tool", "load it"), ("l", 7, 5, None, None, None, None, None, None)]


def test_parse_error_details(spark):
    from snapmill.operators import tools

    lines = ["WARNING: too many parse errors, count=3 SQL hash=0xff", "2024-01-01T00:00:00Z", "WARNING: too many parse errors, count=700 SQL hash=0xAB12", "PARSE ERROR: ospid=1, error=942 for statement:", "Additional information: sqlid=ABC9", "2024-01-03T00:00:00Z", "WARNING: too many parse errors, count=5"]
    df = spark.createDataFrame([("l", i * 10, x) for i, x in enumerate(lines)], "log_name string, line_no bigint, line string")
    got = [(r.line_no, str(r.logged_at), r.total, r.sql_hash, r.code, r.description, r.sqlid, r.username) for r in tools.parse_error_details(df).collect()]
    assert got == [(20, "2024-01-01 00:00:00", 700, "0xab12", "ORA-00942", "table or view does not exist", "abc9", "UNKNOWN"), (60, "2024-01-03 00:00:00", 5, "UNKNOWN", "UNKNOWN", "", "UNKNOWN", "UNKNOWN")]
    assert tools.parse_error_details(df, code="ora-00942").count() == 1 and tools.parse_error_details(df, first="2024-01-02").count() == 1


def test_six_lines_a_block_whatever_their_numbers(spark):
    lines = ["WARNING: too many parse errors, count=7", "a", "b", "c", "d", "sqlid=in6", "sqlid=late7"]
    for step in (1, 50):
        df = spark.createDataFrame([("l", i * step, x) for i, x in enumerate(lines)], "log_name string, line_no bigint, line string")
        assert [r.sqlid for r in textscan.parse_error_blocks(df).collect()] == ["in6"]


def test_text_functions(spark):
    df = spark.createDataFrame([("1,234.5", "1,5G", "12k", "250us", "a,b\"c", "../x")], "n string, s string, c string, w string, f string, p string")
    got = df.select(text.number(F.col("n")), text.size_mb(F.col("s")), text.count(F.col("c")), text.wait_ms(F.col("w")), text.csv_field(F.col("f")), text.safe_path(F.col("p")), text.safe_path(F.lit("host1/lparstat.out")), text.safe_path(F.lit("/tmp/x")), text.safe_id(F.lit("abc$")), text.without_thoughts(F.lit("<think>x</think>```sql\ny\n```"))).first()
    assert list(got) == [1234.5, 1536.0, 12000.0, 0.25, '"a,b""c"', False, True, False, False, "y"]


def test_table_names(spark):
    sql = "select * from a.b x join c$d on 1=1 where 'from no' = 1 /* from hidden */ and exists (select 1 from dual)\n-- from gone\nfrom late"
    assert spark.range(1).select(text.tables(F.lit(sql))).first()[0] == ["A.B", "C$D"]
