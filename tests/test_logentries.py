from datetime import datetime

import brute_logs
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from snapmill.common import load
from snapmill.operators import logentries
from snapmill.plans.problems import p2_found, p2_lines

TYPES = "origin string, log_name string, line_no bigint, line string, closed_at timestamp"


def entries(spark, lines, closed=datetime(2024, 1, 10), **kwargs):
    df = spark.createDataFrame([("o", "l", i + 1, x, closed) for i, x in enumerate(lines)], TYPES)
    return sorted((r.first_line, r.logged_at, r.log_level, r.component, r.code) for r in logentries.entries(df, **kwargs).collect())


@pytest.mark.parametrize(("sf", "block"), [("sf0.001", None), ("sf0.01", None), ("sf0.001", 3), ("sf0.01", 16)])
def test_same_as_listed_layouts(spark, sf, block):
    d = f"{DATA}/{sf}"
    found = logentries.entries(p2_lines(spark, d), block).select("log_name", "first_line", "logged_at", "log_level", "component", "code") if block else p2_found(spark, d)
    got = sorted(tuple(r) for r in found.collect())
    logs, want = {}, []
    for r in load(spark, d, "alert_lines").orderBy("log_name", "line_no").collect():
        logs.setdefault(r.log_name, []).append((r.line_no, r.line, r.closed_at))
    for name, rows in logs.items():
        want += brute_logs.entries(name, rows)
    for r in load(spark, d, "alertlog_parse_detail").collect():
        want += brute_logs.entries(r.log_name, [(r.start_line + i, x, None) for i, x in enumerate(r["sample"].split("\n"))])
    assert got == sorted(want)


def test_messages_cover_all_lines(spark):
    d = f"{DATA}/sf0.001"
    lines = p2_lines(spark, d)
    found = logentries.entries(lines)
    whole = logentries.with_messages(lines, found)
    assert whole.count() == found.count()
    inside = whole.agg(F.sum(F.size(F.split("message", "\n")))).first()[0]
    assert inside == found.agg(F.sum(F.col("last_line") - F.col("first_line") + 1)).first()[0]


def test_years_and_gaps(spark):
    lines = ["ORA-1: no entry yet", "Dec 31 23:59:59 h prog[1]: WARN: old", "Jan 10 12:00:00 h prog[1]: ERR: ora-60 x", "Jan 12 00:00:00 h prog[1]: INFO: last year"]
    assert entries(spark, lines) == [(2, "2023-12-31 23:59:59", "WARN", "prog", "-"), (3, "2024-01-10 12:00:00", "ERROR", "prog", "ORA-00060"), (4, "2023-01-12 00:00:00", "INFO", "prog", "-")]
    assert entries(spark, lines, closed=None) == []


def test_json_over_lines(spark):
    lines = ["{", '  "lvl": "Warn",', '  "logger": "a.b",', '  "ts": "2024-01-02T03:04:05Z"', "}", "tail ORA-00942", "{", '  "no": "time"', "}", '{"ts": "2024-01-02T03:04:06+01:00", "lvl": "ERR", "logger": "c", "msg": "TNS-12535"}']
    want = [(1, "2024-01-02 03:04:05", "WARN", "a.b", "ORA-00942"), (10, "2024-01-02 03:04:06", "ERROR", "c", "TNS-12535")]
    for block in (4096, 2, 3, 5):
        assert entries(spark, lines, block=block) == want


def test_blocks_and_edges(spark):
    lines = ["2024-01-01T00:00:00+01:00", "WARNING: too many", "x" * 100_000, "", None, "  2024-01-01T00:00:01 indented", "> 2024-01-01 00:00:02 ERROR [q] quoted", "2024-13-01T00:00:00", "2024-01-01T00:00:05Z"]
    want = [(1, "2024-01-01 00:00:00", "WARN", "-", "-"), (9, "2024-01-01 00:00:05", "-", "-", "-")]
    for block in (4096, 1, 2, 4):
        assert entries(spark, lines, block=block) == want
    df = spark.createDataFrame([("o", None, 1, "2024-01-01T00:00:00Z", None), ("o", None, 1, "2024-01-01T00:00:00Z", None), (None, "l", 1, "2024-01-01T00:00:00Z", None), ("o", "l", None, "2024-01-01T00:00:00Z", None)], TYPES)
    clash = df.withColumn("code", F.lit(1)).withColumn("entry", F.lit(2)).withColumn("kind", F.lit("x"))
    assert logentries.entries(clash).count() == 2
    assert logentries.entries(df.limit(0)).count() == 0


def test_many_copies_of_a_line(spark):
    lines = ["2024-01-01T00:00:00Z", "ERROR: x ORA-1", "2024-01-01T00:00:05Z"]
    df = spark.createDataFrame([("o", "l", i + 1, x, None) for i, x in enumerate(lines) for _ in range(5000)], TYPES)
    assert sorted(tuple(r)[2:] for r in logentries.entries(df).collect()) == [(1, 2, "2024-01-01 00:00:00", "ERROR", "-", "ORA-00001"), (3, 3, "2024-01-01 00:00:05", "-", "-", "-")]


def test_merge_of_templates():
    a = "t L [ w ] w w".split()
    t = logentries.merge(a, "t L [ w ] w n w".split())
    assert t == ["t", "L", "[", "w", "]", "w", "<*>", "w"]
    assert logentries.merge(t, "t L [ w ] n w".split())[:5] == a[:5]
    assert logentries.merge(a, ["x"] * 9) is None


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("01/02/2024 10:00:00 ERROR [app] disk is full", ("2024-01-02 10:00:00", "ERROR", "app")),
        ("myapp 2024-01-01 10:00:00 INFO disk is full", ("2024-01-01 10:00:00", "INFO", "myapp")),
        ("2024-01-01 10:00:00 INFO (worker.main) disk is full", ("2024-01-01 10:00:00", "INFO", "worker.main")),
        ("2024-01-01 10:00:00 INFO worker.main - disk is full", ("2024-01-01 10:00:00", "INFO", "worker.main")),
        ("2024-01-01 10:00:00 disk is full, WARN", ("2024-01-01 10:00:00", "-", "-")),
        ("20240101T100000Z; db-sync; ERROR; disk is full", ("2024-01-01 10:00:00", "ERROR", "db-sync")),
        ("01.02.2024 10:00:00 | ab | cd | ef | [1] | [2] | [3] | [4] | FATAL | disk is full", ("2024-01-02 10:00:00", "FATAL", "ab")),
        ("[10.0.0.1] [17] [4] (02/Jan/2024:10:00:00 +0000) (x.y) SEVERE: disk is full", ("2024-01-02 10:00:00", "ERROR", "x.y")),
    ],
)
def test_unlisted_layouts(spark, line, want):
    """Layouts that no rule names."""
    assert entries(spark, [line, "  and more", "> 2024-01-01 09:00:00 ERROR [q] quoted"]) == [(1, *want, "-")]


def test_times_that_dont_run_on_begin_nothing(spark):
    """The same lead begins entries where its times run on with the log, and none where they go back and forth or repeat the entry's."""
    own = [f"2024-01-0{d} 10:00:00 INFO (x) step {d} is done" for d in range(1, 8)]
    jumping = [y for d, x in enumerate(own) for y in (x, f"begun 20{10 + d * 3 % 7}-05-01 10:00:00 long ago")]
    assert [e[0] for e in entries(spark, jumping)] == [1, 3, 5, 7, 9, 11, 13]
    same = [y for x in own for y in (x, f"begun {x[:19]} (now)")]
    assert [e[0] for e in entries(spark, same)] == [1, 3, 5, 7, 9, 11, 13]
    own_program = [y for d, x in enumerate(own) for y in (x, f"begun 2024-01-0{d + 1} 10:30:00 (now)")]
    assert len(entries(spark, own_program)) == 14


def test_without_mining_there_are_no_entries(spark, monkeypatch):
    lines = [f"2024-01-0{d} 10:00:00 INFO (x) step {d} is done" for d in range(1, 8)]
    assert len(entries(spark, lines)) == 7
    whole = logentries.mined_layouts
    monkeypatch.setattr(logentries, "mined_layouts", lambda read: whole(read).limit(0))
    assert entries(spark, lines) == []


def test_templates_of_tasks_are_merged(spark):
    lines = [f"2024-01-0{d} 10:00:0{k} INFO [w.x] " + ("step", "step 4 is", "(all) done", "17 steps")[(d + k) % 4] for d in range(1, 9) for k in range(8)]
    df = spark.createDataFrame([("o", f"l{i % 7}", i + 1, x, None) for i, x in enumerate(lines)], TYPES)
    layouts = logentries.mined_layouts(logentries.read(df, 4)).collect()
    assert {r.layout for r in layouts} == {"t:iso L [ w ]"} and {(r.level_at, r.component_at) for r in layouts} == {(1, 3)}
    assert {r.component for r in logentries.entries(df, 4).collect()} == {"w.x"}
