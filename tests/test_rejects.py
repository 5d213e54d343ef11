import csv
import io
import random

from conftest import rows
from pyspark.sql import functions as F

from snapmill.operators.rejects import LAYOUTS, Layout, parse_records, reject_report, rejected, typed

SMALL = {"s": Layout((("a", "whole"), ("b", "text"), ("c", "grouped"), ("d", "number?"), ("e", "pct")))}
TYPES = "row_id bigint, file_name string, section_name string, line string"


def reasons(spark, lines, layouts=SMALL, section="s"):
    df = spark.createDataFrame([(i, "f", section, x) for i, x in enumerate(lines)], TYPES)
    found = {r.row_id: r.reason for r in parse_records(df, layouts).collect()}
    return [found[i] for i in range(len(lines))]


def test_reasons(spark):
    cases = {
        "1,x,1,2.5,100": None, '"1","x, ""y""","1,234","", 3 ': None, "1,x,12,.5e1,0": None, " 1 ,x,9223372036854775807,,1": None,
        '"1,x,1,2,3': "quoting", '1,x"y,1,2,3': "quoting", '1,"x"y,1,2,3': "quoting", '1,"x" ,1,2,3': "quoting", '1, "x",1,2,3': "quoting", '1,"x,1,2,3': "quoting", '"': "quoting", '1,x"': "quoting",
        "1,x,1,2": "column_count", "1,x,1,2,3,4": "column_count", "": "column_count", ",": "column_count", None: "column_count", '"1,x,1,2,3"': "column_count",
        "-1,x,1,2,3": "invalid_value", "1.5,x,1,2,3": "invalid_value", "1,,1,2,3": "invalid_value", "1,x,1,2,": "invalid_value", "1,x,12,34,3": None, '1,x,"12,34",2,3': "invalid_value", '1,x,"1234,567",2,3': "invalid_value",
        "1,x,9223372036854775808,2,3": "invalid_value", "1,x,1,2,100.1": "invalid_value", "1,x,1,1e999,3": "invalid_value", "1,x,1,nan,3": "invalid_value", "1,x,1,0x1F,3": "invalid_value", "1,x,1,−3.1,3": "invalid_value", "1,x,1,2,5%": "invalid_value", "1,x,1_000,2,3": "invalid_value",
    }
    assert dict(zip(cases, reasons(spark, list(cases)), strict=True)) == cases


def test_round_trip(spark):
    """What a CSV writer writes comes back cell for cell."""
    random.seed(1)
    layouts = {"s": Layout(tuple((f"c{i}", "text?") for i in range(4)))}
    data = [["".join(random.choice('ab",ä ') for _ in range(random.randint(0, 6))).strip() for _ in range(4)] for _ in range(500)]
    lines = []
    for cells in data:
        out = io.StringIO()
        csv.writer(out, quoting=random.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerow(cells)
        lines.append(out.getvalue().rstrip("\r\n"))
    df = spark.createDataFrame([(i, "f", "s", x) for i, x in enumerate(lines)], TYPES)
    found = {r.row_id: r.cells for r in parse_records(df, layouts).collect()}
    assert [found[i] for i in range(len(data))] == data


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, "1,2"), (2, "f", "other", '"'), (None, "f", "s", "1,x,1,2,3"), (3, "f", "s", "1," + "x" * 300_000 + ",1,2,3"), (3, "f", "s", "1,x,1,2,3")], TYPES)
    df = df.withColumn("reason", F.lit("mine")).withColumn("cells", F.lit(0)).withColumn("fine", F.lit(True))
    got = parse_records(df, SMALL)
    assert got.columns == ["row_id", "section_name", "file_name", "reason", "cells"]
    assert sorted((r.row_id or 0, r.reason) for r in got.collect() if r.reason) == [(1, "column_count"), (2, "quoting")]
    assert got.where("reason is null").count() == 3
    assert parse_records(df.limit(0), SMALL).count() == 0


def test_typed_and_report(spark):
    line = '1100000000,11,"1,234",x'
    df = spark.createDataFrame([(1, "f", "wait_events", '11,12,"log, sync","1,234",1.5,2e1,3'), (2, "f", "wait_events", line), (3, "f", "host_cpu", "1,2,3,4,5,,1.5,1,2,3,4")], TYPES)
    parsed = parse_records(df, LAYOUTS)
    assert rows(typed(parsed, "wait_events")) == [(1, "f", 11, 12, "log, sync", 1234, 1.5, 20.0, 3.0)]
    assert rows(typed(parsed, "host_cpu").select("load_avg_begin", "load_avg_end")) == [(None, 1.5)]
    assert rows(rejected(parsed)) == [(2, "column_count")]
    assert sum(r.n for r in reject_report(parsed).collect()) == 3
