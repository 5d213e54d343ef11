"""Queries of the reference functions on small tables: what drifted or is written otherwise isn't left out."""

import json

from conftest import rows

from snapmill.plans import reference


def test_drifted_fields_are_null(spark, tmp_path):
    waits = [{"event": "db file sequential read", "waits": "7", "total_wait_time_s": 1.5, "pct_dbtime": 9.0}, {"event": "db file sequential read", "waits": 7, "wait_s": 1.5, "pct_dbtime": 4.0}, {"event": "log file sync", "waits": 3, "total_wait_time_s": None, "pct_db_time": 2.0}]
    payload = {"db_instance_information": {"db_id": 1, "instance_num": 1}, "awrs": [{"snap_info": {"begin_snap_id": 5}, "host_cpu": {"num_cpus": 4, "pct_user": 10.0, "pct_idle": None}, "foreground_wait_events": waits}]}
    spark.createDataFrame([(1, json.dumps(payload))], "file_id bigint, payload string").write.parquet(str(tmp_path / "report_files.parquet"))
    got = {name: rows(reference.QUERIES[name](spark, str(tmp_path))) for name in ("find_snapshots_with_event", "event_timeline", "host_cpu_section")}
    assert got["find_snapshots_with_event"] == [(1, 1, 5, "db file sequential read", None, 1.5, 9.0)]
    assert got["event_timeline"] == [(1, 1, 5, 3, None, None)]
    assert got["host_cpu_section"] == [(1, 1, 5, None, 10.0, None)]


def test_tables_of_all_statements(spark, tmp_path):
    texts = ["INSERT INTO STOCK_MOVE (ID, STATE) VALUES (1, 'A');", "MERGE INTO METER_READ T USING STAGE S ON (T.ID = S.ID);", "select a\nfrom orders o join lines l on o.id = l.id", "SELECT\n  A\nFROM PRICE_HIST", "Delete from claim_doc where id = 1", "INSERT /*+ append */ INTO seat_plan SELECT 1", "update route_leg r set r.state = 1", "The notes come from the harbour, into the town.", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(0, "STOCK_MOVE"), (1, "METER_READ"), (2, "LINES"), (2, "ORDERS"), (3, "PRICE_HIST"), (4, "CLAIM_DOC"), (5, "SEAT_PLAN"), (6, "ROUTE_LEG")]
    assert rows(reference.QUERIES["table_name_extract"](spark, str(tmp_path))) == want
