"""Findings come from every domain that the tables hold."""

from snapmill.plans import metrics


def test_findings_of_all_domains(spark, tmp_path):
    n = 40
    level = [1.0 + i % 3 / 10 if i < 30 else 9.0 + i % 3 for i in range(n)]
    load = [(1, 1, i, name, v) for i, v in enumerate(level) for name in ("DB Time(s)", "User calls")]
    wait = [(1, 1, i, kind, event, 5, v, 1.0) for i, v in enumerate(level) for kind, event in (("foreground", "log file sync"), ("background", "log file parallel write"))]
    spark.createDataFrame(load, "db_id bigint, instance_num smallint, begin_snap_id bigint, stat_name string, per_second double").write.parquet(str(tmp_path / "load_profile.parquet"))
    spark.createDataFrame(wait, "db_id bigint, instance_num smallint, begin_snap_id bigint, wait_kind string, event string, waits bigint, total_wait_time_s double, pct_dbtime double").write.parquet(str(tmp_path / "wait_events.parquet"))
    found = {(r.domain, r.name) for r in metrics.QUERIES["degraded_findings"](spark, str(tmp_path)).collect()}
    assert found == {("foreground", "log file sync"), ("background", "log file parallel write"), ("load_profile", "DB Time(s)"), ("load_profile", "User calls")}
    assert {(r.domain, r.n) for r in metrics.QUERIES["degraded_domains"](spark, str(tmp_path)).collect()} == {("foreground", 1), ("background", 1), ("load_profile", 2)}
