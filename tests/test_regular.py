import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from snapmill.common import load
from snapmill.operators.regular import hourly_series, readings_at_ends

START = datetime(2024, 1, 1)
TYPES = "k string, t timestamp, v double"


def course(h):
    return 100 + 0.05 * h + 20 * math.sin(2 * math.pi * h / 24) + 5 * math.cos(2 * math.pi * h / 12)


def test_grid_and_estimates(spark):
    hours = [h for h in range(24 * 14) if h % 7 not in (2, 3) and not 100 <= h < 130]
    df = spark.createDataFrame([("a", START + timedelta(hours=h, minutes=h % 60), course(h)) for h in hours], TYPES)
    got = {(r.hour_start - START) // timedelta(hours=1): r for r in hourly_series(df, ["k"], "t", "v").collect()}
    assert sorted(got) == list(range(hours[0], hours[-1] + 1))
    assert {h for h, r in got.items() if r.status == "observed"} == set(hours)
    missing = [h for h in got if h not in set(hours)]
    assert max(abs(got[h].value - course(h)) for h in missing) < 1.5
    assert all(abs(got[h].value - course(h)) < 1e-9 for h in hours)


def test_bridge_meets_the_ends(spark):
    """With two readings the model says little; the bridge runs from one to the other."""
    df = spark.createDataFrame([("a", START, 10.0), ("a", START + timedelta(hours=4), 30.0)], TYPES)
    values = [r.value for r in hourly_series(df, ["k"], "t", "v").orderBy("hour_start").collect()]
    assert values[0] == 10 and values[-1] == 30 and len(values) == 5


def test_edges(spark):
    t = START
    df = spark.createDataFrame([("a", t, 1.0), ("a", t, 1.0), ("a", t + timedelta(minutes=59), 4.0), (None, t, 2.0), (None, t + timedelta(hours=2), None), ("b", None, 1.0), ("n", t, float("nan")), ("n", t + timedelta(hours=2), 1.0)], TYPES)
    clash = df.withColumn("h", F.lit(1)).withColumn("y", F.lit(1)).withColumn("status", F.lit(1)).withColumn("beta", F.lit(1))
    got = rows(hourly_series(clash, ["k"], "t", "v").select("k", "hour_start", "status", "n", "value").where("k is null or k <> 'n'"))
    assert got == [("a", t, "observed", 3, 2.0), (None, t, "observed", 1, 2.0)]
    assert [r.status for r in hourly_series(df, ["k"], "t", "v").where("k = 'n'").orderBy("hour_start").collect()][1] == "marked"
    assert hourly_series(df.limit(0), ["k"], "t", "v").count() == 0


def test_readings_need_their_report(spark):
    profile = spark.createDataFrame([(1, 1, 1, 2, "s", 5.0)] * 2 + [(1, 1, 1, 3, "s", 6.0), (1, 1, 2, 3, "s", None)], "db_id bigint, instance_num int, begin_snap_id bigint, end_snap_id bigint, stat_name string, per_second double")
    snaps = spark.createDataFrame([(1, 1, 1, 2, "2024-01-01 00:10:00")] * 2 + [(1, 1, 1, 3, None), (1, 1, 1, 3, "soon")], "db_id bigint, instance_num int, begin_snap_id bigint, end_snap_id bigint, end_snap_time string")
    assert rows(readings_at_ends(profile, snaps).select("per_second", "read_at")) == [(5.0, datetime(2024, 1, 1, 0, 10))]


def test_fill_beats_the_line_on_held_out_hours(spark):
    """Every tenth hour of the readings held out: the estimate is nearer than a straight line, is no negative rate, and stays in range."""
    d = f"{DATA}/sf0.1"
    readings = readings_at_ends(load(spark, d, "load_profile"), load(spark, d, "snap_info"))
    keys = ["db_id", "instance_num", "stat_name"]
    hours = readings.groupBy(*keys, F.date_trunc("hour", "read_at").alias("t")).agg(F.avg("per_second").alias("v")).toPandas().sort_values([*keys, "t"])
    place, size = hours.groupby(keys).cumcount(), hours.groupby(keys)["t"].transform("size")
    held = (place % 10 == 5) & (place < size - 1) & (size >= 20)
    schema = "db_id bigint, instance_num bigint, stat_name string, t timestamp, v double"
    got = hourly_series(spark.createDataFrame(hours[~held], schema), keys, "t", "v", least=0.0).where("status <> 'observed'").toPandas()
    assert (got["value"] >= 0).all()
    known = hours[~held].assign(s=hours["t"].astype("int64"))
    sides = [pd.merge_asof(hours[held].sort_values("t"), hours[~held].assign(at=hours["t"]).sort_values("t"), on="t", by=keys, direction=way, suffixes=("", "_near")).set_index([*keys, "t"]) for way in ("backward", "forward")]
    share = (sides[0].index.get_level_values("t") - sides[0]["at"]) / (sides[1]["at"] - sides[0]["at"])
    line = sides[0]["v_near"] * (1 - share) + sides[1]["v_near"] * share
    truth = hours[held].set_index([*keys, "t"])["v"]
    scale = known.groupby(keys)["v"].agg(lambda x: (x - x.median()).abs().median() or 1.0)
    both = pd.DataFrame({"truth": truth, "line": line, "fill": got.set_index([*keys, "hour_start"])["value"].rename_axis([*keys, "t"])}).dropna().join(scale.rename("scale"), on=keys)
    assert len(both) > 4000
    error = {c: (both[c] - both["truth"]).abs() / both["scale"] for c in ("fill", "line")}
    print({c: (round(e.median(), 3), round(e.mean(), 3)) for c, e in error.items()})
    assert error["fill"].median() < 0.95 * error["line"].median() and error["fill"].mean() < 0.9 * error["line"].mean()


@pytest.mark.parametrize("gap", [24 * 400])
def test_long_gap(spark, gap):
    df = spark.createDataFrame([("a", START, 1.0), ("a", START + timedelta(hours=gap), 2.0)], TYPES)
    assert hourly_series(df, ["k"], "t", "v").count() == gap + 1
