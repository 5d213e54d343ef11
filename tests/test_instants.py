from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from snapmill.operators.instants import Zones, offsets_of, read_times, to_utc, transitions, zone_files


def utc(text, zone="Europe/Vienna", territory="AUSTRIA"):
    seconds, _, _ = read_times(pd.Series([text]), pd.Series([zone]), pd.Series([territory]))
    return None if seconds[0] == np.iinfo(np.int64).min else datetime.fromtimestamp(int(seconds[0]), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize(
    ("text", "zone", "territory", "want"),
    [
        ("2024-01-02 03:04:05", "Asia/Kolkata", "INDIA", "2024-01-01T21:34:05Z"),
        (" 2-JAN-24 03:04:05 ", "UTC", "", "2024-01-02T03:04:05Z"),
        ("02-Jan-24 03.04.05.123456 PM", "UTC", "", "2024-01-02T15:04:05Z"),
        ("02-JAN-24 12.04.05.123456 AM -03:00", "UTC", "", "2024-01-02T03:04:05Z"),
        ("Tue Jan 02 03:04:05 2024", "UTC", "", "2024-01-02T03:04:05Z"),
        ("02/03/2024 01:02:03", "UTC", "IRELAND", "2024-03-02T01:02:03Z"),
        ("02/03/2024 01:02:03 PM", "UTC", "AMERICA", "2024-02-03T13:02:03Z"),
        ("20240102030405", "UTC", "", "2024-01-02T03:04:05Z"),
        ("20240102T030405Z", "Asia/Tokyo", "", "2024-01-02T03:04:05Z"),
        ("1704164645", "Asia/Tokyo", "", "2024-01-02T03:04:05Z"),
        ("1704164645999", "Asia/Tokyo", "", "2024-01-02T03:04:05Z"),
        ("2024-01-02T03:04:05.9-07:00", "UTC", "", "2024-01-02T10:04:05Z"),
        ("2024-01-02 03:04:05 +0530", "UTC", "", "2024-01-01T21:34:05Z"),
        ("2024-01-02 03:04:05 Asia/Tokyo", "UTC", "", "2024-01-01T18:04:05Z"),
        ("02-Jan-2024 03:04", "UTC", "", "2024-01-02T03:04:00Z"),
        ("02-Jan-2024 03:04:05 IST", "Asia/Kolkata", "", "2024-01-01T21:34:05Z"),
        ("02-Jul-2024 03:04:05 EST", "America/New_York", "", "2024-07-02T08:04:05Z"),
        ("02-Jan-2024 03:04:05 IST", "Europe/London", "", None),
        ("2023-10-29 02:30:00", "Europe/Vienna", "", "2023-10-29T00:30:00Z"),  # happened twice: the earlier
        ("2023-03-26 02:30:00", "Europe/Vienna", "", "2023-03-26T01:30:00Z"),  # skipped: offset from before
        ("2024-02-30 00:00:00", "UTC", "", None), ("2024-13-01 00:00:00", "UTC", "", None), ("2024-01-01 24:00:00", "UTC", "", None), ("2024-01-01 00:60:00", "UTC", "", None), ("0000-00-00 00:00:00", "UTC", "", None),
        ("2024-01-02x03:04:05", "UTC", "", None), ("02-XXX-2024 03:04", "UTC", "", None), ("13.01.00.1 13-Jan-24", "UTC", "", None), ("02-JAN-24 13.04.05.1 PM", "UTC", "", None),
        ("unknown", "UTC", "", None), ("", "UTC", "", None), (None, "UTC", "", None), ("x" * 100_000, "UTC", "", None), ("２０２４", "UTC", "", None),
        ("2024-01-02 03:04:05", None, None, None), ("2024-01-02 03:04:05", "No/Where", None, None), ("2024-01-02 03:04:05 No/Where", "UTC", None, None), ("1704164645", None, None, "2024-01-02T03:04:05Z"),
    ],
)
def test_forms(text, zone, territory, want):
    assert utc(text, zone, territory) == want


@pytest.mark.parametrize("zone", ["Europe/London", "America/Sao_Paulo", "Australia/Sydney", "America/New_York", "Asia/Kolkata", "Africa/Casablanca"])
@pytest.mark.parametrize("first", [1966, 2016, 2045, 2399])
def test_zone_tables(zone, first):
    """Every clock of some years reads as zoneinfo does, the first of two, the offset before a gap."""
    info = ZoneInfo(zone)
    start = int((datetime(first, 1, 1) - datetime(1970, 1, 1)).total_seconds())
    wall = np.arange(start, start + 7 * 366 * 86400, 5400)
    naive = [datetime(1970, 1, 1) + timedelta(seconds=int(x)) for x in wall]
    want = np.array([int(t.replace(tzinfo=info).utcoffset().total_seconds()) for t in naive])
    assert (offsets_of(zone, wall, np.array([t.year for t in naive])) == want).all()


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2051-07-01 12:00:00", "America/New_York", "2051-07-01T16:00:00Z"),
        ("1968-07-01 12:00:00", "America/New_York", "1968-07-01T16:00:00Z"),
        ("1943-07-01 12:00:00", "Europe/London", "1943-07-01T10:00:00Z"),
        ("0001-01-01 00:00:00", "UTC", "0001-01-01T00:00:00Z"),
        ("9999-12-31 23:59:59", "UTC", "9999-12-31T23:59:59Z"),
        ("2012-07-01 12:00:00 MSK", "Europe/Moscow", "2012-07-01T08:00:00Z"),
        ("2008-01-01 12:00:00 MSK", "Europe/Moscow", "2008-01-01T09:00:00Z"),
        ("2016-07-01 12:00:00 MSK", "Europe/Moscow", "2016-07-01T09:00:00Z"),
        ("2016-07-01 12:00:00 MSD", "Europe/Moscow", "2016-07-01T08:00:00Z"),
        ("2051-12-01 12:00:00 EDT", "America/New_York", "2051-12-01T16:00:00Z"),
        ("2024-01-02 03:04:05." + "7" * 500 + "+02:00", "UTC", "2024-01-02T01:04:05Z"),
    ],
)
def test_no_silent_bounds(text, zone, want):
    seconds, _, _ = read_times(pd.Series([text]), pd.Series([zone]), pd.Series([None]))
    assert f"{np.datetime64(int(seconds[0]), 's')}Z" == want


def test_one_zone_version(monkeypatch):
    """Workers read the zones that the driver sent, not their own."""
    files = zone_files()
    assert {"Europe/Vienna", "Asia/Tokyo", "UTC"} <= set(files) and sum(map(len, files.values())) < 4 << 20
    try:
        Zones.use("swapped", files | {"Europe/Vienna": files["Asia/Tokyo"]})
        assert utc("2024-01-02 09:00:00") == "2024-01-02T00:00:00Z"
    finally:
        Zones.version, Zones.files = None, None
        transitions.cache_clear()


def test_edges(spark):
    times = spark.createDataFrame([("t", 1, 1, 1, "2024-01-01 00:00:00"), ("t", 1, 1, 1, "2024-01-01 00:00:00"), ("t", 2, 9, 1, "2024-01-01 00:00:00"), ("t", None, None, None, "2024-01-01 00:00:00"), (None, 3, 1, 1, None)], "source_table string, row_id bigint, db_id bigint, instance_num int, text string")
    zones = spark.createDataFrame([(1, 1, "UTC", None), (1, 1, "UTC", "X"), (None, None, "Asia/Tokyo", None)], "db_id bigint, instance_num int, time_zone string, nls_territory string")
    clash = times.withColumn("time_zone", F.lit("Asia/Tokyo")).withColumn("mask", F.lit(1))
    got = sorted(((r.row_id, r.utc_time) for r in to_utc(clash, zones.withColumn("text", F.lit("x"))).collect()), key=repr)
    assert got == [(1, "2024-01-01T00:00:00Z"), (1, "2024-01-01T00:00:00Z"), (2, None), (3, None), (None, "2023-12-31T15:00:00Z")]
    assert to_utc(times.limit(0), zones).count() == 0
    assert to_utc(times, zones.limit(0)).where("utc_time is not null").count() == 0
