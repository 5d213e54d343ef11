import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from snapmill.operators.spikes import Segments, details, faulty

TYPES = "row_id bigint, db_id bigint, instance_num int, src bigint, place bigint, tie bigint, kind int, v1 double, v2 double"
TIMES = "db_id bigint, instance_num int, place bigint, tie bigint, at bigint"


def found(spark, series, at=True, block=4096, bound=None, step=3600):
    """Faulty rows of one source; row_id is the place in the list."""
    df = spark.createDataFrame([(i, 1, 1, 7, i, i + 1, 0, v, bound) for i, v in enumerate(series)], TYPES)
    times = spark.createDataFrame([(1, 1, i, i + 1, i * step) for i in range(len(series))] if at else [], TIMES)
    return {r.row_id: r.why for r in faulty(df, times, block=block).collect()}


def noisy(n, seed=0, mean=100.0, spread=3.0):
    r = np.random.default_rng(seed)
    return (mean + r.uniform(-spread, spread, n)).round(3).tolist()


def test_kinds(spark):
    x = noisy(300)
    x[50], x[51], x[120], x[200] = 500.0, 430.0, -5.0, None
    x[150:156] = [101.0] * 6
    want = {50: "spike", 51: "spike", 120: "impossible", **dict.fromkeys(range(150, 156), "stuck")}
    assert found(spark, x) == want
    assert found(spark, x, at=False) == want


def test_blocks_change_nothing_for_stuck_runs(spark):
    x = noisy(200)
    x[60:65] = [99.0] * 5
    x[126:131] = [98.0] * 5
    x[140:144] = [97.0] * 4
    want = dict.fromkeys([*range(60, 65), *range(126, 131)], "stuck")
    for block in (4096, 64, 16, 3):
        assert {k: v for k, v in found(spark, x, block=block).items() if v == "stuck"} == want


def test_ordinary_courses(spark):
    x = noisy(240)
    for day in range(10):
        x[day * 24 + 3] = 300.0 + day  # a peak every day
    assert found(spark, x) == {}
    assert found(spark, [*noisy(100), *noisy(100, 1, 180.0)]) == {}  # a lasting shift
    assert found(spark, [0.0] * 100) == {}  # idle
    x[100] = 2500.0
    assert found(spark, x) == {100: "spike"}


def test_bounds(spark):
    x = noisy(100, mean=3.0, spread=0.5)
    x[40] = 4.2
    assert found(spark, x, bound=4.0) == {40: "impossible"}
    df = spark.createDataFrame([(i, 1, 1, 7, i, 0, 1, 1.0 + i % 3, v) for i, v in enumerate([*noisy(50, mean=50.0), 101.0])], TYPES)
    got = rows(faulty(df, spark.createDataFrame([], TIMES)))
    assert got == [("wait_events", "pct_dbtime", 50, "impossible")]


def test_edges(spark):
    x = noisy(60)
    data = [(i, 1, 1, 7, i, 1, 0, v, None) for i, v in enumerate(x)]
    data += [(1000 + i, 1, 1, 7, i, 1, 0, v, None) for i, v in enumerate(x)]  # all copied
    data += [(2000 + i, 1, 1, 7, 60, 1, 0, -1.0, None) for i in range(20_000)]  # many copies of one reading
    data += [(1, None, 1, 7, 1, 1, 0, -1.0, None), (1, 1, 1, None, 1, 1, 0, -1.0, None), (1, 1, 1, 7, None, 1, 0, -1.0, None), (5000, 1, 1, 8, 1, None, 0, float("nan"), None), (5001, 1, 1, 9, 1, None, 0, float("inf"), None), (5002, 1, 1, 9, 2, None, 1, None, None)]
    df = spark.createDataFrame(data, TYPES).withColumn("block", F.lit(1)).withColumn("at", F.lit("x")).withColumn("why", F.lit(0))
    got = faulty(df, spark.createDataFrame([(1, 1, 5, 1, None)], TIMES))
    assert {(r.row_id, r.why) for r in got.collect()} == {(2000 + i, "impossible") for i in range(20_000)} | {(5000, "impossible"), (5001, "impossible")}
    assert got.count() == 20_002
    assert faulty(df.limit(0), spark.createDataFrame([], TIMES)).count() == 0


def test_details_stay_within_segments():
    random.seed(2)
    x = np.array([random.random() for _ in range(40)])
    codes = np.array([0] * 11 + [1] * 28 + [2])
    sizes, reach = details(x, Segments(codes))
    for code in range(3):
        own = codes == code
        alone = details(x[own], Segments(codes[own]))
        for k in range(4):
            assert np.allclose(sizes[k][own], alone[0][k], equal_nan=True) and np.allclose(reach[k][own], alone[1][k])


def test_blocks_change_nothing_for_spikes(spark):
    x = noisy(240, 4)
    for day in range(10):
        x[day * 24 + 3] = 300.0 + day  # a peak every day
    x[65], x[130], x[239] = 2600.0, 2500.0, 2700.0  # beside ends of blocks and at the end of the course
    for block in (4096, 64, 16, 3):
        assert found(spark, x, block=block) == dict.fromkeys((65, 130, 239), "spike")


def test_spikes_over_a_multiple_of_the_block(spark):
    x = noisy(100, 5)
    x[98], x[40] = 5000.0, 900.0
    df = spark.createDataFrame([(i, 1, 1, s, 4000 + i - 2, i, 0, v, None) for s in range(3) for i, v in enumerate(x)], TYPES)  # two readings from id 4096 on
    times = spark.createDataFrame([(1, 1, 4000 + i - 2, i, i * 3600) for i in range(100)], TIMES)
    assert sorted((r.row_id, r.why) for r in faulty(df, times).collect()) == [(40, "spike")] * 3 + [(98, "spike")] * 3


def test_distance_of_ids_and_blocks_change_nothing(spark):
    """The same readings with ids 1 to 4096 apart, in blocks of 16 to 4096: the same faulty ones."""
    x = noisy(400, seed=9)
    for i in range(20, 400, 29):
        x[i] = 900.0 + i
    x[200:206] = [100.0] * 6
    want = found(spark, x)
    assert [k for k, v in want.items() if v == "spike"] == [*range(20, 400, 29)]
    for apart, block in ((8, 64), (40, 256), (4096, 16), (4096, 4096)):
        df = spark.createDataFrame([(i, 1, 1, 7, i * apart, i * apart + 1, 0, v, None) for i, v in enumerate(x)], TYPES)
        times = spark.createDataFrame([(1, 1, i * apart, i * apart + 1, i * 3600) for i in range(len(x))], TIMES)
        for whole in (1 << 20, 90):
            assert {r.row_id: r.why for r in faulty(df, times, block=block, whole=whole).collect()} == want


def test_long_sources_in_parts(spark):
    """Sources judged in parts of 64 readings give what they give as wholes: spikes, peaks, runs, bounds, copies, missing times."""
    r = random.Random(5)
    rows_, times = [], []
    for place in range(0, 2400, 3):
        if r.random() < 0.85:
            times.append((1, 1, place, 0, place * 1200 + r.randint(0, 900)))
    for src, kind in ((1, 0), (2, 1), (3, 0), (4, 0), (5, 1)):
        hold = None
        for k, place in enumerate(range(0, 2400 if src != 4 else 60, 3)):
            v1, v2 = 100 + 20 * r.random() + (40 if k > 400 else 0), 30 + 5 * r.random()
            if place * 1200 // 3600 % 24 == 5 and src == 1:
                v1 += 180
            if r.random() < 0.01:
                v1 *= 40
            if r.random() < 0.005:
                v1, v2 = -v1, 130.0
            if src == 5:
                v1 = 0.0
            if hold is None and r.random() < 0.01:
                hold = [v1, 5 + r.randint(-1, 9)]
            if hold:
                v1, hold = hold[0], [hold[0], hold[1] - 1] if hold[1] > 1 else None
            row = (1, 1, src, place, 0, kind, v1 if r.random() > 0.03 else None, v2 if kind else None)
            rows_ += [row] * r.choice([1, 1, 1, 1, 2, 3])
    r.shuffle(rows_)
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows_)], TYPES).cache()
    at = spark.createDataFrame(times, TIMES)
    got = {whole: rows(faulty(df, at, whole=whole)) for whole in (1 << 20, 64, 300)}
    assert {x[3] for x in got[64]} == {"impossible", "stuck", "spike"} and len(got[64]) > 60
    assert got[64] == got[1 << 20] and got[300] == got[1 << 20]
    df.unpersist()
