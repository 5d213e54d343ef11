"""Running totals and carried values over ranges of any number."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from snapmill.common import carried, running


def made(spark, n, gap, seed):
    r = random.Random(seed)
    rows = []
    for key in [None, "a", "b", *(f"k{i}" for i in range(5))]:
        at = 0
        for _ in range(n if key == "a" else r.randint(0, n // 8)):
            at += r.randint(1, gap)
            rows.append((key, r.choice([None, 1]) if key != "a" else 1, at, r.choice([None, 1, 2, 3]), r.choice([None, None, None, f"v{at}"])))
    rows = list({(a, b, c): (a, b, c, d, e) for a, b, c, d, e in rows}.values())
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "a string, b int, at bigint, x int, v string")


@pytest.mark.parametrize(("n", "gap", "partitions"), [(400, 3, None), (400, 10_000, 7), (300, 1, 1), (60, 5, 40), (0, 1, 3)])
def test_any_ranges(spark, n, gap, partitions):
    rows, df = made(spark, n, gap, n + gap)
    want_sum, want_last = {}, {}
    order = lambda r: (r[0] or "", r[1] or 0, r[2])
    for _, group in groupby(sorted(rows, key=order), key=lambda r: r[:2]):
        total, last = 0, None
        for a, b, at, x, v in group:
            total += x or 0
            want_sum[a, b, at], want_last[a, b, at] = total, last
            last = v or last
    got = running(df, ["a", "b"], "at", {"total": "x"}, partitions)
    assert got.columns == ["a", "b", "at", "x", "v", "total"]
    assert {(r.a, r.b, r["at"]): r.total for r in got.collect()} == want_sum
    got = carried(df, ["a", "b"], "at", "v", "last", partitions)
    assert {(r.a, r.b, r["at"]): r["last"] for r in got.collect()} == want_last


def test_one_key_far_apart_is_spread(spark):
    """Values 10,000 apart in one key: no task has more than its share of rows."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 10_000).alias("at"), F.lit(1).alias("x"))
    got = running(df, ["k"], "at", {"n": "x"}, 16)
    assert got.where("n <> at / 10000 + 1").count() == 0
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2 * 200_000 / 16
