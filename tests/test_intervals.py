import random

from conftest import rows
from pyspark.sql import functions as F

from snapmill.operators.intervals import periods_and_gaps

TYPES = "k string, b bigint, e bigint, m string"


def brute(data):
    out = []
    for key in {d[0] for d in data}:
        spans = []
        for _, b, e, m in sorted((d for d in data if d[0] == key and d[1] is not None and d[2] is not None and d[2] > d[1]), key=lambda d: d[1]):
            if spans and b <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
                spans[-1][2] = max(filter(None, (spans[-1][2], m)), default=None)
            else:
                spans.append([b, e, m])
        out += [(key, "period", *s) for s in spans]
        out += [(key, "gap", a[1], z[0], a[2]) for a, z in zip(spans, spans[1:], strict=False)]
    return sorted(out, key=repr)


def test_same_as_brute_force(spark):
    random.seed(3)
    for size, reach, partitions in ((40, 60, 8), (300, 2000, 3), (300, 2000, None)):
        data = [(random.choice("ab"), b, b + random.choice([0, 1, 1, 2, 9, -1]), random.choice([None, "t1", f"t{b:04}"])) for b in (random.randint(-reach, reach) for _ in range(size))]
        data += [("a", 5, 6, "x")] * 3 + [(None, 1, 2, None), (None, 3, 4, "z"), ("c", None, 3, "q"), ("c", 3, None, "q")]
        got = rows(periods_and_gaps(spark.createDataFrame(data, TYPES), ["k"], "b", "e", "m", partitions))
        assert got == brute(data)


def test_edges(spark):
    df = spark.createDataFrame([("a", 2**62, 2**62 + 1, "x" * 100_000), ("a", -(2**62), 1 - 2**62, None)], TYPES)
    clash = df.withColumn("v", F.lit(1)).withColumn("s", F.lit(1)).withColumn("period", F.lit(1)).withColumn("_b", F.lit(1))
    got = rows(periods_and_gaps(clash, ["k"], "b", "e", "m").select("span_kind", "from_id", "to_id"))
    assert got == [("gap", 1 - 2**62, 2**62), ("period", -(2**62), 1 - 2**62), ("period", 2**62, 2**62 + 1)]
    assert periods_and_gaps(df.limit(0), ["k"], "b", "e", "m").count() == 0
