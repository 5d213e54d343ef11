"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

Starts and ends are counted independently. With both sorted by themselves, a gap follows the k-th end where the (k+1)-th start
exceeds it: all k intervals that began by then have ended. The ranks are running counts over ranges of like size, so no task sorts
a whole entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill.common import running


def periods_and_gaps(df: DataFrame, keys: Sequence[str], begin: str, end: str, mark: str, partitions: int | None = None) -> DataFrame:
    """Per entity the maximal ranges covered by intervals that overlap or touch, and the gaps between them.

    Returns ``keys, span_kind, from_id, to_id, ends_at``: ``ends_at`` is the greatest non-null ``mark`` of the intervals in the
    period (of the period before, for a gap), null if there is none. Rows with a null bound or ``end <= begin`` take no part.
    Repeated rows change nothing. A null key is an entity of its own. Other columns are ignored, whatever their names. An empty
    table gives an empty result. Rows are pre-aggregated by entity and bound, and spread over tasks by their number, however far apart bounds are;
    ``partitions`` is how many tasks, left to Spark if None.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(begin).cast("bigint").alias("_b"), F.col(end).cast("bigint").alias("_e"), F.col(mark).alias("_m")).where(F.col("_e") > F.col("_b"))
    bound = F.array(F.struct(F.col("_b").alias("v"), F.lit(1).alias("s"), F.lit(0).alias("e"), F.lit(None).cast(rows.schema["_m"].dataType).alias("m")), F.struct(F.col("_e").alias("v"), F.lit(0).alias("s"), F.lit(1).alias("e"), F.col("_m").alias("m")))
    bounds = rows.select(*own, F.explode(bound).alias("x")).groupBy(*own, F.col("x.v").alias("v")).agg(F.sum("x.s").alias("s"), F.sum("x.e").alias("e"), F.max("x.m").alias("m"))
    ranked = running(bounds, own, "v", {"rs": "s", "re": "e"}, partitions)
    # nothing is open just before v: a start there opens a period; nothing is open after v: an end there closes one
    edges = ranked.withColumn("opens", ((F.col("s") > 0) & (F.col("rs") - F.col("s") == F.col("re") - F.col("e"))).cast("int")).withColumn("closes", (F.col("e") > 0) & (F.col("rs") == F.col("re")))
    numbered = running(edges, own, "v", {"period": "opens"}, partitions)
    # a start also ends the gap that follows the period before
    seat = F.array(F.struct(F.col("period").alias("p"), F.when(F.col("opens") == 1, F.col("v")).alias("a"), F.when(F.col("closes"), F.col("v")).alias("z"), F.col("m").alias("m"), F.lit(None).cast("bigint").alias("n")))
    after = F.array(F.struct((F.col("period") - 1).alias("p"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("z"), F.lit(None).cast(rows.schema["_m"].dataType).alias("m"), F.col("v").alias("n")))
    seats = numbered.select(*own, F.explode(F.when((F.col("opens") == 1) & (F.col("period") > 1), F.concat(seat, after)).otherwise(seat)).alias("x"))
    spans = seats.groupBy(*own, F.col("x.p").alias("p")).agg(F.min("x.a").alias("a"), F.max("x.z").alias("z"), F.max("x.m").alias("m"), F.max("x.n").alias("n"))
    both = F.array(F.struct(F.lit("period").alias("span_kind"), F.col("a").alias("from_id"), F.col("z").alias("to_id")), F.struct(F.lit("gap").alias("span_kind"), F.col("z").alias("from_id"), F.col("n").alias("to_id")))
    return spans.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), F.explode(both).alias("x"), F.col("m").alias("ends_at")).where(F.col("x.to_id").isNotNull()).select(*keys, "x.*", "ends_at")
