"""Irregular readings onto an hourly grid, missing hours filled.

Per series a regression with trend and daily and weekly harmonics is fitted by normal equations whose sums Spark gathers. Each
missing hour gets the prediction plus the residuals of the nearest observed hours, bridged linearly between them, as far as bridged
residuals tell those of observed hours left out. Readings far outside the series' quartiles are held at the fences for all this.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapmill.common import utc_time

#: Periods in hours of the harmonics.
PERIODS = (24, 12, 168)
YEAR = 24 * 365.25
#: Ridge on the standardised basis, so that series shorter than the basis still have one solution.
RIDGE = 1e-3
#: Readings count at most so many times the distance of the quartiles outside of them.
FENCE = 1.5


def basis(hour: Column, first: Column) -> list[Column]:
    """1, trend, and a sine and cosine per period, of an hour number."""
    waves = [f(F.pmod(hour, F.lit(p)) * (2 * math.pi / p)) for p in PERIODS for f in (F.sin, F.cos)]
    return [F.lit(1.0), (hour - first) / YEAR, *waves]


def solve(frames: Iterator[pd.DataFrame], width: int, keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if not len(frame):
            continue
        gram = np.zeros((len(frame), width, width))
        for i in range(width):
            for j in range(i, width):
                gram[:, i, j] = gram[:, j, i] = frame[f"g{i}_{j}"]
        right = np.stack([frame[f"r{i}"] for i in range(width)], 1).astype(float)
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", gram), 1e-12))
        scaled = gram / scale[:, :, None] / scale[:, None, :] + RIDGE * np.eye(width)
        scaled[:, 0, 0] -= RIDGE * 0.999  # the mean is hardly shrunk
        fine = np.isfinite(scaled).all((1, 2)) & np.isfinite(right).all(1)
        beta = np.full(right.shape, np.nan)
        beta[fine] = np.linalg.solve(scaled[fine], (right / scale)[fine][:, :, None])[:, :, 0] / scale[fine]
        yield frame[[*keys]].assign(beta=list(beta))


def hourly_series(readings: DataFrame, keys: Sequence[str], at: str, value: str, least: float | None = None) -> DataFrame:
    """An hourly series per key from its first to its last hour with a reading.

    Returns ``keys, hour_start (timestamp), status, n, value``: ``observed`` hours hold the mean of their ``n`` readings,
    ``filled`` ones the estimate, which lies in the range of the series' observed hours (within the fences) and not below ``least``; ``marked``
    ones, beside an hour whose readings aren't finite, have no estimate. Rows with a null time or value
    are no readings. Repeated readings weigh as often as they are given; drop repeats before where they mean the same. A null
    key is a series of its own. Other columns are ignored, whatever their names. A series in one hour gives that hour only; an
    empty table gives an empty result. Readings are reduced to hours by partial aggregation before anything sorts a series, so
    a window holds one row per hour of the calendar and series, however many readings there are.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    rows = readings.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / 3600).alias("h"), F.col(value).cast("double").alias("y")).where(F.col("h").isNotNull() & F.col("y").isNotNull())
    hours = rows.groupBy(*own, "h").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    # one value for the keys, nulls equal to nulls, so that windows, sums and the joins share one exchange
    hours = hours.withColumn("k", F.struct(*own)).drop(*own).withColumn("first", F.min("h").over(Window.partitionBy("k")))
    finite = ~F.isnan("y") & (F.abs("y") != F.lit(float("inf")))
    usable = hours.withColumn("u", F.when(finite, F.col("y") if least is None else F.greatest("y", F.lit(float(least)))))
    quartiles = usable.groupBy("k").agg(F.percentile("u", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    reach = FENCE * (F.col("q")[1] - F.col("q")[0])
    hours = usable.join(quartiles, "k").withColumn("u", F.when(F.col("u").isNotNull(), F.greatest(F.least("u", F.col("q")[1] + reach), F.col("q")[0] - reach))).drop("q")
    x = basis(F.col("h"), F.col("first"))
    width = len(x)
    held = hours.where("u is not null").select("*", F.array(*x).alias("x"))
    gram = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width)]
    sums = held.groupBy("k").agg(F.min("u").alias("low"), F.max("u").alias("high"), *gram, *(F.sum(F.col("x")[i] * F.col("u")).alias(f"r{i}") for i in range(width)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    model = sums.select("k.*", *sums.columns[1:]).mapInPandas(lambda frames: solve(frames, width, [*own, "low", "high"]), ", ".join(f"{o} {kinds[o]}" for o in own) + ", low double, high double, beta array<double>")
    joined = hours.join(model.select(F.struct(*own).alias("k"), "low", "high", "beta"), "k", "left")
    predict = lambda h: sum((F.col("beta")[i] * c for i, c in enumerate(basis(h, F.col("first")))), F.lit(0.0))
    order = Window.partitionBy("k").orderBy("h")
    near = [f(c).over(order).alias(n) for f, number in ((F.lag, 0), (F.lead, 2)) for c, n in (("h", f"h{number}"), ("res", f"res{number}"))]
    fitted = joined.withColumn("res", F.col("u") - predict(F.col("h"))).select("*", *near)
    # how much of an hour's residual the bridge between its neighbours' tells
    bridged = F.col("res0") + (F.col("res2") - F.col("res0")) * (F.col("h") - F.col("h0")) / (F.col("h2") - F.col("h0"))
    series = Window.partitionBy("k")
    both, square = F.sum(bridged * F.col("res")).over(series), F.sum(F.when(F.col("res").isNotNull(), bridged * bridged)).over(series)
    fitted = fitted.withColumn("told", F.when(square > 0, F.least(F.greatest(both / square, F.lit(0.0)), F.lit(1.0))).otherwise(1.0))
    # each observed hour brings itself and the missing hours up to the next observed one
    spread = fitted.withColumn("g", F.explode(F.sequence("h", F.coalesce(F.col("h2") - 1, F.col("h")))))
    share = (F.col("g") - F.col("h")) / (F.col("h2") - F.col("h"))
    guess = predict(F.col("g")) + F.col("told") * (F.col("res") * (1 - share) + F.col("res2") * share)
    guess = F.when(~F.isnan(guess) & (F.abs(guess) != F.lit(float("inf"))), F.least(F.greatest(guess, F.col("low")), F.col("high")))
    seen = F.col("g") == F.col("h")
    return spread.select(
        *(F.col(f"k.{o}").alias(k) for k, o in zip(keys, own, strict=True)),
        F.timestamp_seconds(F.col("g") * 3600).alias("hour_start"),
        F.when(seen, "observed").when(guess.isNotNull(), "filled").otherwise("marked").alias("status"),
        F.when(seen, F.col("n")).otherwise(0).alias("n"),
        F.when(seen, F.col("y")).otherwise(guess).alias("value"),
    )


def readings_at_ends(profile: DataFrame, snaps: DataFrame) -> DataFrame:
    """Readings of ``load_profile`` at the end_snap_time of the report with the same instance and snapshot range.

    Re-delivered rows of either table count once. Rows without such a report or time are left out.
    """
    at = ["db_id", "instance_num", "begin_snap_id", "end_snap_id"]
    times = snaps.select(*at, utc_time("end_snap_time").alias("read_at")).where("read_at is not null").distinct()
    values = profile.select(*at, "stat_name", "per_second").where("per_second is not null").distinct()
    return values.join(times, at).withColumn("instance_num", F.col("instance_num").cast("bigint"))
