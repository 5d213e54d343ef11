"""Implausible readings of a source: impossible ones, stuck runs and spikes.

The readings of a source, in order, go through an undecimated Haar decomposition. A spike shows as a block of 1, 2, 4 or 8
readings whose details against both neighbouring blocks have one sign and are large against the source's robust scale of that
level. Runs without any detail are stuck. Spikes are then checked exactly against the range of the ordinary readings, which
holds peaks that recur at one hour of the day.

Readings move once: to a group of sources of their instance, where scales, quartiles, hours, ranges and runs are those of all readings of a
source. What leaves a group is its faulty readings. A source too long for one task is ranked over ranges and judged in parts, with the same
numbers of all its readings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill.common import BLOCK, carried, cut, join_same, running, utc_time

LEVELS = (1, 2, 4, 8)
#: Groups of sources that an instance is divided into at most.
PARTS = 32
#: A detail this many robust scales large makes its readings candidates.
DETAIL = 4.0
#: A candidate this many widths of the ordinary range outside of it is faulty.
WIDTHS = 2.5
#: Equal consecutive readings that count as stuck.
STUCK = 5
#: Candidates at one hour of the day are a recurring peak if at least two, and this share of all readings at that hour, lie
#: within this part of their median around it, on two days or more. Where that hour was read on one day only, they still are
#: if their median is at most so many times that of the source.
PEAK_SHARE, PEAK_SPREAD, MODERATE = 0.6, 0.4, 5.0


class Segments:
    """Sorted readings, one segment per source and field: shifts and orders that stay within segments."""

    def __init__(self, codes: np.ndarray) -> None:
        fresh = np.concatenate(([True], codes[1:] != codes[:-1]))
        self.starts = np.flatnonzero(fresh)
        self.seg = np.cumsum(fresh) - 1
        self.sizes = np.diff(np.append(self.starts, len(codes)))
        self.pos = np.arange(len(codes)) - self.starts[self.seg]
        self.size = self.sizes[self.seg]

    def back(self, x: np.ndarray, by: int, other: float) -> np.ndarray:
        """Each row's value ``by`` rows before."""
        out = np.full(len(x), other, float)
        out[by:] = x[: len(x) - by] if by else x
        out[self.pos < by] = other
        return out

    def ahead(self, x: np.ndarray, by: int, other: float) -> np.ndarray:
        out = np.full(len(x), other, float)
        out[: len(x) - by] = x[by:]
        out[self.pos + by >= self.size] = other
        return out

    def ranks(self, x: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
        """Per segment the value at each share of its values in order, NaN left out."""
        order = np.lexsort((x, self.seg))
        full = np.add.reduceat((~np.isnan(x)).astype(np.int64), self.starts)
        return [np.where(full > 0, x[order][np.minimum(self.starts + np.maximum(np.ceil(p * full).astype(np.int64) - 1, 0), len(x) - 1)], np.nan) for p in shares]


def filled(x: np.ndarray, g: Segments) -> tuple[np.ndarray, np.ndarray]:
    """The last and the next known value of each row within its segment, NaN for none."""
    known = ~np.isnan(x)
    rows = np.arange(len(x))
    before = np.maximum.accumulate(np.where(known, rows, -1))
    after = np.minimum.accumulate(np.where(known, rows, len(x))[::-1])[::-1]
    first, last = g.starts[g.seg], g.starts[g.seg] + g.size
    return np.where(before >= first, x[np.maximum(before, 0)], np.nan), np.where(after < last, x[np.minimum(after, len(x) - 1)], np.nan)


def details(x: np.ndarray, g: Segments) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By level: each reading's detail against the block before the one that ends there, and the greatest two-sided detail of the
    blocks that hold it."""
    level_details, reach = [], []
    sums, length = x, 1
    for n in LEVELS:
        while length < n:  # sums of 2n readings from those of n, so that small sources keep their digits beside large ones
            sums = sums + g.back(sums, length, 0.0)
            length *= 2
        mean = sums / np.minimum(g.pos + 1, n)
        left, right = mean - g.back(mean, n, np.nan), mean - g.ahead(mean, n, np.nan)
        left, right = np.where(np.isnan(left), right, left), np.where(np.isnan(right), left, right)
        both = np.where((left > 0) & (right > 0) | (left < 0) & (right < 0), np.minimum(np.abs(left), np.abs(right)), 0.0)
        most = both
        for k in range(1, n):
            most = np.maximum(most, g.ahead(both, k, 0.0))
        level_details.append(np.abs(left))
        reach.append(most)
    return level_details, reach


def stuck_runs(v: np.ndarray, g: Segments) -> np.ndarray:
    """Which readings are in a run of ``STUCK`` or more equal ones: those without any detail against each other."""
    run, stuck = (v == g.back(v, 1, np.nan)).astype(float), np.zeros(len(v), bool)
    ended = run.copy()
    for k in range(1, STUCK - 1):
        ended += g.back(run, k, 0.0)
    for k in range(STUCK):
        stuck |= g.ahead(ended, k, 0.0) >= STUCK - 1
    return stuck


def recurring(x: np.ndarray, odd: np.ndarray, at: np.ndarray, usual: np.ndarray, g: Segments) -> np.ndarray:
    """Which candidates belong to a peak that recurs at one hour of the day."""
    peak = np.zeros(len(x), bool)
    timed = ~np.isnan(at) & ~np.isnan(x)
    hour = np.where(timed, np.floor(np.where(timed, at, 0) / 3600), 0).astype(np.int64)
    code, day = g.seg * 24 + hour % 24, hour // 24
    mine = np.isin(code, np.unique(code[odd & timed])) & timed
    rows = np.flatnonzero(mine)
    if not len(rows):
        return peak
    rows = rows[np.lexsort((x[rows], code[rows]))]
    h = Segments(code[rows])
    values, days, chosen = x[rows], day[rows], odd[rows]
    middle = h.ranks(np.where(chosen, values, np.nan), (0.5,))[0][h.seg]
    near = chosen & (np.abs(values - middle) <= PEAK_SPREAD * np.abs(middle))
    like = np.add.reduceat(near.astype(np.int64), h.starts)
    span = lambda d, of: (np.fmin.reduceat(np.where(of, d, np.nan), h.starts), np.fmax.reduceat(np.where(of, d, np.nan), h.starts))
    (like1, like2), (day1, day2) = span(days, near), span(days, np.ones(len(rows), bool))
    again = (like1 < like2) | ((day1 == day2) & (np.abs(middle[h.starts]) <= MODERATE * np.abs(usual[rows][h.starts])))
    peak[rows] = near & ((like > 1) & (like >= PEAK_SHARE * h.sizes) & again)[h.seg]
    return peak


def judge(f: pd.DataFrame) -> pd.DataFrame:
    """Faulty readings of whole sources, with the place of why in ``WHY``."""
    entity = f["entity"].to_numpy()
    marks = f["src"].isna().to_numpy()
    times = f.loc[marks].groupby(["entity", "place", "tie"], sort=False)["at"].max().reset_index()
    f = f.loc[~marks].drop(columns="at").merge(times, on=["entity", "place", "tie"], how="left")
    if not len(f):
        return pd.DataFrame(columns=JUDGED)
    entity, kind = f["entity"].to_numpy(), f["kind"].to_numpy()
    zero, one, two = (kind == 0) & f["has1"].to_numpy(), (kind == 1) & f["has1"].to_numpy(), (kind == 1) & f["has2"].to_numpy()
    take = np.concatenate((np.flatnonzero(zero), np.flatnonzero(one), np.flatnonzero(two)))
    field = np.repeat([0, 1, 2], [zero.sum(), one.sum(), two.sum()])
    v1, v2 = f["v1"].to_numpy(float), f["v2"].to_numpy(float)
    v = np.where(field == 2, v2[take], v1[take])
    high = np.where(field == 0, v2[take], np.where(field == 2, 100.0, np.nan))
    src, place, tie, row_id, copies, at = (f[c].to_numpy()[take] for c in ("src", "place", "tie", "row_id", "copies", "at"))
    group = entity[take] * 3 + field
    order = np.lexsort((v, tie, place, src, group))
    v, high, src, place, tie, row_id, copies, at, group = (a[order] for a in (v, high, src, place, tie, row_id, copies, at, group))
    changed = (group[1:] != group[:-1]) | (src[1:] != src[:-1])
    same = ~changed & (place[1:] == place[:-1]) & (tie[1:] == tie[:-1]) & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    keep = np.flatnonzero(np.concatenate(([True], ~same)))
    row_id, copies, high = np.minimum.reduceat(row_id, keep), np.add.reduceat(copies, keep), np.fmax.reduceat(high, keep)
    segment = np.cumsum(np.concatenate(([0], changed)))[keep]
    v, src, place, tie, at, group = (a[keep] for a in (v, src, place, tie, at, group))
    g = Segments(segment)
    x = np.where(np.isfinite(v) & (v >= 0) & ~(v > high), v, np.nan)
    before, after = filled(x, g)
    whole = np.nan_to_num(np.where(np.isnan(before), after, before))
    t1, t2 = filled(at.astype(float), g)
    at = np.where(np.isnan(at), (t1 + t2) / 2, at)
    stuck = stuck_runs(v, g)
    sizes, reach = details(whole, g)
    far = np.zeros(len(v), bool)
    for size, most in zip(sizes, reach, strict=True):
        far |= most > DETAIL * np.nan_to_num(g.ranks(size, (0.5,))[0], nan=np.inf)[g.seg] / 0.6745
    q1, q2, q3 = (q[g.seg] for q in g.ranks(x, (0.25, 0.5, 0.75)))
    with np.errstate(invalid="ignore"):
        odd = far & (np.maximum(x - q3, q1 - x) > q3 - q1)
    odd &= ~recurring(x, odd, at, q2, g)
    ordinary = np.where(odd, np.nan, x)
    low, top = np.fmin.reduceat(ordinary, g.starts)[g.seg], np.fmax.reduceat(ordinary, g.starts)[g.seg]
    most = np.fmax.reduceat(np.abs(v), g.starts)[g.seg]
    with np.errstate(invalid="ignore"):
        outside = np.maximum(x - top, low - x)
        spike = odd & (outside > 0) & (outside >= WIDTHS * (top - low))
    why = np.select([np.isnan(x), stuck, spike], [0, 1, 2], -1)
    tell = np.flatnonzero((why >= 0) & (most != 0))
    out = {"entity": group // 3, "src": src, "f": group % 3, "place": place, "tie": tie, "v": v, "row_id": row_id, "copies": copies, "why": why}
    return pd.DataFrame({k: a[tell] for k, a in out.items()})


WHY = ("impossible", "stuck", "spike")
JUDGED = ["entity", "src", "f", "place", "tie", "v", "row_id", "copies", "why"]
JUDGED_TYPES = "db_id bigint, instance_num int, part bigint, src bigint, f int, place bigint, tie bigint, v double, row_id bigint, copies bigint, why int"
#: Rows that are judged at once, whole groups of sources; one larger group is judged by itself.
ROWS = 200_000


def judge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``judge`` over a partition that is sorted by instance and group of sources."""
    names = ["db_id", "instance_num", "part"]

    def run(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        keys = [table[n].to_numpy() for n in names]
        entity = np.cumsum(np.concatenate(([0], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
        frame = {n: table[n].to_numpy() for n in ("place", "tie", "v1", "v2", "at")} | {n: pc.fill_null(table[n], 0).to_numpy() for n in ("kind", "row_id", "copies")}
        f = pd.DataFrame(frame | {"entity": entity, "has1": table["v1"].is_valid().to_numpy(), "has2": table["v2"].is_valid().to_numpy()})
        f["src"] = pd.arrays.IntegerArray(pc.fill_null(table["src"], 0).to_numpy().copy(), ~table["src"].is_valid().to_numpy())
        out = judge(f)
        _, first = np.unique(entity, return_index=True)
        at = out.pop("entity").to_numpy(np.int64) if len(out) else np.zeros(0, np.int64)
        for n, k in zip(names, keys, strict=True):
            out[n] = k[first][at]
        kinds = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (x.split(" ") for x in JUDGED_TYPES.split(", "))])
        return pa.RecordBatch.from_arrays([pa.array(out[n.name].to_numpy(), n.type) for n in kinds], schema=kinds)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        table = pa.Table.from_batches(held)
        keys = [table[n].to_numpy() for n in names]
        starts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if len(starts):  # the last group may go on in the next batch
            yield run(table.slice(0, int(starts[-1])))
            held = table.slice(int(starts[-1])).to_batches()
        else:
            held = table.combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield run(pa.Table.from_batches(held))


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, with the least row_id and their number: copies don't travel."""
    for batch in batches:
        keys = [n for n in batch.schema.names if n not in ("row_id", "copies")]
        table = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("row_id", "min"), ("copies", "sum")])
        yield from table.rename_columns([*keys, "row_id", "copies"]).select(batch.schema.names).combine_chunks().to_batches()


#: What a row is: one of load_profile, with the bound of its reading in v2, or one of wait_events, with two readings.
FIELDS = (("load_profile", "per_second"), ("wait_events", "total_wait_time_s"), ("wait_events", "pct_dbtime"))
#: Readings of a source that one task judges at once; a longer source is judged in parts of so many.
WHOLE = 1 << 20
#: Readings beyond either end of a part that its details reach to.
HALO = 32
SOURCE = ["db_id", "instance_num", "src", "f"]
PARTED_TYPES = "db_id bigint, instance_num int, src bigint, f int, place bigint, tie bigint, v double, row_id bigint, copies bigint, x double, at double, stuck boolean, d0 double, d1 double, d2 double, d3 double, m0 double, m1 double, m2 double, m3 double"


def detail_parts(batches: Iterator[pa.RecordBatch], whole: int) -> Iterator[pa.RecordBatch]:
    """Details and stuck runs of parts of long sources, which come sorted by source, part and rank; the halo's rows stay behind."""
    held: list[pa.RecordBatch] = []
    keys = [*SOURCE, "part"]
    schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (x.split(" ") for x in PARTED_TYPES.split(", "))])

    def run(table: pa.Table) -> pa.RecordBatch:
        cols = {n: table[n].to_numpy() for n in table.schema.names if n not in ("x", "at")} | {n: pc.fill_null(table[n], np.nan).to_numpy() for n in ("x", "at")}
        v = cols["v"]
        g = Segments(np.cumsum(np.concatenate(([0], np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)))))
        sizes, reach = details(cols["filled"], g)
        own = (cols["rank"] - 1) // whole == cols["part"]
        out = cols | {"stuck": stuck_runs(v, g)} | {f"d{k}": d for k, d in enumerate(sizes)} | {f"m{k}": m for k, m in enumerate(reach)}
        arrays = [pa.array(out[n.name][own].astype(n.type.to_pandas_dtype()), n.type, from_pandas=n.type == pa.float64() and n.name != "v") for n in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(np.any([table[k].to_numpy()[1:] != table[k].to_numpy()[:-1] for k in keys], axis=0)) + 1
        if len(starts):  # the last part may go on in the next batch
            yield run(table.slice(0, int(starts[-1])).combine_chunks())
            held = table.slice(int(starts[-1])).to_batches()
    if held and sum(b.num_rows for b in held):
        yield run(pa.Table.from_batches(held).combine_chunks())


def at_shares(long: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Per key (``keys, value``) the value at each share of its values in order, as ``Segments.ranks``: equal values are counted first, and counts
    added up over ranges, so that no task holds a key."""
    counts = long.where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    up_to = running(counts, keys, "value", {"upto": "n"})
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"))
    joined = up_to.join(sizes, [*keys])
    return joined.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("size") * p), F.lit(1)), F.col("value"))).alias(n) for n, p in shares.items()))


def judged_in_parts(given: DataFrame, times: DataFrame, whole: int) -> DataFrame:
    """Faulty readings of long sources as ``judge`` gives them. A source's readings are ranked over ranges; details are taken in parts of ``whole``
    readings with a halo; scales, quartiles, hours and ranges are those of all its readings, counted before they move."""
    fields = F.array(
        F.when((F.col("kind") == 0) & F.col("v1").isNotNull(), F.struct(F.lit(0).alias("f"), F.col("v1").alias("v"), F.col("v2").alias("high"))),
        F.when((F.col("kind") == 1) & F.col("v1").isNotNull(), F.struct(F.lit(1).alias("f"), F.col("v1").alias("v"), F.lit(None).cast("double").alias("high"))),
        F.when((F.col("kind") == 1) & F.col("v2").isNotNull(), F.struct(F.lit(2).alias("f"), F.col("v2").alias("v"), F.lit(100.0).alias("high"))),
    )
    readings = given.select("db_id", "instance_num", "src", "place", "tie", "row_id", F.explode(F.array_compact(fields)).alias("r")).select("db_id", "instance_num", "src", "place", "tie", "row_id", "r.*")
    once = readings.groupBy(*SOURCE, "place", "tie", "v").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies"), F.max("high").alias("high"))
    known_at = times.groupBy("db_id", "instance_num", "place", "tie").agg(F.max("at").cast("double").alias("at"))
    possible = ~F.isnan("v") & (F.abs("v") != float("inf")) & (F.col("v") >= 0) & ~F.coalesce(F.col("v") > F.col("high"), F.lit(False))
    rows = once.withColumn("x", F.when(possible, F.col("v"))).drop("high").join(known_at, ["db_id", "instance_num", "place", "tie"], "left").withColumn("one", F.lit(1))
    ranked = running(rows, SOURCE, ["place", "tie", "v"], {"rank": "one"}).drop("one")
    before = carried(ranked, SOURCE, "rank", "x", "last_x")
    before = carried(before, SOURCE, "rank", "at", "last_at")
    after = carried(before.withColumn("back", -F.col("rank")), SOURCE, "back", "at", "next_at").drop("back")
    first = ranked.where("x is not null").groupBy(*SOURCE).agg(F.min_by("x", "rank").alias("first_x"))
    full = join_same(after, first, SOURCE, "left").withColumn("filled", F.coalesce("x", "last_x", "first_x", F.lit(0.0))).withColumn("at", F.coalesce("at", (F.col("last_at") + F.col("next_at")) / 2))
    parts = F.array_distinct(F.array(*(F.greatest(F.floor((F.col("rank") - 1 + d) / whole), F.lit(0)) for d in (-HALO, 0, HALO))))
    spread = full.select(*SOURCE, "place", "tie", "v", "row_id", "copies", "x", "at", "rank", "filled", F.explode(parts).alias("part"))
    placed = spread.repartition(*SOURCE, "part").sortWithinPartitions(*SOURCE, "part", "rank")
    detailed = cut(placed.mapInArrow(lambda batches: detail_parts(batches, whole), PARTED_TYPES))
    long = detailed.select(*SOURCE, F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("x", "d0", "d1", "d2", "d3")))).alias("s")).select(*SOURCE, "s.*")
    shares = at_shares(long, [*SOURCE, "what"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    of = lambda what, q: F.max(F.when(F.col("what") == what, F.col(q)))
    stats = shares.groupBy(*SOURCE).agg(*(of("x", q).alias(q) for q in ("q1", "q2", "q3")), *(of(f"d{k}", "q2").alias(f"s{k}") for k in range(len(LEVELS))))
    far = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"m{k}") > DETAIL * F.col(f"s{k}") / 0.6745, F.lit(False)) for k in range(len(LEVELS))))
    wide = F.greatest(F.col("x") - F.col("q3"), F.col("q1") - F.col("x")) > F.col("q3") - F.col("q1")
    hours = F.floor(F.col("at") / 3600)
    marked = cut(detailed.join(stats, SOURCE, "left").select(*SOURCE, "place", "tie", "v", "row_id", "copies", "x", "stuck", "q2", (F.col("x").isNotNull() & far & F.coalesce(wide, F.lit(False))).alias("odd"), F.pmod(hours, F.lit(24)).alias("hour"), F.floor(hours / 24).alias("day")))
    # candidates that recur at an hour
    at = [*SOURCE, "hour"]
    candidates = marked.where("odd and hour is not null")
    middle = at_shares(candidates.select(*at, F.col("x").alias("value")), at, {"middle": 0.5})
    timed = marked.where("x is not null and hour is not null").join(middle, at)
    near = F.col("odd") & (F.abs(F.col("x") - F.col("middle")) <= PEAK_SPREAD * F.abs("middle"))
    seen = timed.groupBy(*at, "middle", "q2").agg(F.count(F.lit(1)).alias("size"), F.count_if(near).alias("like"), F.min(F.when(near, F.col("day"))).alias("like1"), F.max(F.when(near, F.col("day"))).alias("like2"), F.min("day").alias("day1"), F.max("day").alias("day2"))
    again = (F.col("like1") < F.col("like2")) | ((F.col("day1") == F.col("day2")) & (F.abs("middle") <= MODERATE * F.abs("q2")))
    peaks = seen.where((F.col("like") > 1) & (F.col("like") >= PEAK_SHARE * F.col("size")) & again).select(*at, F.col("middle").alias("peak"))
    told = marked.join(peaks, at, "left").withColumn("odd", F.col("odd") & ~F.coalesce(F.abs(F.col("x") - F.col("peak")) <= PEAK_SPREAD * F.abs("peak"), F.lit(False)))
    ranges = told.groupBy(*SOURCE).agg(F.min(F.when(~F.col("odd"), F.col("x"))).alias("low"), F.max(F.when(~F.col("odd"), F.col("x"))).alias("top"), F.max(F.when(~F.isnan("v"), F.abs("v"))).alias("most"))
    outside = F.greatest(F.col("x") - F.col("top"), F.col("low") - F.col("x"))
    why = F.when(F.col("x").isNull(), 0).when(F.col("stuck"), 1).when(F.col("odd") & (outside > 0) & (outside >= WIDTHS * (F.col("top") - F.col("low"))), 2)
    return told.join(ranges, SOURCE).withColumn("why", why).where((F.col("why").isNotNull()) & (F.coalesce("most", F.lit(1.0)) != 0)).select(*SOURCE, "place", "tie", "v", "row_id", "copies", "why")


def faulty(rows: DataFrame, times: DataFrame, *, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """Faulty readings: ``source_table, field_name, row_id, why``.

    ``rows`` has ``row_id, db_id, instance_num, src`` (a number per source), ``place, tie`` (bigints, the order), ``kind`` (0 or 1), ``v1, v2``:
    of kind 0 a reading ``v1`` with the upper bound ``v2`` (null for none), of kind 1 two readings, the second of at most 100.
    Lower bound is 0. ``times`` has ``db_id, instance_num, place, tie, at`` (seconds), for the hour of the day.

    ``why`` is ``impossible`` (outside the bounds or not finite), ``stuck`` or ``spike``, the first that holds. Null readings are
    none; rows with a null in the instance, source or place hold none. Repeated rows (equal but for ``row_id``) count once in the course and are each
    returned. A source that only reads 0 is idle and has no faulty readings. Readings without a time have the hour between their neighbours'.
    Other columns are ignored. An empty table gives an empty result. The sources of an instance are judged together, in as many groups as its
    snapshots fill blocks of ``block``, at most ``PARTS``; a task holds one group at a time, copies collapsed before they move. A source of more
    than ``whole`` rows is judged in parts. Neither number changes the result.
    """
    entity = ["db_id", "instance_num", "part"]
    given = rows.where("db_id is not null and instance_num is not null and src is not null and place is not null and (v1 is not null or (kind = 1 and v2 is not null))").select("db_id", "instance_num", "src", "place", F.coalesce("tie", F.lit(-1)).alias("tie"), F.col("kind").cast("int").alias("kind"), F.col("v1").cast("double").alias("v1"), F.col("v2").cast("double").alias("v2"), "row_id")
    marks = times.where("at is not null").select("db_id", "instance_num", "place", F.coalesce("tie", F.lit(-1)).alias("tie"), "at")
    long = given.groupBy("db_id", "instance_num", "src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select("db_id", "instance_num", "src")
    split = long.first() is not None
    usual = given.join(long, ["db_id", "instance_num", "src"], "left_anti") if split else given
    single = usual.withColumn("copies", F.lit(1).cast("bigint"))
    moved = single.mapInArrow(collapse, single.schema)
    longest = times.groupBy("db_id", "instance_num").count().agg(F.max("count")).first()[0] or 1
    parts = min(-(-longest // block), PARTS)
    placed = moved.withColumn("part", F.pmod(F.xxhash64("src"), F.lit(parts))).unionByName(marks.withColumn("src", F.lit(None).cast("bigint")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))), allowMissingColumns=True)
    together = placed.repartition(*entity).sortWithinPartitions(*entity)
    seen = together.select(*entity, "src", "place", "tie", "kind", "v1", "v2", "row_id", "copies", F.col("at").cast("double").alias("at")).mapInArrow(judge_partition, JUDGED_TYPES)
    found = seen.select(*SOURCE, "place", "tie", "v", "row_id", "copies", "why")
    if split:
        found = found.unionByName(judged_in_parts(given.join(long, ["db_id", "instance_num", "src"], "left_semi"), marks, whole))
    why = F.element_at(F.array(*map(F.lit, WHY)), F.col("why") + 1)
    verdict = cut(found.withColumn("why", why))
    named = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in FIELDS)), F.col("f") + 1)
    result = lambda df: df.select(named(0).alias("source_table"), named(1).alias("field_name"), "row_id", "why")
    # copies, which are few, by their keys
    g, c = given.alias("g"), verdict.where("copies > 1").select(*SOURCE, "place", "tie", "v", "why").alias("c")
    same_reading = reduce(lambda a, b: a & b, (F.col(f"g.{n}") == F.col(f"c.{n}") for n in ("db_id", "instance_num", "src", "place", "tie")))
    value = F.when(F.col("c.f") == 2, F.col("g.v2")).otherwise(F.col("g.v1"))
    copies = g.join(c, same_reading).where((F.col("g.kind") == F.least(F.col("c.f"), F.lit(1))) & value.eqNullSafe(F.col("c.v"))).select("c.f", "g.row_id", "c.why")
    return result(verdict.where("copies = 1")).unionByName(result(copies))


def snapshot_readings(profile: DataFrame, waits: DataFrame, instances: DataFrame, snaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and times for ``faulty`` of load_profile.per_second, wait_events.total_wait_time_s and wait_events.pct_dbtime.

    A source is told by a 64-bit hash of its kind and name within its instance. The bound of ``DB CPU(s)`` is the instance's cpus.
    """
    cpus = instances.groupBy("db_id", "instance_num").agg(F.max("cpus").cast("double").alias("cpus"))
    at = [F.col("db_id").cast("bigint").alias("db_id"), F.col("instance_num").cast("int").alias("instance_num")]
    order = [F.col("begin_snap_id").alias("place"), F.col("end_snap_id").alias("tie")]
    load = profile.join(cpus, ["db_id", "instance_num"], "left").where("stat_name is not null").select("row_id", *at, F.xxhash64(F.lit(0), "stat_name").alias("src"), *order, F.lit(0).alias("kind"), F.col("per_second").alias("v1"), F.when(F.col("stat_name") == "DB CPU(s)", F.col("cpus")).alias("v2"))
    wait = waits.where("event is not null").select("row_id", *at, F.xxhash64(F.lit(1), "wait_kind", "event").alias("src"), *order, F.lit(1).alias("kind"), F.col("total_wait_time_s").alias("v1"), F.col("pct_dbtime").alias("v2"))
    times = snaps.select(*at, *order, F.unix_seconds(utc_time("end_snap_time")).alias("at"))
    return load.unionByName(wait), times
