"""Helpers shared by the operators: loading, checkpointing and ranking without one task per key."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

#: Lines of one log that are read together.
BLOCK = 4096


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the driver's folder; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as run at once, if the table is so small that it is read in fewer; a larger one is left as it is
    read, so that only tables of some input splits are ever moved for this."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    The folder comes from ``spark.checkpoint.dir``; a temporary one is set only where the session names none and runs on one machine, as in
    tests. A cluster without a shared folder is refused.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="snapmill"))
    return df.checkpoint()


def collapsed(df: DataFrame) -> DataFrame:
    """``df`` with equal rows of a batch once: copies that would meet in one task don't travel there. Equal rows of different
    batches stay, so what follows must still drop them. Columns are of plain types."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            yield from pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([]).select(names).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)


def utc_time(text: str) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` as an instant of UTC, whatever the session's time zone; null for anything else."""
    return F.try_to_timestamp(F.concat(F.col(text), F.lit(" +00:00")), F.lit("yyyy-MM-dd HH:mm:ss XXX"))


def utc_text(at: str) -> Column:
    """An instant as UTC's ``YYYY-MM-DD HH:MM:SS``, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.col(at), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` in which nulls are equal; the keys come out once, as the left side has them."""
    other = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))


def _changes(batch: pa.RecordBatch, keys: Sequence[str], last: tuple | None) -> np.ndarray:
    """Where a row's key differs from that of the row before, nulls equal to nulls; ``last`` is the key before the batch."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last != tuple(batch[k][0].as_py() for k in keys)
    for k in keys if batch.num_rows > 1 else ():
        a, b = batch[k].slice(0, batch.num_rows - 1), batch[k].slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def _in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None) -> DataFrame:
    """``df`` in ranges of key and order with about as many rows each, whatever the values: a key with most rows, or with values far apart, is
    spread like any other."""
    return df.repartitionByRange(*([partitions] if partitions else []), *keys, *order).sortWithinPartitions(*keys, *order)


def _marked(batches: Iterator[pa.RecordBatch], step: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each batch with the columns that ``step`` adds, the task's number, and ``_pos``: 1 for the first row, 2 for the last, 3 for both."""
    task, held, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held
        pos = np.zeros(batch.num_rows, np.int32)
        pos[0] += first
        first = False
        held = pa.RecordBatch.from_arrays([*batch.columns, *step(batch), pa.array(np.full(batch.num_rows, task, np.int32)), pa.array(pos)], names=names)
    if held is not None:
        pos = held["_pos"].to_numpy().copy()
        pos[-1] += 2
        yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(pos)], names=names)


def _bounds(held: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> list[tuple[int, tuple, tuple, bool]]:
    """Of each task in order its number, its first and last key, and the given columns of its last row: few rows a task reach the driver."""
    rows = held.where("_pos > 0").select("_task", "_pos", F.struct(*keys).alias("k"), F.struct(*columns).alias("c")).collect()
    first = {r["_task"]: tuple(r["k"]) for r in rows if r["_pos"] & 1}
    return [(r["_task"], first[r["_task"]], tuple(r["k"]), tuple(r["c"])) for r in sorted(rows, key=lambda r: r["_task"]) if r["_pos"] & 2]


def running(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Adds running totals per key in ``order``, without one task per key.

    ``df`` holds one row per key and order value (of one column or several). Its rows go to ranges of key and order of like size; a task adds up its own range, and
    what a key had in the ranges before, one number a task, is added then. ``sums`` maps a new column to the column whose total it holds,
    the row itself included, nulls as 0.
    """
    names = [*df.columns]
    kinds = {n: "double" if df.schema[c].dataType.simpleString() in ("double", "float") else "bigint" for n, c in sums.items()}
    schema = StructType([*df.schema, *(StructField(n, DoubleType() if t == "double" else LongType()) for n, t in kinds.items()), StructField("_head", BooleanType()), StructField("_task", IntegerType()), StructField("_pos", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        carry: dict[str, float] = dict.fromkeys(sums, 0)
        head = True

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal last, head
            fresh = _changes(batch, keys, last)
            if last is None:
                fresh[0] = False
            segment = np.cumsum(fresh)
            out = []
            for n, c in sums.items():
                values = pc.fill_null(batch[c], 0).to_numpy(zero_copy_only=False).astype(np.float64 if kinds[n] == "double" else np.int64)
                total = np.cumsum(values)
                starts = np.flatnonzero(fresh)
                base = np.concatenate(([-carry[n]], total[starts] - values[starts]))
                total = total - base[segment]
                carry[n] = total[-1]
                out.append(pa.array(total))
            heads = (segment == 0) & head
            head = bool(heads[-1])
            last = tuple(batch[k][batch.num_rows - 1].as_py() for k in keys)
            return [*out, pa.array(heads)]

        yield from _marked(batches, step, schema.names)

    held = cut(_in_order(df, keys, [order] if isinstance(order, str) else order, partitions).mapInArrow(run, schema))
    rows, key, carry = [], None, [0] * len(sums)
    for task, first, last, totals in _bounds(held, keys, [*sums]):
        offset = carry if first == key else [0] * len(sums)
        rows.append((task, *offset))
        carry = [a + b for a, b in zip(offset, totals, strict=True)] if first == last else [*totals]
        key = last
    offsets = df.sparkSession.createDataFrame(rows, ", ".join(["_task int", *(f"_o_{n} {t}" for n, t in kinds.items())]))
    # one row per task
    return held.join(F.broadcast(offsets), "_task").select(*names, *((F.col(n) + F.when(F.col("_head"), F.col(f"_o_{n}")).otherwise(0)).cast(t).alias(n) for n, t in kinds.items()))


def carried(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` of the key before the row in ``order``, range by range as in ``running``.

    ``df`` holds one row per key and order value.
    """
    names = [*df.columns]
    kind = df.schema[value].dataType
    schema = StructType([*df.schema, StructField("_before", kind), StructField("_head", BooleanType()), StructField("_task", IntegerType()), StructField("_pos", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        known: pa.Scalar | None = None
        head = True

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal last, known, head
            n = batch.num_rows
            fresh = _changes(batch, keys, last)
            if last is None:
                fresh[0] = False
            segment, places = np.cumsum(fresh), np.arange(n)
            valid = batch[value].is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(valid, places, -1))
            before = np.concatenate(([-1], at[:-1]))
            start = np.maximum.accumulate(np.where(fresh, places, 0))
            before[before < start] = -1
            took = pc.take(batch[value], pa.array(before, mask=before < 0))
            if known is not None and known.is_valid:  # what the batches before left to the first key
                took = pc.if_else(pa.array((before < 0) & (segment == 0)), known, took)
            heads = (segment == 0) & head
            head = bool(heads[-1])
            known = batch[value][n - 1] if valid[-1] else took[n - 1]
            last = tuple(batch[k][n - 1].as_py() for k in keys)
            return [took, pa.array(heads)]

        yield from _marked(batches, step, schema.names)

    held = cut(_in_order(df, keys, [order] if isinstance(order, str) else order, partitions).mapInArrow(run, schema))
    rows, key, carry = [], None, None
    for task, first, last, (own, before) in _bounds(held, keys, [value, "_before"]):
        offset = carry if first == key else None
        rows.append((task, offset))
        end = before if own is None else own
        carry = offset if end is None and first == last else end
        key = last
    offsets = df.sparkSession.createDataFrame(rows, StructType([StructField("_task", IntegerType()), StructField("_o", kind)]))
    # one row per task
    return held.join(F.broadcast(offsets), "_task").select(*names, F.coalesce("_before", F.when(F.col("_head"), F.col("_o"))).alias(out))
