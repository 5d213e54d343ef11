"""Rows that fail to parse: comma-separated records split into typed cells or rejected with one reason.

Structural indexing: the records of an Arrow batch are one byte buffer. A mask of its quotes and the parity of their running
count tell which commas are delimiters; record ends are the string offsets. Counts and type checks then run on whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, COMMA = 34, 44
REASONS = ("quoting", "column_count", "invalid_value")
BLANKS = " \t\r\n"


@dataclass(frozen=True)
class Layout:
    """Names and kinds of a record's cells: ``whole``, ``grouped`` (whole, thousands commas allowed), ``number``, ``pct``,
    ``text``; a kind that ends in ``?`` may be empty."""

    cells: tuple[tuple[str, str], ...]


LAYOUTS = {
    "host_cpu": Layout((("db_id", "whole"), ("begin_snap_id", "whole"), ("cpus", "whole"), ("cores", "whole"), ("sockets", "whole"), ("load_avg_begin", "number?"), ("load_avg_end", "number?"), ("pct_user", "pct"), ("pct_system", "pct"), ("pct_wio", "pct"), ("pct_idle", "pct"))),
    "wait_events": Layout((("db_id", "whole"), ("begin_snap_id", "whole"), ("event", "text"), ("waits", "grouped"), ("total_wait_time_s", "number"), ("avg_wait", "number"), ("pct_dbtime", "pct"))),
}
SQL_TYPE = {"whole": "bigint", "grouped": "bigint", "number": "double", "pct": "double", "text": "string"}
WHOLE = r"^\+?[0-9]+$"
GROUPED = r"^\+?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)$"
NUMBER = r"^\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def structure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of records in one buffer: which have broken quoting, their numbers of cells, the positions of the delimiters, and which
    bytes are content (neither delimiters nor quotes of the notation)."""
    n, size = len(offsets) - 1, len(data)
    quote = data == QUOTE
    count = np.concatenate(([0], np.cumsum(quote, dtype=np.int64)))  # quotes before a position
    record = np.repeat(np.arange(n), np.diff(offsets))
    inside = ((count[:-1] - count[offsets[:-1]][record]) & 1).astype(bool) if n else np.zeros(0, bool)  # before the byte
    delimiter = (data == COMMA) & ~inside
    first, last = np.zeros(size, bool), np.zeros(size, bool)
    full = np.diff(offsets) > 0
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    before_ok = first | np.concatenate(([False], (delimiter | quote)[:-1]))
    before_ok[first] = True
    after = np.concatenate(((delimiter | quote)[1:], [False]))
    after_ok = after | last
    wrong = quote & np.where(inside, ~after_ok, ~before_ok)
    broken = ((count[offsets[1:]] - count[offsets[:-1]]) & 1).astype(bool)
    if wrong.any():
        broken[np.unique(record[wrong])] = True
    cells = np.add.reduceat(np.concatenate((delimiter, [False])).astype(np.int64), offsets[:-1]) if n else np.zeros(0, np.int64)
    cells = np.where(full, cells, 0) + 1
    doubled = quote & ~inside & ~first & np.concatenate(([False], quote[:-1]))  # the second of two: its first was read inside
    content = ~delimiter & (~quote | doubled)
    return broken, cells, np.flatnonzero(delimiter), content


def valid(column: pa.Array, kind: str) -> np.ndarray:
    """Which trimmed cells are readable as ``kind``."""
    optional, kind = kind.endswith("?"), kind.rstrip("?")
    empty = pc.equal(column, "").to_numpy(zero_copy_only=False)
    if kind == "text":
        good = ~empty
    elif kind in ("whole", "grouped"):
        good = pc.match_substring_regex(column, WHOLE if kind == "whole" else GROUPED).to_numpy(zero_copy_only=False).copy()
        digits = pc.utf8_ltrim(pc.replace_substring(column, ",", ""), "+0")
        size = pc.binary_length(digits).to_numpy(zero_copy_only=False)
        top = pc.greater(digits, str(2**63 - 1)).to_numpy(zero_copy_only=False)
        good &= (size < 19) | ((size == 19) & ~top)
    else:
        good = pc.match_substring_regex(column, NUMBER).to_numpy(zero_copy_only=False).copy()
        at = np.flatnonzero(good)
        values = np.array(column.take(pa.array(at)).to_pylist(), str).astype(float) if len(at) else np.zeros(0)
        good[at] = np.isfinite(values) & ((values <= 100) if kind == "pct" else True)
    return good | empty if optional else good & ~empty


def read_batch(lines: pa.Array, sections: pa.Array, layouts: dict[str, Layout]) -> tuple[np.ndarray, pa.Array]:
    """Reason codes (index into REASONS, -1 if readable) and lists of the cells, null for records that aren't readable."""
    lines = pc.fill_null(lines.cast(pa.large_string()), "")
    n = len(lines)
    reason, place, parts = np.full(n, 1), np.zeros(n, np.int64), [pa.array([None], pa.list_(pa.large_string()))]
    names = pc.fill_null(sections.cast(pa.string()), "").to_numpy(zero_copy_only=False)
    for name in set(names) - set(layouts):  # no layout, so no number of cells can be right
        at = np.flatnonzero(names == name)
        part = pa.concat_arrays([lines.take(pa.array(at))])
        reason[at[structure(*buffer(part))[0]]] = 0
    for name, layout in layouts.items():
        at = np.flatnonzero(names == name)
        if not len(at):
            continue
        data, offsets = buffer(lines.take(pa.array(at)))
        broken, counts, _, _ = structure(data, offsets)
        reason[at] = np.where(broken, 0, np.where(counts != len(layout.cells), 1, -1))
        good = at[reason[at] == -1]
        if not len(good):
            continue
        data, offsets = buffer(lines.take(pa.array(good)))
        _, _, delimiters, content = structure(data, offsets)
        width = len(layout.cells)
        ends = np.column_stack((delimiters.reshape(len(good), width - 1), offsets[1:])).ravel()
        kept = np.concatenate(([0], np.cumsum(content, dtype=np.int64)))
        flat = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], kept[ends])).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[content])))
        flat = pc.utf8_trim(flat, BLANKS)
        fine = np.ones(len(good), bool)
        for k, (_, kind) in enumerate(layout.cells):
            fine &= valid(flat.take(pa.array(np.arange(k, len(flat), width))), kind)
        reason[good[~fine]] = 2
        place[good[fine]] = sum(map(len, parts)) + np.flatnonzero(fine)
        parts.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), flat))
    return reason, pa.concat_arrays(parts).take(pa.array(place))


def buffer(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and their offsets from 0."""
    lines = pa.concat_arrays([lines]) if not isinstance(lines, pa.ChunkedArray) else lines.combine_chunks()
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if lines.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def parse_records(df: DataFrame, layouts: dict[str, Layout] = LAYOUTS, *, id_col: str = "row_id", section_col: str = "section_name", line_col: str = "line", file_col: str = "file_name") -> DataFrame:
    """One row per input row: ``row_id, section_name, file_name, reason, cells``.

    ``reason`` is null for a readable record, whose unquoted, trimmed ``cells`` are then given; otherwise it is the first of
    ``quoting``, ``column_count`` and ``invalid_value`` that holds and ``cells`` is null. A null line counts as an empty one,
    which has one empty cell. A null or unknown section has no layout, so its lines are ``column_count`` at best. Equal rows
    are each reported. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reason, cells = read_batch(batch.column(3), batch.column(1), layouts)
            words = pa.array([None if r < 0 else REASONS[r] for r in reason], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), words, cells.cast(pa.list_(pa.string()))], ["row_id", "section_name", "file_name", "reason", "cells"])

    own = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(section_col).cast("string").alias("section_name"), F.col(file_col).cast("string").alias("file_name"), F.col(line_col).cast("string").alias("line"))
    return own.mapInArrow(run, "row_id bigint, section_name string, file_name string, reason string, cells array<string>")


def rejected(parsed: DataFrame) -> DataFrame:
    """Unreadable rows of ``parse_records``: ``row_id, reason``."""
    return parsed.where(F.col("reason").isNotNull()).select("row_id", "reason")


def typed(parsed: DataFrame, section: str, layouts: dict[str, Layout] = LAYOUTS) -> DataFrame:
    """Readable rows of one section of ``parse_records`` with typed columns."""
    good = parsed.where(F.col("reason").isNull() & (F.col("section_name") == section))
    columns = []
    for k, (name, kind) in enumerate(layouts[section].cells):
        cell = F.col("cells")[k]
        kind = kind.rstrip("?")
        cell = F.regexp_replace(cell, ",", "") if kind == "grouped" else cell
        columns.append((F.when(cell != "", cell).cast(SQL_TYPE[kind])).alias(name))
    return good.select("row_id", "file_name", *columns)


def reject_report(parsed: DataFrame) -> DataFrame:
    """Rows by file, section and reason (``ok`` for readable ones): the share of a file that is unusable."""
    return parsed.groupBy("file_name", "section_name", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
