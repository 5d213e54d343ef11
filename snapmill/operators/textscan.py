"""Log and operating-system texts: times carried forward, blocks, alert events, AIX processor readings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapmill.common import carried
from snapmill.functions.text import PARSE_ERROR, TOO_MANY, alert_event

# Patterns of times at the beginning of a line, and of what a parse-error block says.
ISO = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)?"
SQL_HASH, SQLID = r"(?i)\bSQL hash=(0x[0-9a-f]+)\b", r"(?i)\bsqlid=([0-9a-z]+)\b"
USERNAME, APPLICATION = r"(?i)\.\.\.Current username=(\S+)", r"(?i)\.\.\.Application:\s*(.*?)\s+Action:\s*(.*)$"
LEGACY = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$"


def line_time(line: Column) -> Column:
    """The time that a line begins with, ISO or the older form, as a timestamp; null for none."""
    iso = F.concat_ws(" ", F.regexp_extract(line, ISO, 1), F.regexp_extract(line, ISO, 2))
    old = F.concat_ws(" ", *(F.regexp_extract(line, LEGACY, g) for g in (4, 1, 2, 3)))
    return F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(old, F.lit("yyyy MMM d HH:mm:ss")))


def with_times(lines: DataFrame, keys: Sequence[str] = ("log_name",)) -> DataFrame:
    """Lines with ``logged_at``: their own time or that of the last line with one. Logs are read in blocks, not each in one task."""
    own = lines.withColumn("_own", line_time(F.col("line")))
    return carried(own, keys, "line_no", "_own", "_last").withColumn("logged_at", F.coalesce("_own", "_last")).drop("_own", "_last")


def time_slice(timed: DataFrame, begin: str, end: str, keys: Sequence[str] = ("log_name",)) -> DataFrame:
    """Lines of ``with_times`` from ``begin`` to a minute after ``end``; of logs without any time all lines."""
    bounds = timed.groupBy(*keys).agg(F.count("logged_at").alias("_n"))
    inside = (F.col("logged_at") >= F.lit(begin).cast("timestamp")) & (F.col("logged_at") < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    return timed.join(bounds, [*keys]).where((F.col("_n") == 0) | inside).drop("_n")


def alert_events(timed: DataFrame, keys: Sequence[str] = ("log_name",)) -> DataFrame:
    """Events of alert-log lines after the first time: ``keys, line_no, logged_at, event, line``."""
    return timed.where("logged_at is not null").withColumn("event", alert_event(F.col("line"))).where("event is not null").select(*keys, "line_no", "logged_at", "event", "line")


def between_days(events: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Events from one day to another, both included, either open."""
    if first and last and first > last:
        raise ValueError("the first day is after the last")
    day = F.to_date("logged_at")
    out = events if first is None else events.where(day >= F.lit(first).cast("date"))
    return out if last is None else out.where(day <= F.lit(last).cast("date"))


def parse_error_blocks(lines: DataFrame, keys: Sequence[str] = ("log_name",), most: int = 6) -> DataFrame:
    """A line on too many parse errors and what follows it: ``most`` lines in all, or up to a line with application and action, or before one
    with a time.

    Returns per block ``keys, line_no, total, sql_hash, code, sqlid, username, application, action``.
    """
    own = lines.withColumn("_own", F.when(F.col("line").rlike(TOO_MANY), F.col("line_no")))
    started = carried(own, keys, "line_no", "_own", "_last").withColumn("block", F.coalesce("_own", "_last")).where("block is not null")
    w = Window.partitionBy(*keys, "block").orderBy("line_no")
    # a block's first lines are kept before anything moves, however many lines follow it
    near = started.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most)
    ends = (F.col("line").rlike(APPLICATION) | line_time(F.col("line")).isNotNull()).cast("int")
    kept = near.withColumn("_ended", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_ended = 0").where(line_time(F.col("line")).isNull())
    part = lambda pattern, group=1: F.max(F.nullif(F.regexp_extract("line", pattern, group), F.lit("")))
    return kept.groupBy(*keys, "block").agg(
        F.min("line_no").alias("line_no"), part(TOO_MANY).cast("bigint").alias("total"), part(SQL_HASH).alias("sql_hash"),
        part(PARSE_ERROR).cast("int").alias("code"), part(SQLID).alias("sqlid"),
        part(USERNAME).alias("username"), part(APPLICATION).alias("application"), part(APPLICATION, 2).alias("action"),
    ).drop("block")


# Processor readings of AIX tools

ESCAPE = re.compile(r"\x1b[^A-Za-z@~]*[A-Za-z@~]?")
READING = ("entc_pct", "cpu_busy_pct", "cpu_user_pct", "cpu_sys_pct", "cpu_wait_pct", "cpu_idle_pct", "physc", "entitled_capacity")
READING_TYPES = "source_file string, line_number int, timestamp_hint string, " + ", ".join(f"{c} double" for c in READING) + ", raw_sample string"
# The names of each reading, lower case without all but letters and digits; the first reading whose pattern is met counts.
READING_NAMES = {
    "entc_pct": r".*entc.*|ec",
    "physc": r"physc|pc|.*physicalprocessor.*|(?!.*percentage).*physicalcpu.*",
    "entitled_capacity": r"ent|entitled|.*entitledcapacity.*|.*entitlement.*",
    "cpu_user_pct": r".*user.*|usr|us",
    "cpu_sys_pct": r"kern|kernel|sy|.*sys|.*system.*",
    "cpu_wait_pct": r".*wait.*|wio|wa",
    "cpu_idle_pct": r".*idle.*|id",
    "cpu_busy_pct": r"busy|lbusy|.*cpubusy.*",
}
# The columns of a screen's total line with the range of each, and the range of what its shares of time add up to.
TOTAL_LINE = {"cpu_user_pct": (0, 100), "cpu_sys_pct": (0, 100), "cpu_wait_pct": (0, 100), "cpu_idle_pct": (0, 100), "physc": (0, 64), "entc_pct": (0, 200)}
TOTAL_SHARES = (80, 120)


@cache
def reading_of(name: str) -> str | None:
    bare = re.sub(r"[^a-z0-9]", "", name.lower())
    return next((reading for reading, names in READING_NAMES.items() if bare and re.fullmatch(names, bare)), None)


def finite(text: str) -> float | None:
    try:
        value = float(text.strip().strip("%[],;:="))
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def fields(line: str) -> list[str]:
    """A line's fields, by commas or blanks, without escape codes and quotes."""
    bare = "".join(" " if c == "\t" else c for c in ESCAPE.sub("", line) if c == "\t" or c.isprintable())
    parts = bare.split(",") if "," in bare else bare.split()
    return [p for p in (p.strip().strip("\"'").strip() for p in parts) if p]


def derived(values: dict[str, float]) -> dict[str, float] | None:
    """With the entitlement used and the busy share where they follow from the rest."""
    if "entc_pct" not in values and values.get("entitled_capacity", 0) > 0 and "physc" in values:
        values["entc_pct"] = values["physc"] / values["entitled_capacity"] * 100
    if "cpu_busy_pct" not in values and 0 <= values.get("cpu_idle_pct", -1) <= 100:
        values["cpu_busy_pct"] = 100 - values["cpu_idle_pct"]
    return values or None


def is_header(parts: list[str]) -> bool:
    return any(finite(p) is None for p in parts) and any(reading_of(p) for p in parts if len(p) > 2 or p.lower() in ("pc", "ec"))


def from_table(header: list[str], parts: list[str]) -> dict[str, float] | None:
    found = {r: v for h, p in zip(header, parts, strict=False) if (v := finite(p)) is not None and (r := reading_of(h))}
    return derived(found) if found else None


def from_pairs(parts: list[str]) -> dict[str, float] | None:
    found: dict[str, float] = {}
    for k, part in enumerate(parts):
        m = re.match(r"([^=:]*)[=:](.*)$", part)
        if m and (v := finite(m[2])) is not None:
            if r := reading_of(m[1]):
                found[r] = v
        elif k + 1 < len(parts) and (v := finite(parts[k + 1])) is not None and (r := reading_of(part)):
            found[r] = v
    return derived(found) if found else None


def from_total(line: str, parts: list[str]) -> dict[str, float] | None:
    """A screen's total line, which says so or is indented, if its first numbers lie in the ranges of the line's columns."""
    if not parts or parts[0].lower() != "total" and not line[:1].isspace():
        return None
    numbers = [v for p in parts if (v := finite(p)) is not None]
    if len(numbers) < len(TOTAL_LINE):
        return None
    values = dict(zip(TOTAL_LINE, numbers, strict=False))
    time = sum(v for c, v in values.items() if c.startswith("cpu_"))
    inside = lambda v, bounds: bounds[0] <= v <= bounds[1]
    if not inside(time, TOTAL_SHARES) or not all(inside(v, TOTAL_LINE[c]) for c, v in values.items()):
        return None
    return values | {"cpu_busy_pct": time - values["cpu_idle_pct"]}


def time_hint(parts: list[str]) -> str | None:
    hints = [p for p in parts[:6] if re.fullmatch(r"\d{1,2}:\d{2}(:\d{2})?|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}", p) or p.startswith("T") and p.lower() != "total"]
    return " ".join(hints) or None


def readings(name: str, text: str) -> list[dict]:
    """Readings of one file, line after line; a row of a table goes by the last header."""
    out, header = [], None
    for number, line in enumerate(text.splitlines(), 1):
        parts = fields(line)
        if not parts:
            continue
        bare = ESCAPE.sub("", line)
        values = from_total(bare, parts)
        if values is None and re.search(r"[=:]\s*[\d.]", bare) and not re.match(r"^\S*\d{1,2}:\d{2}", bare):
            values = from_pairs(parts)
        if values is None and is_header(parts):
            header = parts
            continue
        if values is None and header:
            values = from_table(header, parts)
        if values:
            out.append({"source_file": name, "line_number": number, "timestamp_hint": time_hint(parts), "raw_sample": line.strip()[:240]} | values)
    return out


def aix_readings(files: DataFrame) -> DataFrame:
    """Readings of operating-system files (``path, text``); a file is read as a whole since its rows depend on headers before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in READING_TYPES.split(", ")]
        for f in frames:
            yield pd.DataFrame([r for p, t in zip(f["path"], f["text"], strict=True) for r in readings(p, t or "")], columns=columns)

    return files.select("path", "text").mapInPandas(run, READING_TYPES)


def reading_stats(found: DataFrame) -> DataFrame:
    """Count, least, mean, 95th percentile and greatest of each reading."""
    long = found.unpivot([], list(READING), "reading", "value").where("value is not null")
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return long.groupBy("reading").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.avg("value").alias("mean"), p95.alias("p95"), F.max("value").alias("most"))
