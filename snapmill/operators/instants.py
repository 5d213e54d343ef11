"""Mixed timestamp forms and time zones, normalised to UTC.

A text's shape mask replaces digits by ``9`` and letters by ``a``. Each distinct mask of a batch is mapped to a reader once; the
reader's slices then apply to all rows of that mask as one byte matrix. Wall clocks become UTC by searching zone transition
tables, made for the years that occur from the one version of the time zone data that the driver sends to all workers.
"""

from __future__ import annotations

import importlib.resources
import io
import re
import zoneinfo
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No form is longer but for the digits of its fraction, which longer texts lose from the tenth on.
LONGEST = 64
FRACTION = re.compile(r"(?<=[.,]\d{9})\d+")
MONTHS = {m: i + 1 for i, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])}
UNIVERSAL = ("UTC", "GMT", "Z", "UT")
MONTH_FIRST = "AMERICA"
#: A zone table covers the years of a span; spans are so long.
SPAN = 32
#: Spans in which an abbreviation is looked for that the time's own span doesn't know: standard time is younger, and later years repeat the last rule.
SPANS = range(1850 // SPAN, 2100 // SPAN + 1)

_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,]9+)?)?"
_DOTS = r"(?P<h>99?)\.(?P<mi>99)\.(?P<s>99)(?:\.9+)?"
_ZONE = r"(?: ?(?P<off>[+-]99:?99)|(?P<z>a)| (?P<name>a[a/_+9-]*))?"
_LATER = r"(?: (?P<off>[+-]99:?99)| (?P<name>a[a/_+9-]*))?"
#: Forms over masks, tried in this order; a T between date and time is checked in the text.
FORMS = [re.compile(p) for p in (
    r"(?P<epoch>9{10}|9{13}|9{16})",
    rf"(?P<y>9999)-(?P<mo>99)-(?P<d>99)(?: |(?P<t>a)){_TIME}{_ZONE}",
    rf"(?P<y>9999)(?P<mo>99)(?P<d>99)(?:(?P<t>a))?(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,]9+)?{_ZONE}",
    rf"(?P<d>99?)-(?P<mon>aaa)-(?P<y>9999|99) (?:{_DOTS}|(?P<h2>99?):(?P<mi2>99)(?::(?P<s2>99)(?:[.,]9+)?)?) (?P<ap>aa){_LATER}",
    rf"(?P<d>99?)-(?P<mon>aaa)-(?P<y>9999|99) (?:{_DOTS}|(?P<h2>99?):(?P<mi2>99)(?::(?P<s2>99)(?:[.,]9+)?)?){_ZONE}",
    rf"(?P<p>99?)/(?P<q>99?)/(?P<y>9999|99) {_TIME} (?P<ap>aa){_LATER}",
    rf"(?P<p>99?)/(?P<q>99?)/(?P<y>9999|99) {_TIME}{_ZONE}",
    rf"aaa (?P<mon>aaa) (?P<d> ?9|99) {_TIME}(?: (?P<name>aa+))? (?P<y>9999)",
)]
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[48:58] = 57
SHAPE[65:91] = SHAPE[97:123] = 97
SHAPE[128:] = 63


class Zones:
    """Time zone data by name, with its version: what the driver has, or what it sent."""

    version: str | None = None
    files: dict[str, bytes] | None = None

    @classmethod
    def use(cls, version: str, files: dict[str, bytes]) -> None:
        if cls.files is None or cls.version != version:
            cls.version, cls.files = version, files
            transitions.cache_clear()

    @classmethod
    def get(cls, name: str) -> zoneinfo.ZoneInfo | None:
        try:
            if cls.files is None:
                return zoneinfo.ZoneInfo(name)
            return zoneinfo.ZoneInfo.from_file(io.BytesIO(cls.files[name]), key=name)
        except (KeyError, zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
            return None


def zone_version() -> str:
    """The version of the time zone data that the zone tables are made from."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            path = Path(folder, name)
            if path.exists():
                return path.open().readline().replace("# version", "").strip()
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:  # noqa: BLE001
        return "unknown"


def zone_files() -> dict[str, bytes]:
    """The files of all zones that this machine knows, about a megabyte."""
    out = {}
    for name in zoneinfo.available_timezones():
        path = next((x for x in (Path(f, name) for f in zoneinfo.TZPATH) if x.is_file()), None)
        try:
            out[name] = (path or importlib.resources.files("tzdata").joinpath("zoneinfo", *name.split("/"))).read_bytes()
        except (OSError, ModuleNotFoundError):
            continue
    return out


@cache
def transitions(zone: str, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a zone in the years of a span: wall clocks (seconds) from which each offset holds, the offsets, and their abbreviations.

    At a change the earlier reading of a repeated hour and, for a skipped one, the offset before the change hold: either way the
    new offset begins at the instant of the change read with the larger of both offsets. None for an unknown zone.
    """
    info = Zones.get(zone)
    if info is None:
        return None
    epoch = datetime(1970, 1, 1, tzinfo=UTC)

    def at(second: int) -> tuple[int, str]:
        t = (epoch + timedelta(seconds=second)).astimezone(info)
        return int(t.utcoffset().total_seconds()), t.tzname()

    first, last = max(span * SPAN, 1), min(span * SPAN + SPAN, 9999)
    step = 5 * 86400
    begin, end = (int((datetime(y, 1, 1, tzinfo=UTC) - epoch).total_seconds()) for y in (first, last))
    begin, end = (begin - step if first > 1 else begin + 2 * 86400), end + (step if last < 9999 else 363 * 86400)
    here = at(begin)
    walls, offsets, names = [np.iinfo(np.int64).min], [here[0]], [here[1]]
    for lower in range(begin, end, step):
        low, high = lower, min(lower + step, end)
        there = at(high)
        if there == here:
            continue
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if at(middle) == here else (low, middle)
        there = at(high)
        walls.append(high + max(here[0], there[0]))
        offsets.append(there[0])
        names.append(there[1])
        here = there
    return np.array(walls), np.array(offsets), np.array(names, object)


def offsets_of(zone: str, wall: np.ndarray, year: np.ndarray) -> np.ndarray | None:
    """The zone's offsets at wall clocks, None if the zone is unknown."""
    out = np.zeros(len(wall), np.int64)
    for span in np.unique(year // SPAN):
        table, own = transitions(zone, int(span)), year // SPAN == span
        if table is None:
            return None
        out[own] = table[1][np.searchsorted(table[0], wall[own], "right") - 1]
    return out


def offsets_named(zone: str | None, name: str, wall: np.ndarray, year: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The offsets that an abbreviation stands for in a zone at wall clocks, and whether it stands for any: the one in force if it has
    that name, else the nearest in time that has."""
    out, known = np.zeros(len(wall), np.int64), np.zeros(len(wall), bool)
    if name in UNIVERSAL:
        return out, ~known
    for span in np.unique(year // SPAN) if zone else ():
        own = np.flatnonzero(year // SPAN == span)
        table = None
        for near in (int(span), *sorted(SPANS, key=lambda x: abs(x - span))):  # noqa: B023
            table = transitions(zone, near)
            if table is None or (table[2] == name).any():
                break
        if table is None or not (table[2] == name).any():
            continue
        starts = table[0].astype(float)
        ends = np.append(starts[1:], np.inf)
        has = np.flatnonzero(table[2] == name)
        far = np.maximum(np.maximum(starts[has][None, :] - wall[own][:, None], wall[own][:, None] - ends[has][None, :] + 1), 0)
        out[own], known[own] = table[1][has[far.argmin(1)]], True
    return out, known


@cache
def reader(mask: str) -> dict[str, slice] | None:
    """The slices of a mask's parts, None if no form has that mask."""
    for form in FORMS:
        if m := form.fullmatch(mask):
            return {k.rstrip("2"): slice(*m.span(k)) for k, v in m.groupdict().items() if v is not None}
    return None


def number(cells: np.ndarray) -> np.ndarray:
    """Whole numbers of a byte matrix of digits, blanks read as 0."""
    total = np.zeros(len(cells), np.int64)
    for k in range(cells.shape[1]):
        total = total * 10 + np.where(cells[:, k] == 32, 0, cells[:, k].astype(np.int64) - 48)
    return total


def words(cells: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(cells).view(f"S{cells.shape[1]}").ravel()


def by_word(values: np.ndarray, of: dict, other: int) -> np.ndarray:
    unique, at = np.unique(values, return_inverse=True)
    return np.array([of.get(u.decode("ascii", "replace").lower(), other) for u in unique], np.int64)[at]


def read_times(texts: pd.Series, zones: pd.Series, territories: pd.Series) -> tuple[np.ndarray, list[str | None], list[str | None]]:
    """UTC seconds (the least int64 where no time is named), masks, and what gave the offset."""
    n, none = len(texts), np.iinfo(np.int64).min
    out, masks, how = np.full(n, none), np.full(n, None, object), np.full(n, None, object)
    plain = texts.fillna("").astype(str).str.strip()
    long = plain.str.len() > LONGEST
    if long.any():
        plain = plain.where(~long, plain[long].map(lambda t: FRACTION.sub("", t)))
        plain = plain.where(plain.str.len() <= LONGEST, "")
    matrix = np.array([t.encode("ascii", "replace") for t in plain], f"S{LONGEST}").view(np.uint8).reshape(n, LONGEST) if n else np.zeros((0, LONGEST), np.uint8)
    shapes = words(SHAPE[matrix]) if n else np.zeros(0, "S1")
    zone_of, territory_of = zones.to_numpy(object), territories.fillna("").to_numpy(object)
    for shape in np.unique(shapes):
        rows = np.flatnonzero(shapes == shape)
        mask = shape.decode("ascii", "replace")
        masks[rows] = mask
        if (parts := reader(mask)) is None:
            continue
        text = matrix[rows]
        cell = lambda name: number(text[:, parts[name]])  # noqa: B023, E731
        if "epoch" in parts:
            width = parts["epoch"].stop
            out[rows] = cell("epoch") // 10 ** (width - 10)
            how[rows] = "epoch"
            continue
        good = np.ones(len(rows), bool)
        if "t" in parts:
            good &= np.isin(text[:, parts["t"].start], (84, 116))
        year = cell("y")
        if parts["y"].stop - parts["y"].start == 2:
            year = np.where(year < 50, 2000, 1900) + year
        if "mon" in parts:
            month, day = by_word(words(text[:, parts["mon"]]), MONTHS, 0), cell("d")
        elif "p" in parts:
            p, q = cell("p"), cell("q")
            american = territory_of[rows] == MONTH_FIRST
            month, day = np.where(american, p, q), np.where(american, q, p)
        else:
            month, day = cell("mo"), cell("d")
        hour, minute = cell("h"), cell("mi")
        second = cell("s") if "s" in parts else np.zeros(len(rows), np.int64)
        if "ap" in parts:
            half = by_word(words(text[:, parts["ap"]]), {"am": 0, "pm": 12}, -1)
            good &= (half >= 0) & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + np.maximum(half, 0)
        good &= (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60)
        months = (np.where(good, year, 1970) - 1970) * 12 + np.where(good, month, 1) - 1
        start = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
        length = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - start
        good &= day <= length
        wall = (start + day - 1) * 86400 + hour * 3600 + minute * 60 + second
        offset, known, means = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), "zone"
        if "off" in parts:
            digits = text[:, parts["off"]][:, [1, 2, -2, -1]]
            hours, minutes = number(digits[:, :2]), number(digits[:, 2:])
            offset = np.where(text[:, parts["off"].start] == 45, -1, 1) * (hours * 3600 + minutes * 60)
            known, means = (hours <= 18) & (minutes < 60), "offset"
        elif "z" in parts:
            known, means = np.isin(text[:, parts["z"].start], (90, 122)), "offset"
        else:
            named = words(text[:, parts["name"]]).astype(str).astype(object) if "name" in parts else zone_of[rows]
            means = "named" if "name" in parts else "instance"
            own = zone_of[rows]
            pairs = pd.Series(list(zip(named, own, strict=True)))
            for pair, at in pairs.groupby(pairs, sort=False).indices.items() if len(pairs) else ():
                name, home = (x if isinstance(x, str) else None for x in pair)
                if name is None:
                    continue
                if "name" in parts and (name.upper() in UNIVERSAL or "/" not in name):
                    offset[at], known[at] = offsets_named(home, name.upper(), wall[at], year[at])
                elif (found := offsets_of(name, wall[at], year[at])) is not None:
                    offset[at], known[at] = found, True
        good &= known
        out[rows] = np.where(good, wall - offset, none)
        how[rows[good]] = means
    return out, list(masks), list(how)


def to_utc(times: DataFrame, instances: DataFrame) -> DataFrame:
    """Every row of ``times`` (``source_table, row_id, db_id, instance_num, text``) with the instant its text names.

    Returns ``source_table, row_id, utc_time, mask, how, tz_version``. ``utc_time`` (``YYYY-MM-DDTHH:MM:SSZ``) is null where the
    text is null, empty, of no known form, no real calendar time, names a zone that is unknown, or has none
    while the instance has none either. ``how`` says what gave the offset: epoch, offset, named or instance. ``instances`` gives
    ``time_zone`` and ``nls_territory`` by ``db_id, instance_num``; repeated rows of it count once and the greatest non-null value
    holds where they differ; a null key matches a null key. Repeated rows of ``times`` are each returned. Other columns are
    ignored. Empty tables give an empty result. The join is left to Catalyst, which broadcasts the instances only below its size
    threshold; beyond it, AQE splits a hot instance.
    """
    zones = instances.groupBy(F.col("db_id").alias("_d"), F.col("instance_num").alias("_n")).agg(F.max("time_zone").alias("time_zone"), F.max("nls_territory").alias("nls_territory"))
    rows = times.select("source_table", "row_id", "db_id", "instance_num", F.col("text").cast("string").alias("text"))
    joined = rows.join(zones, F.col("db_id").eqNullSafe(F.col("_d")) & F.col("instance_num").eqNullSafe(F.col("_n")), "left").select("source_table", "row_id", "text", "time_zone", "nls_territory")
    version = zone_version()
    sent = times.sparkSession.sparkContext.broadcast(zone_files())  # the zone database, about a megabyte

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Zones.use(version, sent.value)
        for f in frames:
            seconds, masks, how = read_times(f["text"], f["time_zone"], f["nls_territory"])
            good = seconds != np.iinfo(np.int64).min
            stamp = np.full(len(f), None, object)
            stamp[good] = [f"{x}Z" for x in np.datetime_as_string(seconds[good].astype("datetime64[s]"))]
            yield pd.DataFrame({"source_table": f["source_table"], "row_id": f["row_id"], "utc_time": stamp, "mask": masks, "how": how, "tz_version": version})

    return joined.mapInPandas(run, "source_table string, row_id bigint, utc_time string, mask string, how string, tz_version string")


def time_fields(snaps: DataFrame, instances: DataFrame, alerts: DataFrame) -> DataFrame:
    """The three tables' time texts as ``source_table, row_id, db_id, instance_num, text``."""
    parts = ((snaps, "snap_info", "begin_snap_time"), (instances, "db_instance", "startup_time"), (alerts, "alertlog_event", "timestamp"))
    first, *others = (t.select(F.lit(n).alias("source_table"), F.col("row_id").cast("bigint").alias("row_id"), F.col("db_id").cast("bigint").alias("db_id"), F.col("instance_num").cast("int").alias("instance_num"), F.col(c).alias("text")) for t, n, c in parts)
    for other in others:
        first = first.unionByName(other)
    return first
