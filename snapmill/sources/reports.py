"""Reports, HTML or text, as documents of the collection schema.

The reader splits a report into tables of cells (HTML) or sections of lines (text); what of them goes where is the two lists of
rules. A file is parsed by one task, files in parallel.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmill.dims import IDLE
from snapmill.sources.collection import INSTANCE, SNAPSHOT

IDLE_BEGINNINGS = frozenset(n[:k] for n in IDLE for k in range(len(n) + 1))


def num(text: str) -> float:
    """A number with thousands commas; 0 for none."""
    try:
        return float(text.strip().replace(",", ""))
    except ValueError:
        return 0.0


def whole(text: str) -> int:
    return max(int(num(text)), 0)


def wait_ms(text: str) -> float:
    """A mean wait in ms, from us, ms or s."""
    m = re.fullmatch(r"\s*([\d.,]+)\s*(us|ms|s|ns)?\s*", text)
    return num(m[1]) * {"ns": 1e-6, "us": 1e-3, "ms": 1.0, "s": 1e3, None: 1.0}[m[2]] if m else 0.0


def unit(text: str, units: dict[str, float]) -> float:
    m = re.fullmatch(r"\s*([\d.,]+)\s*([A-Za-z]*)\s*", text)
    if not m:
        return 0.0
    return num(m[1]) * units.get(m[2], 1.0)


def size_mb(text: str) -> float:
    """Sizes have a comma as decimal sign."""
    return unit(text.replace(",", "."), {"K": 1 / 1024, "M": 1.0, "G": 1024.0, "T": 1024.0**2})


def statement(text: str) -> str:
    start = text.strip().upper()
    return next((k for k in ("UPDATE", "DELETE", "INSERT", "MERGE") if start.startswith(k)), "PL/SQL" if start.startswith(("BEGIN", "DECLARE", "CALL")) else "SELECT")


class Tables(HTMLParser):
    """``found``: each table's summary, header cells and rows of data cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str], list[list[str]]]] = []
        self.open: list[tuple[str, list[str], list[list[str]]]] = []
        self.cell: list[str] | None = None
        self.head = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append((dict(attrs).get("summary") or "", [], []))
        elif tag == "tr" and self.open:
            self.open[-1][2].append([])
        elif tag in ("td", "th"):
            self.cell, self.head = [], tag == "th"

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            text = "".join(self.cell).strip()
            self.cell = None
            if self.open and self.head:
                self.open[-1][1].append(text)
            elif self.open and self.open[-1][2]:
                self.open[-1][2][-1].append(text)
        elif tag == "table" and self.open:
            self.found.append(self.open.pop())


def _wait(c: list[str]) -> dict | None:
    return None if c[0] in IDLE_BEGINNINGS else {"event": c[0], "waits": whole(c[1]), "total_wait_time_s": num(c[3]), "avg_wait": wait_ms(c[4]), "pct_dbtime": num(c[6]), "waitevent_histogram_ms": {}}


def _sql(value: str, per: str, cpu: str = "pct_cpu") -> Callable[[list[str]], dict]:
    return lambda c: {"sql_id": c[7], value: num(c[0]), "executions": whole(c[1]), per: num(c[2]), "pct_total": num(c[3]), cpu: num(c[5]), "pct_io": num(c[6]), "sql_module": c[8]}


def _segment(name: str) -> Callable[[list[str]], dict]:
    def read(c: list[str]) -> dict:
        old = len(c) == 7
        return {"obj": 0 if old else whole(c[5]), "objd": 0 if old else whole(c[6]), "object_name": c[2], "object_type": c[4], "stat_name": name, "stat_vlalue": num(c[5] if old else c[7])}

    return read


def _function(c: list[str]) -> dict:
    units = {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "p": 1e15}
    blank = not c[8].strip()
    return {"reads_data": size_mb(c[1]), "reads_req_s": unit(c[2], units), "reads_data_s": size_mb(c[3]), "writes_data": size_mb(c[4]), "writes_req_s": unit(c[5], units), "writes_data_s": size_mb(c[6]), "waits_count": int(unit(c[7], units)), "avg_time": None if blank else round(wait_ms(c[8]), 6)}


def _cpu(c: list[str]) -> dict:
    n = [num(x) for x in c]
    ids = dict(zip(("cpus", "cores", "sockets"), map(int, n[:3]), strict=False)) if len(c) == 9 else {}
    return ids | dict(zip(("load_avg_begin", "load_avg_end", "pct_user", "pct_system", "pct_wio", "pct_idle"), n[-6:], strict=True))


#: Fixed values and rules. HTML: beginning of the summary after "This table displays ", section, how many cells a row has, what it becomes. A section
#: with ``key`` is a map by that cell; of equal keys the first holds. Of a table that is given twice the last holds.
RULES: tuple[tuple[str, str, Callable[[int], bool], Callable[[list[str]], dict | None], int | None], ...] = (
    ("load profile", "load_profile", lambda n: n == 5, lambda c: {"stat_name": c[0].rstrip(":"), "per_second": num(c[1]), "per_transaction": num(c[2])}, None),
    ("foreground wait class", "wait_classes", lambda n: n == 6, lambda c: {"wait_class": c[0], "waits": whole(c[1]), "total_wait_time_s": num(c[3]), "avg_wait_ms": num(c[4]), "db_time_pct": num(c[5])}, None),
    ("different time model", "time_model_stats", lambda n: n >= 3, lambda c: {"stat_name": c[0], "time_s": num(c[1]), "pct_dbtime": num(c[2])}, None),
    ("Foreground Wait Events", "foreground_wait_events", lambda n: n == 7, _wait, None),
    ("background wait events", "background_wait_events", lambda n: n == 7, _wait, None),
    ("top SQL by elapsed time", "sql_elapsed_time", lambda n: n >= 9, lambda c: {"sql_id": c[6], "elapsed_time_s": num(c[0]), "executions": whole(c[1]), "elpased_time_exec_s": num(c[2]), "pct_total": num(c[3]), "pct_cpu": num(c[4]), "pct_io": num(c[5]), "sql_module": c[7], "sql_type": statement(c[-1])}, None),
    ("top SQL by CPU time", "sql_cpu_time", lambda n: n >= 10, _sql("cpu_time_s", "cpu_time_exec_s"), 7),
    ("top SQL by user I/O", "sql_io_time", lambda n: n >= 10, _sql("io_time_s", "io_time_exec_s"), 7),
    ("top SQL by buffer gets", "sql_gets", lambda n: n >= 10, _sql("buffer_gets", "gets_per_exec"), 7),
    ("top SQL by physical reads", "sql_reads", lambda n: n >= 10, _sql("physical_reads", "reads_per_exec", "cpu_time_pct"), 7),
    ("the Top SQL by Top Wait Events", "top_sql_with_top_events", lambda n: n > 8, lambda c: {"sql_id": c[0], "plan_hash_value": whole(c[1]), "executions": whole(c[2]), "pct_activity": num(c[3]), "event_name": c[4], "pct_event": num(c[5]), "top_row_source": c[6], "pct_row_source": num(c[7])}, 0),
    ("Instance activity statistics", "instance_stats", lambda n: n == 4, lambda c: {"statname": c[0], "total": whole(c[1])}, None),
    ("the IO Statistics for different functions", "io_stats_byfunc", lambda n: n == 9, _function, 0),
    ("dictionary cache", "dictionary_cache", lambda n: n >= 7, lambda c: {"statname": c[0], "get_requests": whole(c[1]), "final_usage": whole(c[6])}, None),
    ("library cache", "library_cache", lambda n: n >= 7, lambda c: {"statname": c[0], "get_requests": whole(c[1]), "get_pct_miss": num(c[2]), "pin_requests": whole(c[3])}, None),
    ("latch statistics", "latch_activity", lambda n: n >= 7, lambda c: {"statname": c[0], "get_requests": whole(c[1]), "get_pct_miss": num(c[2]), "wait_time": num(c[4])}, None),
)
# Segment statistics by what their table is ordered by.
SEGMENTS = ("row lock waits", "logical reads", "physical reads", "physical read requests", "direct physical reads", "physical writes", "physical write requests", "direct physical writes", "buffer busy waits", "global cache buffer busy waits")


def empty(file_name: str) -> dict:
    maps = {"sql_cpu_time", "sql_io_time", "sql_gets", "sql_reads", "top_sql_with_top_events", "io_stats_byfunc"}
    sections = {r[1]: {} if r[1] in maps else [] for r in RULES}
    return {"file_name": file_name, "status": "OK", "snap_info": {}, "instance_efficiency": [], "segment_stats": {}, **sections}


def read_html(file_name: str, text: str) -> dict:
    """``snapshot, instance, sql_text, parameters`` of an HTML report."""
    reader = Tables()
    reader.feed(text)
    doc, instance, texts, parameters, buckets = empty(file_name), {}, {}, {}, {}
    for summary, header, rows in reader.found:
        about = summary.removeprefix("This table displays ")
        for begin, section, wide, build, key in RULES:
            if about.startswith(begin):
                built = [(c, build(c)) for c in rows if wide(len(c))]
                if key is None:
                    doc[section] = [b for _, b in built if b is not None]
                else:
                    named = {}
                    for c, b in built:
                        name = "Buffer Cache Reads" if c[key] == "Buffer Cache Re" else c[key]
                        if name != "TOTAL:":
                            named.setdefault(name, b)
                    doc[section] = named
        if about.startswith("top segments by "):
            name = next((s for s in SEGMENTS if about.startswith(f"top segments by {s}.")), None)
            if name:
                doc["segment_stats"][name] = [_segment(name)(c) for c in rows if len(c) >= 7]
        elif about.startswith("instance efficiency"):
            pairs = [(c[k], c[k + 1]) for c in rows for k in range(0, len(c) - 1, 2)]
            doc["instance_efficiency"] = [{"eff_stat": s.rstrip(":"), "eff_pct": float(p) if re.fullmatch(r"\d+(\.\d+)?", p.replace(",", "")) else None} for s, p in pairs]
        elif about.startswith("system load statistics"):
            doc["host_cpu"] = next((_cpu(c) for c in rows if len(c) in (6, 9)), None)
        elif about.startswith("thread activity"):
            doc["redo_log"] = next(({"stat_name": c[0], "per_hour": num(c[2])} for c in rows if len(c) == 3 and c[0] == "log switches (derived)"), None)
        elif about.startswith("snapshot information"):
            for c in rows:
                if len(c) >= 5 and (side := {"Begin Snap:": "begin", "End Snap:": "end"}.get(c[0])):
                    doc["snap_info"] |= {f"{side}_snap_id": whole(c[1]), f"{side}_snap_time": c[2]}
        elif about.startswith("total number of waits, and information about total wait time"):
            if len(header) == 10:
                for c in rows:
                    if len(c) == 10:
                        buckets[c[0]] = {f"{i}: {h}": num(x) for i, (h, x) in enumerate(zip(header[2:], c[2:], strict=True))}
        elif about.startswith("the text of the SQL"):
            for c in rows:
                if len(c) >= 2:
                    texts.setdefault(c[0], c[1])
        elif "initialization parameters" in about or "init.ora parameters" in about:
            for c in rows:
                if len(c) >= 2:
                    parameters.setdefault(c[0], c[2] if len(c) > 2 and c[2] else c[1])
        elif about.startswith(("database instance information", "host information")):
            instance |= instance_of(header, rows)
    for kind in ("foreground_wait_events", "background_wait_events"):
        for event in doc[kind]:
            event["waitevent_histogram_ms"] = buckets.get(event["event"], {})
    block = re.search(r"Std Block Size:?\W+(\d+)K", re.sub(r"<[^>]*>", " ", text))
    instance["db_block_size"] = int(block[1]) * 1024 if block else 8192
    return {"snapshot": doc, "instance": instance, "sql_text": texts, "parameters": parameters}


def instance_of(header: list[str], rows: list[list[str]]) -> dict:
    """What a table with a header says of the instance, by its column names."""
    names = {"db id": ("db_id", whole), "inst num": ("instance_num", whole), "startup time": ("startup_time", str), "release": ("release", str), "rac": ("rac", str), "platform": ("platform", str), "cpus": ("cpus", whole), "cores": ("cores", whole), "sockets": ("sockets", whole), "memory (gb)": ("memory", whole)}
    row = next((c for c in rows if len(c) == len(header)), [])
    return {names[h.lower()][0]: names[h.lower()][1](x) for h, x in zip(header, row, strict=False) if h.lower() in names}


# Text reports: lines between a section's marker and the next marker.

# Marker at the beginning of a line (a form feed may stand before), name.
MARKERS = (("Snapshot       Snap Id", "snap_info"), ("Host CPU", "host_cpu"), ("Instance CPU", ""), ("Load Profile", "load_profile"), ("Instance Efficiency", "instance_efficiency"), ("Foreground Wait Events", "foreground_wait_events"), ("Background Wait Events", "background_wait_events"), ("Wait Events (fg and bg)", ""), ("Wait Event Histogram", "histogram"), ("Time Model", "time_model_stats"), ("SQL ordered by CPU", "sql_cpu_time"), ("SQL ordered by Elapsed", "sql_elapsed_time"), ("SQL ordered by Gets", "sql_gets"), ("SQL ordered by Reads", "sql_reads"), ("Instance Activity Stats", "instance_stats"), ("Dictionary Cache Stats", "dictionary_cache"), ("Library Cache Activity", "library_cache"), ("Latch Activity", "latch_activity"), ("init.ora Parameters", "parameters"), ("Top ADDM Findings", ""), ("Cache Sizes", ""), ("End of Report", ""))


def sections_of(text: str) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    here: list[str] | None = None
    for line in text.splitlines():
        bare = line.lstrip("\x0c")
        name = next((n for m, n in MARKERS if bare.startswith(m)), None)
        if name is not None:
            here = found.setdefault(name, []) if name else None
        elif here is not None:
            here.append(line)
    return found


def cuts(line: str, *places: tuple[int, int | None]) -> list[str]:
    return [line[a:b].strip() for a, b in places]


def is_number(text: str) -> bool:
    return bool(re.fullmatch(r"-?[\d,]*\.?\d+", text))


def read_text(file_name: str, text: str) -> dict:
    """The same of a text report."""
    doc, found = empty(file_name), sections_of(text)
    for side, line in ((m[1].lower(), line) for line in text.splitlines() if (m := re.match(r"\s*(Begin|End) Snap:", line))):
        f = line.split()
        doc["snap_info"] |= {f"{side}_snap_id": whole(f[2]), f"{side}_snap_time": " ".join(f[3:5])}
    for line in found.get("load_profile", []):
        if m := re.match(r"\s*(.+?):\s+([\d,.]+)\s+([\d,.]+)?", line):
            doc["load_profile"].append({"stat_name": m[1].strip(), "per_second": num(m[2]), "per_transaction": num(m[3] or "")})
    for line in found.get("instance_efficiency", []):
        for name, pct in re.findall(r"([A-Za-z][^:]*):\s*(-?[\d.]+|#+)?", line):
            doc["instance_efficiency"].append({"eff_stat": name.strip(), "eff_pct": float(pct) if pct and is_number(pct) and float(pct) >= 0 else None})
    for line in found.get("host_cpu", []):
        numbers = line.split()
        if len(numbers) >= 6 and all(map(is_number, numbers[:6])):
            begin, end, user, system, idle, wio = map(num, numbers[:6])  # idle comes before wio here
            doc["host_cpu"] = {"load_avg_begin": begin, "load_avg_end": end, "pct_user": user, "pct_system": system, "pct_wio": wio, "pct_idle": idle}
            break
    buckets = {}
    for line in found.get("histogram", []):
        name, *values = cuts(line, (0, 26), *((33 + 6 * i, 38 + 6 * i) for i in range(7)), (75, 80))
        if name and any(map(is_number, values)):
            buckets[name] = {f"{i + 1}: {label}": num(v) for i, (label, v) in enumerate(zip(("<1ms", "<2ms", "<4ms", "<8ms", "<16ms", "<32ms", "<=1s", ">1s"), values, strict=True))}
    for kind in ("foreground_wait_events", "background_wait_events"):
        for line in found.get(kind, []):
            if len(line) >= 73:
                name, waits, total, mean, pct = cuts(line, (0, 28), (29, 41), (46, 57), (57, 64), (73, 80))
                if is_number(waits) and name not in IDLE_BEGINNINGS:
                    doc[kind].append({"event": name, "waits": whole(waits), "total_wait_time_s": num(total), "avg_wait": wait_ms(mean), "pct_dbtime": num(pct), "waitevent_histogram_ms": buckets.get(name[:26], {})})
    for line in found.get("time_model_stats", []):
        name, time, pct = cuts(line, (0, 35), (35, 56), (56, 66))
        if len(line) >= 56 and is_number(time):
            doc["time_model_stats"].append({"stat_name": name, "time_s": num(time), "pct_dbtime": num(pct)})
    for line in found.get("instance_stats", []):
        name, total = cuts(line, (0, 35), (35, 52))
        if is_number(total) and num(total) >= 0:
            doc["instance_stats"].append({"statname": name, "total": whole(total)})
    for line in found.get("dictionary_cache", []):
        name, gets, usage = cuts(line, (0, 25), (26, 38), (69, 79))
        if is_number(gets):
            doc["dictionary_cache"].append({"statname": name, "get_requests": whole(gets), "final_usage": whole(usage)})
    for line in found.get("latch_activity", []):
        name, gets, miss, wait = cuts(line, (0, 24), (25, 39), (40, 46), (54, 60))
        if len(line) >= 72 and is_number(gets):
            doc["latch_activity"].append({"statname": name, "get_requests": whole(gets), "get_pct_miss": num(miss), "wait_time": num(wait)})
    held = ""
    for line in found.get("library_cache", []):  # a name, then on the same or the next line its numbers
        if m := re.match(r"(\S.*?)?\s{2,}([\d,]+)\s+([\d.]+)\s+([\d,]+)", line):
            name = (m[1] or held).strip()
            if name:
                doc["library_cache"].append({"statname": name, "get_requests": whole(m[2]), "get_pct_miss": num(m[3]), "pin_requests": whole(m[4])})
            held = ""
        else:
            held = line.strip()
    for section, (value, per) in {"sql_elapsed_time": ("elapsed_time_s", "elpased_time_exec_s"), "sql_cpu_time": ("cpu_time_s", "cpu_time_exec_s"), "sql_gets": ("buffer_gets", "gets_per_exec"), "sql_reads": ("physical_reads", "reads_per_exec")}.items():
        lines = found.get(section, [])
        for line, after in zip(lines, [*lines[1:], ""], strict=False):
            t = line.split()
            if len(t) != 7 or not all(map(is_number, t[:6])):
                continue
            cpu = num(t[4]) if section == "sql_reads" else -1.0
            row = {"sql_id": t[6], value: num(t[0]), "executions": whole(t[1]), per: num(t[2]), "pct_total": num(t[3]), ("cpu_time_pct" if section == "sql_reads" else "pct_cpu"): cpu, "pct_io": -1.0, "sql_module": after.split(":", 1)[1].strip() if after.strip().startswith("Module:") else ""}
            if section == "sql_elapsed_time":
                doc[section].append(row | {"sql_type": ""})
            else:
                doc[section].setdefault(t[6], row)
    switches = next((line.split() for line in text.splitlines() if "log switches (derived)" in line), None)
    if switches:
        doc["redo_log"] = {"stat_name": "log switches (derived)", "per_hour": num(switches[-1])}
    parameters, name = {}, ""
    for line in found.get("parameters", []):
        key, begin, end = cuts(line, (0, 29), (30, 63), (64, None))
        if key and begin and not key.startswith("-") and key != "Parameter Name":
            name, parameters[key] = key, end or begin
        elif not key and begin and name:
            parameters[name] += begin  # a wrapped value
    texts: dict[str, str] = {}
    for section in ("sql_cpu_time", "sql_elapsed_time", "sql_gets", "sql_reads"):
        for sql_id, own in statement_texts(found.get(section, [])).items():
            texts[sql_id] = max(texts.get(sql_id, ""), own, key=len)
    return {"snapshot": doc, "instance": instance_in(text), "sql_text": texts, "parameters": parameters}


# How the lines begin that head each page of a section of statements, what others of them hold, and how statements begin.
PAGE_HEADS = (
    "SQL ordered by ", "-> ", "------", "CPU ", "Time (s)", "Elapsed", "Elap per", "Buffer Gets", "Physical Rds", "Executions", "Parse Calls", "Max", "Cluster",
    "Memory (KB)", "Version", "%Total", "% Total", "Sharable", "CPU per", "Old",
)
PAGE_MARKS = ("Hash Value", "DB/Inst:", "Snaps:")
STATEMENT_BEGINS = re.compile(r"(?i)(SELECT|INSERT|UPDATE|DELETE|MERGE|DECLARE|BEGIN)\b")


def statement_of(line: str) -> str | None:
    """The id that ends a line of numbers in a section of statements."""
    t = line.split()
    return t[-1] if len(t) >= 7 and is_number(t[0]) and re.fullmatch(r"[A-Za-z0-9]{5,20}", t[-1]) else None


def statement_texts(lines: list[str]) -> dict[str, str]:
    """Texts of the statements of a section, over pages: what follows a statement's numbers, from its first word on. The longest of several counts."""
    bare = [t for t in map(str.strip, lines) if t and not t.startswith(PAGE_HEADS) and not any(m in t for m in PAGE_MARKS)]
    places = [k for k, t in enumerate(bare) if statement_of(t)]
    found: dict[str, str] = {}
    for k, end in zip(places, [*places[1:], len(bare)], strict=False):
        body = [t for t in bare[k + 1 : end] if not t.startswith("Module:")]
        start = next((i for i, t in enumerate(body) if STATEMENT_BEGINS.match(t)), len(body))
        found[statement_of(bare[k])] = max(found.get(statement_of(bare[k]), ""), "\n".join(body[start:]), key=len)
    return {sql_id: text for sql_id, text in found.items() if text}


def instance_in(text: str) -> dict:
    """What the head of a text report says of the instance."""
    out: dict = {}
    if m := re.search(r"^\s*(?:\S+\s+)?(\d{5,})\s+(\S+)\s+(\d+)\s+(\d\d-\w{3}-\d\d \d\d:\d\d)\s+([\d.]+)\s+(YES|NO)\s*$", text, re.MULTILINE):
        out |= {"db_id": int(m[1]), "instance_num": int(m[3]), "startup_time": m[4], "release": m[5], "rac": m[6]}
    for name, field in (("CPUs", "cpus"), ("Cores", "cores"), ("Sockets", "sockets"), (r"Memory \(G\w*\)", "memory")):
        if m := re.search(rf"\b{name}\s*:?\s+(\d+)", text):
            out[field] = int(m[1])
    block = re.search(r"Std Block Size:\s*(\d+)([KM]?)", text)
    return out | {"db_block_size": int(block[1]) * {"K": 1024, "M": 2**20, "": 1}[block[2]] if block else 8192}


def read_report(file_name: str, text: str) -> dict:
    return (read_html if re.search(r"<html|<table", text[:4096], re.IGNORECASE) else read_text)(file_name, text)


PARSED = f"file_name string, snapshot {SNAPSHOT}, instance {INSTANCE}, sql_text map<string,string>, parameters map<string,string>"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All ``.html`` and ``.txt`` reports of a folder, one row each; files beginning with a dot are left out. A file that can't be
    read has a null snapshot."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*.{html,txt}").load(path).select("path", "content")
    return parsed(files)


def parsed(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows.append((name, json.dumps(read_report(name, bytes(content).decode("utf-8", "replace")))))
                except Exception as problem:  # noqa: BLE001 - one broken report must not end the others
                    rows.append((name, json.dumps({"problem": str(problem)[:200]})))
            yield pd.DataFrame(rows, columns=["file_name", "doc"])

    docs = files.mapInPandas(run, "file_name string, doc string")
    kind = PARSED.split(", ", 1)[1]
    return docs.select("file_name", F.from_json("doc", kind).alias("d")).select("file_name", "d.*")


def snapshots_of(read: DataFrame) -> DataFrame:
    """Parsed reports in the shape of ``collection.snapshots``."""
    from snapmill.sources.collection import SECTIONS, clamped

    kind = read.schema["snapshot"].dataType
    whole_ = read.where(F.col("snapshot").isNotNull()).withColumn("a", clamped(F.col("snapshot"), kind))
    si = F.col("a.snap_info")
    return whole_.select(F.col("instance.db_id").alias("db_id"), F.col("instance.instance_num").alias("instance_num"), si["begin_snap_id"].alias("snap_id"), si["end_snap_id"].alias("end_id"), si["begin_snap_time"].alias("begins"), si["end_snap_time"].alias("ends"), F.col("a.file_name").alias("file_name"), F.col("a.status").alias("status"), *(F.col(f"a.{s}").alias(s) for s in SECTIONS))
