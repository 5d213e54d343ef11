"""Entries by listed layouts, line after line: the plain counterpart of the mined ones."""

import json
import re
from datetime import UTC, datetime, timedelta

LEVEL = {"DEBUG": "DEBUG", "DBG": "DEBUG", "INFO": "INFO", "INFORMATION": "INFO", "NOTICE": "INFO", "WARN": "WARN", "WARNING": "WARN", "ERR": "ERROR", "ERROR": "ERROR", "SEVERE": "ERROR", "CRIT": "FATAL", "CRITICAL": "FATAL", "FATAL": "FATAL", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}
MON = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}
ISO = r"(\d{4}[-/]\d\d[-/]\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,]\d+)?(?:Z|[+-]\d\d:\d\d)?"
PLAIN = [
    (rf"{ISO}$", None, None), (rf"\*\*\* {ISO}$", None, None),
    (rf"{ISO} +([A-Za-z]+) +\[([\w.]+)\] ", 3, 4), (rf"\[{ISO}\] \[([\w.]+)\] ([A-Za-z]+): ", 4, 3),
    (rf"<\d+>1 {ISO} \S+ (\w+) \d+ - - ([A-Za-z]+) ", 4, 3), (rf"time={ISO} level=(\w+) component=(\S+) ", 3, 4),
]


def start(line, closed):
    """(clock, level, component, stands alone) or None"""
    for pattern, lv, co in PLAIN:
        if m := re.match(pattern, line):
            return m[1].replace("/", "-") + " " + m[2], LEVEL[m[lv].upper()] if lv else "-", m[co] if co else "-", lv is None
    if m := re.match(rf"([A-Za-z]+)\|{ISO}\|([\w.]+)\|", line):
        return m[2] + " " + m[3], LEVEL[m[1].upper()], m[4], False
    if m := re.match(r"(\d\d)-([A-Z]{3})-(\d{4}) (\d\d:\d\d:\d\d) \* ", line):
        return f"{m[3]}-{MON[m[2]]:02d}-{m[1]} {m[4]}", "-", "-", False
    if m := re.match(r"[A-Z][a-z]{2} ([A-Z][a-z]{2}) +(\d+) (\d\d:\d\d:\d\d) (\d{4})$", line):
        return f"{m[4]}-{MON[m[1].upper()]:02d}-{int(m[2]):02d} {m[3]}", "-", "-", True
    if m := re.match(r"(\d{10})\.\d+ \[(\w)\] (\w+): ", line):
        return datetime.fromtimestamp(int(m[1]), UTC).strftime("%Y-%m-%d %H:%M:%S"), LEVEL[m[2]], m[3], False
    if m := re.match(r"([A-Z][a-z]{2}) +(\d+) (\d\d:\d\d:\d\d) \S+ (\w+)\[\d+\]: ([A-Za-z]+): ", line):
        for year in range(closed.year + 1, closed.year - 9, -1):
            try:
                t = datetime.strptime(f"{year}-{MON[m[1].upper()]:02d}-{int(m[2]):02d} {m[3]}", "%Y-%m-%d %H:%M:%S")
            except ValueError:
                continue
            if t <= closed + timedelta(days=1):
                return str(t), LEVEL[m[5].upper()], m[4], False
    return None


def of_json(text):
    doc = json.loads(text)
    t = doc.get("ts") or doc.get("time") or doc.get("@timestamp")
    m = re.fullmatch(ISO, t)
    return m[1] + " " + m[2], LEVEL[(doc.get("lvl") or doc.get("level") or doc.get("severity")).upper()], doc.get("logger") or doc.get("component") or doc.get("source"), False


def code(lines):
    for line in lines:
        found = [(m.start(), f"{m[1].upper()}-{int(m[2]):05d}") for m in re.finditer(r"(?i)\b(ORA|TNS)-(\d{1,5})\b", line)]
        found += [(m.start(), f"ORA-{int(m[1]):05d}") for m in re.finditer(r"(?<=PARSE ERROR: )ospid=\d+, error=(\d+)", line)]
        if found:
            return min(found)[1]
    return "-"


def entries(name, rows):
    """rows: (line_no, line, closed_at) in order"""
    out = []
    i = 0
    while i < len(rows):
        no, line, closed = rows[i]
        got, size = None, 1
        if line == "{":
            end = next((j for j in range(i, len(rows)) if rows[j][1] == "}"), None)
            try:
                got, size = of_json("\n".join(r[1] for r in rows[i : end + 1])), end + 1 - i
            except (TypeError, ValueError):
                pass
        elif line.startswith("{"):
            got = of_json(line)
        else:
            got = start(line, closed)
        if got:
            out.append([no, got, [r[1] for r in rows[i : i + size]]])
        elif out:
            out[-1][2].append(line)
        i += size
    result = []
    for no, (t, level, component, alone), lines in out:
        if alone and len(lines) > 1:
            level = "WARN" if lines[1].startswith("WARNING") else "ERROR" if lines[1].startswith("ERROR") else "-"
        result.append((name, no, t, level, component, code(lines)))
    return result
