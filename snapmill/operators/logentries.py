"""Log lines of several programs, parsed into entries of one or more lines.

Layouts are mined, not listed. Lines move once, to blocks of a log, and are tokenised once: the header of a line, up to where its
message begins, becomes a sequence of classes (time, level word, number, word, marks). A task clusters the sequences of its lines by their longest
common subsequence into templates; the templates of all tasks are then merged the same way. What precedes the time is a template's lead: its
lines begin entries if the times in that slot run on with the log, as entries' own times do and quoted ones don't. The constant beginning of a
template is its layout, whose slots are classified by type: time, level, process number, names that stand alone. For JSON and key=value
lines the slots are the keys, classified by what their values are throughout.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapmill.common import BLOCK, collapsed, cut, running

# Level words and what they count as.
LEVELS = {
    "DEBUG": "DEBUG", "DBG": "DEBUG", "TRACE": "DEBUG", "FINE": "DEBUG",
    "INFO": "INFO", "INF": "INFO", "INFORMATION": "INFO", "INFORMATIONAL": "INFO", "NOTICE": "INFO",
    "WARN": "WARN", "WARNING": "WARN",
    "ERROR": "ERROR", "ERR": "ERROR", "SEVERE": "ERROR",
    "CRIT": "FATAL", "CRITICAL": "FATAL", "FATAL": "FATAL", "ALERT": "FATAL", "EMERG": "FATAL",
}
LETTERS = {"D": "DEBUG", "I": "INFO", "N": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}
MONTHS = {m: i + 1 for i, m in enumerate(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"])}

_MONTH = "(?:" + "|".join(MONTHS) + ")"
_DAY = "(?:mon|tue|wed|thu|fri|sat|sun)"
_CLOCK = r"\d\d:\d\d:\d\d"
_REST = r"(?:[.,]\d+)?(?: ?Z| ?[+-]\d\d:?\d\d)?"
#: What values of type time look like, by name.
TIMES = {
    "iso": rf"\d{{4}}[-/.]\d\d[-/.]\d\d[T ]{_CLOCK}{_REST}",
    "dmy": rf"\d\d?[- /]{_MONTH}[- /]\d{{4}}[ :]{_CLOCK}{_REST}",
    "two": rf"\d\d?[/.]\d\d?[/.]\d{{4}}[T ]{_CLOCK}{_REST}",
    "ctime": rf"{_DAY} {_MONTH} [ \d]?\d {_CLOCK}(?: [A-Z]{{3,5}})? \d{{4}}",
    "yearless": rf"{_MONTH} [ \d]?\d {_CLOCK}",
    "compact": r"\d{8}[T ]?\d{6}(?:[.,]\d+)?Z?",
    "epoch": r"\d{10}(?:\.\d+)?(?= )",
}
TOKEN = re.compile("|".join(f"(?P<{k}>(?<![\\w.]){v}(?![\\w:]))" for k, v in TIMES.items()) + r"|(?P<word>[A-Za-z_][\w.@$/-]*\w|[A-Za-z_])|(?P<number>\d+)|(?P<mark>\S)", re.IGNORECASE)
ANY_TIME = re.compile("|".join(f"(?:{v})" for k, v in TIMES.items() if k != "epoch"), re.IGNORECASE)
#: What any form of a time holds.
TIMELIKE = re.compile(r"\d\d:\d\d:\d\d|\d{10}(?:\.\d+)? |\d{8}[T ]\d{6}")
CODE = re.compile(r"(?i)(?<![A-Za-z0-9_])(ORA|TNS)-(\d{1,5})(?!\d)")
PARSE_ERROR = re.compile(r"PARSE ERROR:.*?\berror=(\d{1,5})(?!\d)")
CLOCK = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d")
NAME = re.compile(r"[A-Za-z_][\w.$-]*")
KEYED = re.compile(r'\s*([\w.@-]+)=("(?:[^"\\]|\\.)*"|\S*)')
INNER = re.compile(r'\s*"([^"]+)"\s*:\s*("(?:[^"\\]|\\.)*"|[^,{}\[\]]+?)\s*,?\s*$')
#: So many words in a row are no names any more: the message has begun.
PROSE = 3
#: Share of a key's values that must be of a type for the key to have it.
SHARE = 0.9
#: Share of a lead's times that must run on with the log, and that must be new, for its lines to begin entries.
IN_ORDER, FRESH = 0.8, 0.05
DAY = timedelta(days=1)
SLOT = "<*>"


def clock(text: str, form: str, closed: datetime | None) -> datetime | None:
    """A time as written; None if there is no such time.

    A missing year is the latest that puts the time no more than a day after ``closed``. Of a date whose day and month can't be told, the
    reading nearer to ``closed`` holds, month first without it.
    """
    try:
        if form == "epoch":
            moment = datetime.fromtimestamp(int(text[:10]), UTC).replace(tzinfo=None)
            return moment if 2000 <= moment.year < 2100 else None
        if form == "compact":
            digits = re.sub(r"\D", "", text)
            return datetime(*(int(digits[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14))))
        at = re.search(rf"(?<!\d){_CLOCK}", text)
        h, mi, s = map(int, at[0].split(":"))
        if form == "iso":
            return datetime(int(text[:4]), int(text[5:7]), int(text[8:10]), h, mi, s)
        if form == "dmy":
            day, month, year = re.split(r"[- /]", text[: at.start() - 1])
            return datetime(int(year), MONTHS[month.lower()], int(day), h, mi, s)
        if form == "two":
            a, b, year = map(int, re.split(r"[/.]", text[: at.start() - 1]))
            found = [datetime(year, m, d, h, mi, s) for m, d in ((a, b), (b, a)) if m <= 12]
            return min(found, key=lambda t: abs(t - closed)) if closed and found else found[0] if found else None
        parts = text.split()
        if form == "ctime":
            return datetime(int(parts[-1]), MONTHS[parts[1].lower()], int(parts[2]), h, mi, s)
        if closed is None:
            return None
        month, day = MONTHS[parts[0].lower()], int(parts[1])
        for year in range((closed + DAY).year, 0, -1):
            leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
            if (month, day) == (2, 29) and not leap:
                continue
            moment = datetime(year, month, day, h, mi, s)
            if moment <= closed + DAY:
                return moment
        return None
    except (ValueError, KeyError, OverflowError):
        return None


def written(moment: datetime | None) -> str | None:
    return moment.isoformat(" ") if moment else None


def whole_time(text: str, closed: datetime | None) -> str | None:
    """The clock of a text that is a time and nothing else."""
    if TIMELIKE.search(text):
        for form, pattern in TIMES.items():
            if form != "epoch" and re.fullmatch(pattern, text, re.IGNORECASE):
                return written(clock(text, form, closed))
    return None


def head(line: str) -> tuple[list[str], list[str], int, str] | None:
    """Classes and texts of a line's header, the place and form of its time; None for an indented or quoted (``>``) line, or one whose time, if
    any, is part of prose.

    The header ends where the message begins: before the last of ``PROSE`` words in a row, or at the first key with a value. Words before the
    time are classes of their own, ``'word``.
    """
    if not line or line[0] in " \t>":
        return None
    classes, texts, at, form, words = [], [], -1, "", 0
    for m in TOKEN.finditer(line):
        kind, text = m.lastgroup, m[0]
        if kind in TIMES:
            if at >= 0:
                kind = "t"
            else:
                at, form, kind = len(classes), kind, f"t:{kind}"
        elif kind == "word":
            bracketed = len(text) == 1 and classes and classes[-1] == "[" and line[m.end() : m.end() + 1] == "]"
            kind = "L" if text.upper() in LEVELS or bracketed and text in LETTERS else "w" if at >= 0 else f"'{text}"
        elif kind == "number":
            kind = "n"
        else:
            kind = text
        words = words + 1 if kind[0] == "w" or kind[0] == "'" and len(kind) > 1 else 0
        if words == PROSE:
            break
        if kind == "=" and classes and at >= 0:
            if classes[-1] == "w":
                del classes[-1], texts[-1]
            break
        classes.append(kind)
        texts.append(text)
    return (classes, texts, at, form) if at >= 0 else None


def first_code(line: str) -> str | None:
    lower = line.lower()
    if "ora-" not in lower and "tns-" not in lower and "PARSE ERROR" not in line:
        return None
    codes = [(m.start(), f"{m[1].upper()}-{int(m[2]):05d}") for m in (CODE.search(line),) if m]
    codes += [(m.start(1), f"ORA-{int(m[1]):05d}") for m in (PARSE_ERROR.search(line),) if m]
    return min(codes)[1] if codes else None


@dataclass
class Line:
    """``kind`` is head, keyed, brace, inner or empty; ``hint`` what the level would be if the line followed a bare time."""

    kind: str = ""
    classes: list[str] | None = None
    texts: list[str] | None = None
    place: int = -1
    at: datetime | None = None
    pairs: list[tuple[str, str]] = field(default_factory=list)
    code: str | None = None
    hint: str | None = None
    alone: bool = False


def scan(line: str, closed: datetime | None) -> Line:
    out = Line(code=first_code(line), hint="WARN" if line.startswith("WARNING") else "ERROR" if line.startswith("ERROR") else None)
    pairs = []
    if line.startswith("{"):
        if line.strip() == "{":
            out.kind = "brace"
        else:
            try:
                doc = json.loads(line)
                pairs = [(k, str(v)) for k, v in doc.items() if isinstance(v, str | int | float)] if isinstance(doc, dict) else []
                out.kind = "keyed"
            except (ValueError, RecursionError):
                pass
    elif m := INNER.match(line) if line[:1] in ' \t"' and line else None:
        pairs, out.kind = [(m[1], m[2].strip('"'))], "inner"
    elif not TIMELIKE.search(line):
        pass
    elif KEYED.match(line) and ANY_TIME.search(line):
        pairs, out.kind = [(k, v.strip('"')) for k, v in KEYED.findall(line)], "keyed"
    elif found := head(line):
        classes, texts, place, form = found
        if at := clock(texts[place], form, closed):
            out.kind, out.classes, out.texts, out.place, out.at = "head", classes, texts, place, at
            out.alone = place == len(texts) - 1 and not any(c[0] == "'" and len(c) > 1 or c in ("L", "n") for c in classes)
    out.pairs = [(k, whole_time(v, closed) or v) for k, v in pairs]
    if out.kind == "keyed":
        times = [v for _, v in out.pairs if CLOCK.fullmatch(v)]
        if not times:
            out.kind = ""
    return out


@dataclass
class Entry:
    """Lines of one block that belong together; kind ``rest`` for those before the block's first beginning."""

    kind: str
    first_line: int
    last_line: int
    at: datetime | None = None
    lead: str | None = None
    sequence: str | None = None
    texts: list[str] | None = None
    pairs: list[tuple[str, str]] = field(default_factory=list)
    code: str | None = None
    hint: str | None = None
    alone: bool = False
    lines: int = 1

    def add(self, other: Entry) -> None:
        self.last_line, self.lines, self.code = other.last_line, self.lines + other.lines, self.code or other.code


    def timed(self) -> bool:
        return self.kind == "head" or any(CLOCK.fullmatch(v) for _, v in self.pairs)


class Survey:
    """What a task learns of its lines: by sequence how often it occurs and how many of its times run on with the log and are new, and
    by key how many of its values are of each type."""

    def __init__(self) -> None:
        self.sequences: dict[tuple[str, str], list[int]] = {}
        self.keys: dict[str, list[int]] = {}

    def pairs(self, pairs: list[tuple[str, str]]) -> None:
        for k, v in pairs:
            n = self.keys.setdefault(k, [0] * 5)
            for i, x in enumerate((1, CLOCK.fullmatch(v) is not None, v.upper() in LEVELS, NAME.fullmatch(v) is not None and not CODE.fullmatch(v), len(v))):
                n[i] += int(x)

    def block(self, entries: list[Entry]) -> None:
        """Times run on if they are at most a day before the last one of their lead. Those behind words, as in prose, must also lie between
        the nearest times that aren't, and differ from the one before."""
        timed = [(e, e.at or next((datetime.fromisoformat(v) for _, v in e.pairs if CLOCK.fullmatch(v)), None)) for e in entries if e.kind != "rest" and e.timed()]
        worded = [e.kind == "head" and "'" in e.lead for e, _ in timed]
        after, later = [None] * len(timed), None
        for i in range(len(timed) - 1, -1, -1) if any(worded) else ():
            after[i], later = later, later if worded[i] else timed[i][1]
        last: dict[str, datetime] = {}
        before = None
        for i, (e, at) in enumerate(timed):
            if e.kind == "head":
                n = self.sequences.setdefault((e.lead, e.sequence), [0] * 3)
                n[0] += 1
                fitted = e.lead.endswith("t:yearless")  # its year was chosen to fit the log
                n[1] += fitted or at >= last.get(e.lead, at) - DAY and (not worded[i] or (before is None or at >= before - DAY) and (after[i] is None or at <= after[i] + DAY))
                n[2] += not worded[i] or at != before
                last[e.lead] = at
            if not worded[i]:
                before = at

    def rows(self) -> Iterator[tuple]:
        """Of sequences with the template of this task that covers them, and of keys."""
        leads: dict[str, list[tuple[str, list[int]]]] = {}
        for (lead, sequence), n in self.sequences.items():
            leads.setdefault(lead, []).append((sequence, n))
        for lead, found in leads.items():
            found.sort(key=lambda x: (-x[1][0], x[0]))
            for (sequence, n), template in zip(found, clustered([q.split(" ") for q, _ in found]), strict=True):
                yield "sequence", lead, sequence, " ".join(template), *n, 0, 0
        for key, n in self.keys.items():
            yield "key", None, key, None, *n


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that may begin entries, each with those up to the next such line, of blocks of lines, which come sorted; and the survey."""
    key, last, held = None, None, []
    done: list[tuple] = []
    survey = Survey()
    none = (None,) * 9

    def close() -> None:
        """The block's entries: objects without a time join the entry before, but for the last ones, which may go on in the next block."""
        out: list[Entry] = []
        for e in held:
            if e.kind == "brace" and e is not held[-1] and not e.timed() and out:
                out[-1].add(e)
            else:
                out.append(e)
        survey.block(out)
        for e in out:
            done.append((*key, e.kind, e.timed() if e.kind != "rest" else False, e.first_line, e.last_line, written(e.at), e.lead, e.sequence, e.texts, [k for k, _ in e.pairs] or None, [v for _, v in e.pairs] or None, e.code, e.hint, e.alone, e.lines == 1, *none))

    for f in batches:
        for origin, name, block, no, line, closed in zip(*(f[c].to_pylist() for c in ("origin", "log_name", "block", "line_no", "line", "closed_at")), strict=True):
            if (origin, name, block) != key:
                if key is not None:
                    close()
                key, last, held = (origin, name, block), None, []
            if no == last:
                continue  # the same line again
            last = no
            x = scan(line or "", closed)
            here = held[-1] if held else None
            if x.kind in ("keyed", "inner"):
                survey.pairs(x.pairs)
            if x.kind in ("head", "keyed", "brace"):
                lead = " ".join(x.classes[: x.place + 1]) if x.classes else None
                held.append(Entry(x.kind, no, no, x.at, lead, " ".join(x.classes) if x.classes else None, x.texts, x.pairs, x.code, None if x.alone else x.hint, x.alone))
            elif here is None:
                held.append(Entry("rest", no, no, pairs=x.pairs, code=x.code, hint=x.hint))
            else:
                if here.lines == 1 and here.alone:
                    here.hint = x.hint
                if x.kind == "inner" and here.kind in ("brace", "rest"):
                    here.pairs += x.pairs
                here.last_line, here.lines, here.code = no, here.lines + 1, here.code or x.code
        if len(done) > 5000:
            yield seen(done)
            done.clear()
    if key is not None:
        close()
    done += [(None,) * (len(READ_COLUMNS) - 9) + row for row in survey.rows()]
    yield seen(done)


def seen(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(READ_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, READ_TYPES, strict=True)], names=READ_COLUMNS)


SEEN = "origin string, log_name string, block bigint, kind string, timed boolean, first_line bigint, last_line bigint, at string, lead string, sequence string, texts array<string>, keys array<string>, values array<string>, code string, hint string, alone boolean, single boolean"
#: A row is of lines, or of the survey (``what``): of a sequence its number and how many times run on and are new, of a key
#: how many values there are, and of each type, and their length.
READ = SEEN + ", what string, survey_lead string, name string, template string, n bigint, m1 bigint, m2 bigint, m3 bigint, m4 bigint"
SEEN_COLUMNS, READ_COLUMNS = ([c.split(" ")[0] for c in x.split(", ")] for x in (SEEN, READ))
READ_TYPES = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[c.split(" ")[1]] for c in READ.split(", ")]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def merge(template: list[str], sequence: list[str]) -> list[str] | None:
    """The template that covers both, with ``<*>`` for slots; None if less than half of the longer is common."""
    plain = [t for t in template if t != SLOT]
    pairs = common(plain, sequence)
    if 2 * len(pairs) < max(len(plain), len(sequence)):
        return None
    places = [k for k, t in enumerate(template) if t != SLOT]
    out, before, last = [], -1, -1
    for i, j in [*pairs, (len(plain), len(sequence))]:
        here = places[i] if i < len(plain) else len(template)
        if here - before > 1 or j - last > 1:
            out.append(SLOT)
        if i < len(plain):
            out.append(plain[i])
        before, last = here, j
    return out


def clustered(sequences: list[list[str]]) -> list[list[str]]:
    """The template that each sequence ends in: the first one that it has enough in common with, widened to cover it."""
    templates: list[list[str]] = []
    owner = []
    for sequence in sequences:
        for k, template in enumerate(templates):
            if (merged := merge(template, sequence)) is not None:
                templates[k] = merged
                owner.append(k)
                break
        else:
            templates.append(sequence)
            owner.append(len(templates) - 1)
    return [templates[k] for k in owner]


def join_layouts(templates: list[list[str]], lead: int) -> list[list[str]]:
    """Templates that go on alike for two tokens or more after their lead have one layout: their common beginning."""
    fixed = [t[: t.index(SLOT)] if SLOT in t else t for t in templates]
    for k in range(len(fixed)):
        for other in fixed:
            same = next((i for i, (x, y) in enumerate(zip(fixed[k], other, strict=False)) if x != y), min(len(fixed[k]), len(other)))
            if same >= lead + 2:
                fixed[k] = fixed[k][:same]
    return fixed


def roles(layout: list[str]) -> tuple[int, int]:
    """The places of level and component in a layout, by the types of its slots, -1 for none.

    A component is a name with a process number, behind a host if right after the time; else the first name that stands alone between marks,
    time, level and numbers, with something after it.
    """
    word = lambda k: 0 <= k < len(layout) and (layout[k] == "w" or layout[k][0] == "'" and len(layout[k]) > 1)
    at = lambda k: layout[k] if 0 <= k < len(layout) else ""
    mark = lambda k: len(at(k)) == 1 and not word(k) and at(k) not in ("L", "n", "t")
    level = next((k for k, c in enumerate(layout) if c == "L"), -1)
    names = [k for k in range(len(layout)) if word(k) and at(k + 1) != "="]
    numbered = lambda k: at(k + 1) == "[" and at(k + 2) == "n" and at(k + 3) == "]" or at(k + 1) == "n" and mark(k + 2)
    single = lambda k: not word(k - 1) and not word(k + 1)
    behind_host = lambda k: word(k - 1) and at(k - 2).startswith("t:")
    component = next((k for k in names if numbered(k) and (single(k) or behind_host(k))), -1)
    if component < 0:
        component = next((k for k in names if single(k) and (mark(k + 1) or at(k + 1).startswith("t:"))), -1)
    return level, component


def mine(group: pd.DataFrame) -> pd.DataFrame:
    """The templates of all tasks for one lead, merged, and what the slots of each sequence are."""
    group = group.sort_values(["n", "template", "sequence"], ascending=[False, True, True])
    own = list(dict.fromkeys(group["template"]))
    whole = dict(zip(own, clustered([t.split(" ") for t in own]), strict=True))
    lead = group["lead"].iloc[0]
    fixed = join_layouts([*whole.values()], len(lead.split(" ")))
    layout = dict(zip(own, fixed, strict=True))
    rows = [(lead, s, " ".join(whole[t]), " ".join(layout[t]), *roles(layout[t])) for s, t in dict(zip(group["sequence"], group["template"], strict=True)).items()]
    return pd.DataFrame(rows, columns=["lead", "sequence", "template", "layout", "level_at", "component_at"])


def mined_layouts(read: DataFrame) -> DataFrame:
    """``lead, sequence, template, layout, level_at, component_at`` of the leads whose lines begin entries.

    Only distinct sequences of headers with the templates of the tasks reach the merging, which runs per lead.
    """
    found = read.where("what = 'sequence'").groupBy(F.col("survey_lead").alias("lead"), F.col("name").alias("sequence"), "template").agg(F.sum("n").alias("n"), F.sum("m1").alias("ordered"), F.sum("m2").alias("fresh"))
    begins = found.groupBy("lead").agg(F.sum("n").alias("all"), F.sum("ordered").alias("ordered"), F.sum("fresh").alias("fresh")).where((F.col("ordered") >= IN_ORDER * F.col("all")) & (F.col("fresh") >= FRESH * F.col("all"))).select("lead")
    return found.join(begins, "lead").select("lead", "sequence", "template", "n").groupBy("lead").applyInPandas(mine, "lead string, sequence string, template string, layout string, level_at int, component_at int")


def mined_keys(read: DataFrame) -> DataFrame:
    """``key, role`` (time, level or component) of the keys of JSON and key=value lines, by the type of their values.

    Where a line has several keys of a role, the one of least ``weakness`` counts: names throughout, then short ones.
    """
    counts = {"n": "n", "times": "m1", "levels": "m2", "names": "m3", "length": "m4"}
    sums = read.where("what = 'key'").groupBy(F.col("name").alias("key")).agg(*(F.sum(c).alias(n) for n, c in counts.items()))
    share = lambda c: F.col(c) / F.col("n")
    role = F.when(share("times") >= SHARE, "time").when(share("levels") >= SHARE, "level").when(share("names") >= SHARE, "component")
    return sums.select("key", role.alias("role"), F.struct((-share("names")).alias("a"), share("length").alias("b"), F.col("key").alias("c")).alias("weakness")).where("role is not null")


def level_of(word: F.Column) -> F.Column:
    table = F.create_map(*(F.lit(x) for kv in (LEVELS | LETTERS).items() for x in kv))
    return table[F.upper(word)]


def read(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """The lines of ``entries`` in blocks as ``READ``, in the shared checkpoint folder."""
    key = ["origin", "log_name"]
    own = lines.select(F.col("origin").cast("string").alias("origin"), F.col("log_name").cast("string").alias("log_name"), F.col("line_no").cast("bigint").alias("line_no"), F.col("line").cast("string").alias("line"), F.col("closed_at").cast("timestamp_ntz").alias("closed_at")).where("line_no is not null")
    blocked = collapsed(own).withColumn("block", F.floor(F.col("line_no") / block)).repartition(*key, "block").sortWithinPartitions(*key, "block", "line_no", "line")
    return cut(blocked.select(*key, "block", "line_no", "line", "closed_at").mapInArrow(read_blocks, READ))


def entries(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Entries of logs: ``origin, log_name, first_line, last_line, logged_at, log_level, component, code``.

    ``lines`` has ``origin`` (what keeps pieces of equal names apart), ``log_name, line_no, line, closed_at``; other columns are
    ignored. Lines of one origin, name and number are taken once. Lines without a number are left out, null lines are empty ones.
    An entry begins at a line with a time in its header whose lead begins entries, at a one-line JSON object or key=value line with a time,
    or at the brace of an object over several lines; a brace without a time before the next entry begins none. A time without a year in a log
    without ``closed_at`` names no time. Empty and very long lines and an empty table need no care. Lines move
    once, to blocks of ``block`` line numbers of a log, where they are read; only the first and last entries of a block are joined over blocks.
    """
    key = ["origin", "log_name"]
    seen = read(lines, block)
    layouts, roles_ = mined_layouts(seen), mined_keys(seen)
    leads = layouts.groupBy("lead").agg(F.lit(True).alias("begins"))
    rows = seen.where("what is null").select(*SEEN_COLUMNS).join(leads, "lead", "left").withColumn("starts", (F.col("kind") != "rest") & ((F.col("kind") != "head") | F.coalesce("begins", F.lit(False))))
    within = Window.partitionBy(*key, "block").orderBy("first_line")
    counted = rows.withColumn("e", F.sum(F.col("starts").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    final = F.coalesce(F.max(F.when(F.col("starts") & F.col("timed"), F.col("e"))).over(Window.partitionBy(*key, "block")), F.lit(0))
    # one row per entry, written once: the few at the edges of blocks are read by themselves
    folded = cut(together(counted.withColumn("edge", (F.col("e") == 0) | (F.col("e") >= final)), [*key, "block", "e", "edge"]))
    every = folded.where("not edge").drop("edge", "block", "e", "single").unionByName(joined_edges(folded.where("edge"), key))
    # one row per entry from here: slots by layout, or keys by role
    slot = lambda c: F.when(F.col(c) >= 0, F.col("texts")[F.col(c)])
    rest = ["first_line", "last_line", F.when(F.col("alone"), F.col("hint")).alias("hint"), "code"]
    heads = every.where("kind = 'head'").join(layouts.select("sequence", "level_at", "component_at"), "sequence", "left").select(*key, *rest, F.col("at").alias("t"), slot("level_at").alias("l"), slot("component_at").alias("c"))
    pairs = every.where("kind <> 'head'").select(*key, *rest, F.explode(F.arrays_zip("keys", "values")).alias("x")).select(*key, "first_line", "last_line", "hint", "code", F.col("x.keys").alias("key"), F.col("x.values").alias("v"))
    of = lambda r: F.min_by(F.when(F.col("role") == r, F.col("v")), F.when(F.col("role") == r, F.col("weakness")))
    any_time = F.min(F.when(F.col("v").rlike(f"^{CLOCK.pattern}$"), F.col("v")))
    keyed = pairs.join(roles_, "key", "left").groupBy(*key, "first_line", "last_line", "hint", "code").agg(F.coalesce(of("time"), any_time).alias("t"), of("level").alias("l"), of("component").alias("c"))
    out = heads.unionByName(keyed.select(heads.columns)).where("t is not null")
    return out.select(*key, "first_line", "last_line", F.col("t").alias("logged_at"), F.coalesce(level_of(F.col("l")), F.col("hint"), F.lit("-")).alias("log_level"), F.coalesce("c", F.lit("-")).alias("component"), F.coalesce("code", F.lit("-")).alias("code"))


def together(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``SEEN`` that are one entry (``by``), of which one at most ``starts`` it, as one row of that kind, or ``rest``."""
    start = F.col("starts")
    of_start = [F.max(F.when(start, F.col(c))).alias(c) for c in ("at", "sequence", "texts", "alone")]
    line_up = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("first_line", c)))), lambda x: x[c])).alias(c)
    follow = F.min(F.when(~start, F.struct("first_line", "hint")))["hint"]
    begun = F.max(F.when(start, F.lit(True)))
    hint = F.when(F.max(F.when(start, F.col("single"))) | begun.isNull(), follow).otherwise(F.max(F.when(start, F.col("hint")))).alias("hint")
    return rows.groupBy(*by).agg(
        F.coalesce(F.max(F.when(start, F.col("kind"))), F.lit("rest")).alias("kind"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), *of_start,
        line_up("keys"), line_up("values"), hint, F.min(F.when(F.col("code").isNotNull(), F.struct("first_line", "code")))["code"].alias("code"),
        ((F.count(F.lit(1)) == 1) & F.max("single")).alias("single"),
    )


def joined_edges(edges: DataFrame, key: list[str]) -> DataFrame:
    """Entries that may go on in another block, joined with what goes on: few rows per block."""
    numbered = running(edges.drop("e").withColumn("starts", (F.col("kind") != "rest").cast("int")), key, "first_line", {"e": "starts"}).where("e > 0")
    begun = together(numbered.withColumn("starts", F.col("starts") == 1), [*key, "e"])
    real = (F.col("kind") != "brace") | F.exists("values", lambda v: v.rlike(f"^{CLOCK.pattern}$"))
    final = running(begun.withColumn("real", real.cast("int")), key, "first_line", {"entry": "real"}).where("entry > 0")
    kept = ["first_line", "kind", "at", "sequence", "texts", "keys", "values", "hint", "alone"]
    whole = final.groupBy(*key, "entry").agg(F.max(F.when(F.col("real") == 1, F.struct(*kept))).alias("s"), F.max("last_line").alias("last_line"), F.min(F.when(F.col("code").isNotNull(), F.struct("first_line", "code")))["code"].alias("code"))
    return whole.select(*key, "s.*", "last_line", "code")


def with_messages(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` entries with ``message``: all lines of the entry as written, joined by line feeds."""
    e, n = found.alias("e"), lines.where("line_no is not null").dropDuplicates(["origin", "log_name", "line_no"]).alias("n")
    spread = e.select("*", F.explode(F.sequence("first_line", "last_line")).alias("line_at")).alias("e")
    whole = spread.join(n, F.col("e.origin").eqNullSafe(F.col("n.origin")) & F.col("e.log_name").eqNullSafe(F.col("n.log_name")) & (F.col("e.line_at") == F.col("n.line_no")))
    columns = [f"e.{c}" for c in found.columns]
    return whole.groupBy(*columns).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("n.line_no", F.coalesce("n.line", F.lit("")).alias("line")))), lambda x: x["line"])).alias("message"))


def log_lines(alert_lines: DataFrame, details: DataFrame) -> DataFrame:
    """The lines of whole logs and of samples, the latter numbered on from ``start_line``, each sample by itself."""
    logs = alert_lines.select(F.lit("log").alias("origin"), "log_name", "line_no", "line", "closed_at")
    samples = details.where("sample is not null").select(F.concat(F.lit("sample "), F.col("row_id").cast("string")).alias("origin"), "log_name", "start_line", F.posexplode(F.split(F.regexp_replace("sample", "\r\n?", "\n"), "\n")))
    return logs.unionByName(samples.select("origin", "log_name", (F.col("start_line") + F.col("pos")).alias("line_no"), F.col("col").alias("line"), F.lit(None).cast("timestamp").alias("closed_at")))
