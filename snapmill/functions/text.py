"""Scalar functions on report and log texts as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapmill.dims import ORA_TEXT

# Words that no table is called, and schemas whose tables don't count.
NO_TABLE = (
    "DUAL", "SYS", "SYSTEM", "SELECT", "VALUES", "SET", "WHERE", "AND", "OR", "ON", "USING", "TABLE", "INDEX", "VIEW", "BEGIN", "END",
    "DECLARE", "EXCEPTION", "LOOP", "IF", "THEN", "ELSE", "ELSIF", "RETURN", "NULL", "NOT", "IN", "EXISTS", "PARTITION", "SUBPARTITION",
    "LATERAL", "XMLTABLE", "JSON_TABLE", "SKIP", "LOCKED", "NOWAIT", "WAIT", "FOR",
)
NO_SCHEMA = ("SYS.", "SYSTEM.")
# Special alert-log events by pattern, first match first.
SPECIAL = (
    ("FATAL_NI_CONNECT_ERROR", r"(?i)\bFatal NI connect error\b"),
    ("THREAD_CANNOT_ALLOCATE_NEW_LOG", r"(?i)\bThread \d+ cannot allocate new log\b"),
    ("PRIVATE_STRAND_FLUSH_NOT_COMPLETE", r"(?i)\bPrivate strand flush not complete\b"),
    ("ASH_EMERGENCY_FLUSH", r"(?i)\bASH\) performed an emergency flush\b"),
    ("WARNING", r"(?i)\bWARNING\b"),
    ("ERROR", r"(?i)\bERROR\b"),
    ("INCIDENT", r"(?i)\bincident\b"),
    ("PROCESS_TERMINATING", r"(?i)\bterminating (?:the )?instance\b|\bterminating process\b"),
    ("FAILED", r"(?i)\bfailed\b"),
)
# Patterns of alert-log lines, and of what names a table in a statement.
TOO_MANY = r"(?i)\bWARNING:\s*too many parse errors,\s*count=(\d+)\b"
PARSE_ERROR = r"(?i)\bPARSE\s+ERROR:\s*ospid=\d+,\s*error=(\d+)\b"
ORA_CODE, TNS_CODE = r"(?i)\b(ORA-\d{4,5})\b", r"(?i)\b(TNS-\d{5})\b"
TABLE_NAME = r"\b(?:FROM|JOIN|UPDATE|INTO|MERGE\s+INTO|DELETE(?:\s+FROM)?)\s+([A-Z_$#][A-Z0-9_$#]*(?:\.[A-Z_$#][A-Z0-9_$#]*)*)"
# What of a statement is no table name: line comments, comments, texts.
NO_NAMES = (r"--[^\n]*", r"/\*[\s\S]*?\*/", "'[^']*'")
# Units of sizes in MB, of counts, of waits in ms.
SIZE_UNITS = {"K": 1 / 1024, "M": 1.0, "G": 1024.0, "T": 1024.0**2}
COUNT_UNITS = {"k": 1e3, "m": 1e6, "g": 1e9, "t": 1e12, "p": 1e15}
WAIT_UNITS = {"ns": 1e-6, "us": 1e-3, "ms": 1.0, "s": 1e3}
# Beginnings of statements that change data, and of blocks.
CHANGES, BLOCKS = ("UPDATE", "DELETE", "INSERT", "MERGE"), ("BEGIN", "DECLARE", "CALL")


def double(text: Column) -> Column:
    return text.try_cast("double")


def number(text: Column) -> Column:
    """A number with thousands commas, 0 if there is none."""
    return F.coalesce(double(F.regexp_replace(F.trim(text), ",", "")), F.lit(0.0))


def scaled(text: Column, units: dict[str, float], decimal_comma: bool = False) -> Column:
    """A number with a unit behind it, by the unit's factor; without a unit as it is; null if it is no number."""
    plain = F.regexp_replace(F.trim(text), ",", "." if decimal_comma else "")
    unit = F.regexp_extract(plain, r"([A-Za-z]+)$", 1)
    digits = F.when(unit != "", F.trim(F.regexp_replace(plain, r"[A-Za-z]+$", ""))).otherwise(plain)
    factor = reduce(lambda c, kv: c.when(unit == kv[0], kv[1]), units.items(), F.when(unit == "", 1.0))
    return double(digits) * factor


def size_mb(text: Column) -> Column:
    return scaled(text, SIZE_UNITS, decimal_comma=True)


def count(text: Column) -> Column:
    return scaled(text, COUNT_UNITS)


def wait_ms(text: Column) -> Column:
    return F.round(scaled(text, WAIT_UNITS), 6)


def statement(sql: Column) -> Column:
    """The kind of a statement by what it begins with; what is none of the known kinds is a query."""
    start = F.upper(F.ltrim(sql))
    plain = reduce(lambda c, k: c.when(start.startswith(k), k), CHANGES[1:], F.when(start.startswith(CHANGES[0]), CHANGES[0]))
    return plain.when(reduce(lambda x, y: x | y, (start.startswith(k) for k in BLOCKS)), "PL/SQL").otherwise("SELECT")


#: The beginning of a statement; prose has FROM and INTO without it.
STATEMENT = r"(?is)\bselect\b.+?\bfrom\b|\binsert\s+into\b|\bupdate\s+\S+(\s+\S+)?\s+set\b|\bmerge\s+into\b|\bdelete\s+(from\b|\S+\s+where\b)"


def tables(sql: Column) -> Column:
    """Names of tables in a statement, sorted.

    Line ends become blanks before comments go, so a line comment takes all that follows.
    """
    flat = F.regexp_replace(sql, r"[\n\r\t]", " ")
    bare = reduce(lambda c, p: F.regexp_replace(c, p, " "), (*NO_NAMES, r"\s+"), flat)
    found = F.regexp_extract_all(F.upper(bare), F.lit(TABLE_NAME), F.lit(1))
    last = lambda x: F.element_at(F.split(x, r"\."), -1)
    keep = lambda x: ~last(x).isin(*NO_TABLE) & ~reduce(lambda a, b: a | b, (x.startswith(s) for s in NO_SCHEMA)) & (x.contains(".") | (F.length(x) > 1))
    return F.array_sort(F.array_distinct(F.filter(found, keep)))


def has_statement(text: Column) -> Column:
    """Whether a text holds an SQL statement that names tables, in any case, over any line ends and comments."""
    bare = F.regexp_replace(F.regexp_replace(text, r"/\*[\s\S]*?\*/", " "), r"--[^\n]*", " ")
    lower = F.lower(text)  # most texts hold none of the words, which is quickly seen
    return reduce(lambda a, b: a | b, (lower.contains(w) for w in ("select", "insert", "update", "merge", "delete"))) & bare.rlike(STATEMENT)


def ora_code(digits: Column) -> Column:
    return F.concat(F.lit("ORA-"), F.lpad(digits, 5, "0"))


def alert_event(line: Column) -> Column:
    """Kind of an alert-log line: too many parse errors, a parse error's number, an ORA or TNS code, or a special event; else null."""
    parse, ora, tns = (F.regexp_extract(line, p, 1) for p in (PARSE_ERROR, ORA_CODE, TNS_CODE))
    out = F.when(line.rlike(TOO_MANY), "WARNING_TOO_MANY_PARSE_ERRORS")
    out = out.when(parse != "", F.concat(F.lit("PARSE_ERROR_"), ora_code(parse))).when(ora != "", F.upper(ora)).when(tns != "", F.upper(tns))
    return reduce(lambda c, kv: c.when(line.rlike(kv[1]), kv[0]), SPECIAL, out)


def ora_text(number_: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in ORA_TEXT.items() for x in kv))
    return F.coalesce(table[number_.cast("int")], F.lit(""))


def snippet(text: Column, size: int = 500) -> Column:
    """The beginning of a text and its whole length in bytes."""
    return F.struct(F.substring(text, 1, size).alias("snippet"), F.octet_length(text).alias("full_len"))


def token_estimate(text: Column) -> Column:
    """Tokens that a text may take: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def safe_name(name: Column) -> Column:
    """A name with all that a file name shouldn't hold replaced by underscores."""
    return F.regexp_replace(F.trim(name), r"[^\w.-]+", "_")


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its folder."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.?(/|$)") & ~path.contains("\\"), F.lit(False))


def safe_id(sql_id: Column) -> Column:
    """Whether a statement id has only letters and digits, 30 at most."""
    return F.coalesce(F.trim(sql_id).rlike(r"^[A-Za-z0-9]{1,30}$"), F.lit(False))


def without_thoughts(text: Column) -> Column:
    """A model's answer without its thinking blocks and code fences."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?m)^```\w*\s*$", ""), r"^\s+|\s+$", "")


def csv_field(text: Column) -> Column:
    """A field as CSV holds it."""
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def megabytes(value: Column, block_size: int | None = None) -> Column:
    """Bytes, or blocks of a size, as MB."""
    return value * (block_size or 1) / 2**20


def cpu_bound(most: Column, p95: Column, mean: Column, busy: Column) -> Column:
    """How near to its entitlement a system runs: by most, 95th percentile and mean of it, and the most that it was busy."""
    at_least = lambda x, y: F.coalesce(x >= y, F.lit(False))
    known = F.when(at_least(most, 98) | at_least(p95, 95), "confirmed").when(at_least(most, 90) | at_least(p95, 85), "likely").when(at_least(mean, 75) | at_least(busy, 85), "possible").otherwise("none")
    return F.when(most.isNotNull(), known).when(at_least(busy, 85), "busy_only").otherwise("unknown")
