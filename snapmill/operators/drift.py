"""Schemas that drift between JSON files: one consistent table, and every change of shape.

Each record becomes a map from field path to a raw value with its JSON kind. Kinds, counts and content of a path are aggregated by file,
inside the file's row; a file is compared with the previous one of its collector that has the section. A typed projection
then reads all files under the declared names and reports the casts that failed.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapmill.common import carried, cut, join_same

#: Declared fields and types of the consistent tables.
DECLARED = {
    "db_instance_information": {"db_id": "bigint", "instance_num": "smallint", "startup_time": "string", "release": "string", "rac": "string", "platform": "string", "cpus": "int", "cores": "int", "sockets": "smallint", "memory": "int"},
    "awrs.snap_info": {"begin_snap_id": "bigint", "end_snap_id": "bigint", "begin_snap_time": "string", "end_snap_time": "string"},
    "awrs.host_cpu": {"cpus": "bigint", "cores": "bigint", "sockets": "smallint", "load_avg_begin": "double", "load_avg_end": "double", "pct_user": "double", "pct_system": "double", "pct_wio": "double", "pct_idle": "double"},
    "awrs.foreground_wait_events": {"event": "string", "waits": "bigint", "total_wait_time_s": "double", "avg_wait": "double", "pct_dbtime": "double", "waitevent_histogram_ms": "map<string,float>"},
}
#: Least likeness of two names, with values of one kind, for one to be the other renamed; and where both hold one same value.
NAMES_ALIKE, NAMES_ALIKE_SAME = 0.4, 0.25


#: What holds sections beside fields of its own: the whole document, and what declared sections lie in. Any object or list of objects in it is
#: a section, declared or not.
ROOT = "$"
CONTAINERS = {ROOT} | {s.rsplit(".", 1)[0] for s in DECLARED if "." in s}
#: Longer values of a field are told apart by their hash.
LONG = 64


def kind(value: object) -> str | None:
    """Kind of a JSON value, None for a JSON null."""
    if value is None:
        return None
    return "truth" if isinstance(value, bool) else "text" if isinstance(value, str) else "number" if isinstance(value, int | float) else "list" if isinstance(value, list) else "object"


def plain(text: str) -> str:
    """``text`` without halves of surrogate pairs, which no table holds."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def dumped(value: object) -> str | None:
    return None if value is None else plain(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def no_number(name: str) -> None:
    raise ValueError(name)


def parsed(payload: str | None) -> tuple[dict | None, str | None]:
    """The object of a payload, or why there is none."""
    if payload is None:
        return None, "missing"
    try:
        doc = json.loads(payload, parse_constant=no_number)
    except (ValueError, RecursionError):
        return None, "no JSON"
    return (doc, None) if isinstance(doc, dict) else (None, "no object")


def objects(value: object, place: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], dict]]:
    """The objects of a value and its lists, with their places in these."""
    if isinstance(value, dict):
        yield place, value
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from objects(item, (*place, i))


def sections(value: object, name: str = ROOT, place: tuple[int, ...] = ()) -> Iterator[tuple[str, tuple[int, ...], dict]]:
    """Every record of a document: its section, its place in the lists on the way, its fields. Those of a container include its sections."""
    for at, record in objects(value, place):
        yield name, at, record
        if name in CONTAINERS:
            for key, inner in record.items():
                yield from sections(inner, key if name == ROOT else f"{name}.{key}", at)


def unreadable(files: DataFrame) -> DataFrame:
    """Files that hold no JSON object: ``file_id, reason`` (missing, no JSON or no object)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = pd.DataFrame({"file_id": f["file_id"], "reason": [parsed(p)[1] for p in f["payload"]]})
            yield rows[rows["reason"].notna()]

    return files.select("file_id", "payload").mapInPandas(run, "file_id bigint, reason string")


def tokens(name: Column) -> Column:
    """Words of a field name, lower case, without plural s."""
    split = F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z][a-z])", "$1_$2"), "[^A-Za-z0-9]+", "_")), "_")
    return F.array_distinct(F.transform(F.filter(split, lambda x: x != ""), lambda x: F.regexp_replace(x, "(?<=..)s$", "")))


def trigrams(name: Column) -> Column:
    plain = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", ""))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(plain) - 2, F.lit(1))), lambda i: F.substring(plain, i, F.lit(3))))


def alike(a: Column, b: Column) -> Column:
    """Likeness of two names: the greater Jaccard index of their words and of their trigrams."""
    jaccard = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.greatest(jaccard(tokens(a), tokens(b)), jaccard(trigrams(a), trigrams(b)))


SHAPE = pa.list_(pa.struct([("field", pa.string()), ("kind", pa.string()), ("kinds", pa.map_(pa.string(), pa.int64())), ("only", pa.string())]))
SHAPES = "file_id bigint, collector string, file_seq bigint, section string, fields array<struct<field:string,kind:string,kinds:map<string,bigint>,only:string>>"


def batch_of(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def shape(records: list[dict]) -> list[dict]:
    """Path-type statistics of a section's records: per field its most frequent kind, how many values are of each, and its value if all that
    aren't null are the same."""
    seen: dict[str, list] = {}
    for record in records:
        for field, value in record.items():
            here = seen.get(field)
            if here is None:
                here = seen[field] = [Counter(), None, True]
            if value is not None:
                if not here[0]:
                    here[1] = value
                elif here[2] and (type(value) is not type(here[1]) or value != here[1]):
                    here[2] = False
                here[0][kind(value)] += 1
    out = []
    for field, (kinds, value, same) in sorted(seen.items()):
        only = dumped(value) if same else None
        if only is not None and len(only) > LONG:
            only = hashlib.blake2b(only.encode(), digest_size=24).hexdigest()
        out.append({"field": plain(field), "kind": max(kinds, key=lambda k: (kinds[k], k)) if kinds else None, "kinds": [*kinds.items()], "only": only})
    return out


def shapes(files: DataFrame) -> DataFrame:
    """Path-type statistics by file and section: ``SHAPES``. A payload is parsed once and aggregated where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            rows = []
            for file_id, collector, seq, payload in zip(*(f[c].to_pylist() for c in ("file_id", "collector", "file_seq", "payload")), strict=True):
                by: dict[str, list[dict]] = {}
                for section, _, record in sections(parsed(payload)[0]):
                    by.setdefault(section, []).append(record)
                rows += [(file_id, collector, seq, plain(section), shape(records)) for section, records in by.items()]
            yield batch_of(rows, [pa.int64(), pa.string(), pa.int64(), pa.string(), SHAPE], ["file_id", "collector", "file_seq", "section", "fields"])

    return files.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("collector").cast("string").alias("collector"), "file_seq", "payload").mapInArrow(run, SHAPES)


def kinds_of(files: DataFrame) -> DataFrame:
    """How many values of each field are of each kind, by file: ``file_id, section, field, kind, n``."""
    long = shapes(_sequenced(files)).select("file_id", "section", F.explode("fields").alias("x")).select("file_id", "section", "x.field", F.explode("x.kinds").alias("kind", "n"))
    return long.groupBy("file_id", "section", "field", "kind").agg(F.sum("n").alias("n"))


def _sequenced(files: DataFrame) -> DataFrame:
    return files.select("file_id", "collector", F.coalesce(F.col("file_seq").cast("bigint"), F.lit(-1)).alias("file_seq"), "payload")


def compared(files: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Shapes of each file (``new``) with those of the previous file of its collector that has the section (``old``), and the distinct sets of
    fields that files have.

    Files come in ranges of collector, section and sequence of like size; a collector with a third of all files is spread like any other.
    """
    fields = "transform(fields, x -> named_struct('field', x.field, 'kind', x.kind, 'only', x.only))"
    rows = shapes(files).select("collector", "section", "file_seq", "file_id", F.expr(fields).alias("new")).withColumn("version", F.xxhash64("new")).dropDuplicates(["collector", "section", "file_seq", "file_id", "version"])
    # files of one place in the sequence follow each other by file_id, different rows of one file by a hash
    pairs = cut(carried(rows, ["collector", "section"], ["file_seq", "file_id", "version"], "new", "old", partitions))
    return pairs, pairs.select("section", F.col("new.field").alias("names")).distinct()


def changes(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every change of shape: ``file_id, section, field, change_kind, new_field``.

    Sections are the declared ones, any others, and the containers they lie in (``$`` is the whole document): a section that comes or goes is
    a change of its container.

    ``change_kind`` is ``added``, ``removed``, ``renamed`` (``field`` is the old name, ``new_field`` the new one) or ``retyped``. A
    field went under another name where one is gone and one is new, both hold values of one kind, no file anywhere has both, and
    their names are alike or they hold the same single value, a longer text or under names somewhat alike; or, if values are missing to tell, where other files
    show that pair renamed. Best pairs win. A JSON null keeps a field in the shape but says nothing about its kind: a kind is
    compared with the last known one. ``files`` needs ``file_id, collector, file_seq, payload``; further columns are ignored. Files
    that are no JSON object are passed over (``unreadable`` tells them), as are sections with empty lists. Where values of a field in one file are
    of several kinds, the most frequent counts. A null collector is a collector; a null ``file_seq``
    comes first. Equal ``file_seq`` of one collector follow each other by ``file_id``. An empty table gives an empty result.
    """
    pairs, names = compared(_sequenced(files), partitions)
    name = lambda c: F.col(f"{c}.field")
    fresh = F.filter("new", lambda x: ~F.array_contains(name("old"), x["field"]))
    gone = F.filter("old", lambda x: ~F.array_contains(name("new"), x["field"]))
    moved = pairs.where("old is not null").select("section", "file_id", fresh.alias("fresh"), gone.alias("gone")).where("size(fresh) > 0 or size(gone) > 0")
    possible = moved.select("section", "file_id", F.explode("fresh").alias("g"), "gone").select("section", "file_id", "g", F.explode("gone").alias("f"))
    together = names.select("section", F.explode("names").alias("a"), "names").select("section", "a", F.explode("names").alias("b")).where("a <> b").distinct()
    p, t = possible.alias("p"), together.alias("t")
    apart = p.join(t, (F.col("p.section") == F.col("t.section")) & (F.col("p.f.field") == F.col("t.a")) & (F.col("p.g.field") == F.col("t.b")), "left_anti")
    one = F.col("f.only") == F.col("g.only")
    text = (F.col("f.kind") == "text") & (F.length("f.only") > 5)
    like = alike(F.col("f.field"), F.col("g.field"))
    open_ = F.col("f.kind").isNull() | F.col("g.kind").isNull()
    scored = apart.where(open_ | (F.col("f.kind") == F.col("g.kind"))).withColumn("like", like).withColumn("one", F.coalesce(one, F.lit(False)))
    scored = scored.withColumn("sure", ~open_ & ((F.col("like") >= NAMES_ALIKE) | (F.col("one") & (text | (F.col("like") >= NAMES_ALIKE_SAME)))))
    known = scored.where("sure").select("section", F.array_sort(F.array("f.field", "g.field")).alias("pair")).distinct().withColumn("known", F.lit(True))
    scored = scored.withColumn("pair", F.array_sort(F.array("f.field", "g.field"))).join(known, ["section", "pair"], "left")
    fit = scored.where(F.col("known") | (open_ & (F.col("like") >= NAMES_ALIKE))).withColumn("score", F.col("like") + F.col("one").cast("int") + F.coalesce(F.col("sure").cast("int"), F.lit(0)))
    best = lambda side: F.row_number().over(Window.partitionBy("file_id", "section", f"{side}.field").orderBy(F.col("score").desc(), "f.field", "g.field"))
    renamed = fit.withColumn("nf", best("f")).withColumn("ng", best("g")).where("nf = 1 and ng = 1").select("file_id", "section", F.col("f.field").alias("field"), F.lit("renamed").alias("change_kind"), F.col("g.field").alias("new_field"))
    plain = moved.select("file_id", "section", F.explode(F.concat(F.transform("fresh", lambda x: F.struct(x["field"].alias("field"), F.lit("added").alias("change_kind"))), F.transform("gone", lambda x: F.struct(x["field"].alias("field"), F.lit("removed").alias("change_kind"))))).alias("x")).select("file_id", "section", "x.*")
    used = renamed.select("file_id", "section", F.explode(F.array(F.struct(F.col("field"), F.lit("removed").alias("change_kind")), F.struct(F.col("new_field").alias("field"), F.lit("added").alias("change_kind")))).alias("x")).select("file_id", "section", "x.*")
    rest = plain.join(used, ["file_id", "section", "field", "change_kind"], "left_anti").withColumn("new_field", F.lit(None).cast("string"))
    # a kind against that of the file before; where that is unknown, against the last known one
    long = pairs.select("collector", "section", "file_seq", "file_id", "version", F.explode("new").alias("x"), F.map_from_entries(F.transform("old", lambda x: F.struct(x["field"], x["kind"]))).alias("old"))
    long = long.select("collector", "section", "file_seq", "file_id", "version", "x.field", "x.kind", F.coalesce(F.map_contains_key("old", F.col("x.field")), F.lit(False)).alias("kept"), F.col("old")[F.col("x.field")].alias("last"))
    open_ = long.where("kept and kind is not null and last is null").select("collector", "section", "field").distinct()
    some = join_same(long.where("kind is not null"), open_.withColumn("o", F.lit(1)), ["collector", "section", "field"]).drop("o")
    before = carried(some, ["collector", "section", "field"], ["file_seq", "file_id", "version"], "kind", "was", partitions)
    changed_kind = long.where("kept and kind <> last").unionByName(before.where("kept and last is null and kind <> was").drop("was"))
    retyped = changed_kind.select("file_id", "section", "field", F.lit("retyped").alias("change_kind"), F.lit(None).cast("string").alias("new_field"))
    return renamed.unionByName(rest).unionByName(retyped)


def other_names(changed: DataFrame) -> DataFrame:
    """Declared names of renamed fields: ``section, field, declared``, through any number of renamings, the nearest declared name first.

    The distinct renamings, which are few, come to the driver.
    """
    pairs = changed.where("change_kind = 'renamed'").select("section", "field", "new_field").distinct().collect()
    beside: dict[tuple[str, str], set[str]] = {}
    for section, old, new in pairs:
        beside.setdefault((section, old), set()).add(new)
        beside.setdefault((section, new), set()).add(old)
    found = {(section, f): f for section, fields in DECLARED.items() for f in fields}
    last = found
    while last:  # one renaming further; of several declared names at one distance the least holds
        step: dict[tuple[str, str], str] = {}
        for (section, f), declared in last.items():
            for name in beside.get((section, f), ()):
                if (section, name) not in found:
                    step[section, name] = min(declared, step.get((section, name), declared))
        found, last = found | step, step
    return changed.sparkSession.createDataFrame([(*at, declared) for at, declared in found.items()], "section string, field string, declared string")


def records(files: DataFrame, renamed: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Every record of all sections, or of those named: ``file_id, section, record``, ``declared`` (declared name to value) and ``others`` (name
    to value of all other fields). Values are JSON texts, null for a JSON null. Where a record has several fields of one declared name, a value
    goes before a null and the declared name before another one; the rest are ``others``, under their own names. A container's record has the
    fields that are no sections, and is left out if it has none."""
    of: dict[str, dict[str, str]] = {}
    for section, field, declared in renamed.select("section", "field", "declared").collect():  # distinct names
        of.setdefault(section, {})[field] = declared

    def split(section: str, record: dict) -> tuple[list, list]:
        known = of.get(section, {})
        texts = [(plain(field), dumped(value)) for field, value in record.items()]
        best: dict[str, tuple] = {}
        for field, text in texts:
            if (name := known.get(field)) is not None:
                best[name] = min(best.get(name, (True, True, field, text)), (text is None, field != name, field, text), key=lambda x: x[:3])
        used = {x[2] for x in best.values()}
        return [(name, x[3]) for name, x in best.items()], [(field, text) for field, text in texts if field not in used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.map_(pa.string(), pa.string())
        for f in batches:
            rows = []
            for file_id, payload in zip(f["file_id"].to_pylist(), f["payload"].to_pylist(), strict=True):
                for section, place, record in sections(parsed(payload)[0]):
                    if only is not None and section not in only:
                        continue
                    if section in CONTAINERS:
                        record = {k: v for k, v in record.items() if next(objects(v, ()), None) is None}
                        if not record:
                            continue
                    rows.append((file_id, plain(section), list(place), *split(section, record)))
            yield batch_of(rows, [pa.int64(), pa.string(), pa.list_(pa.int32()), texts, texts], ["file_id", "section", "record", "declared", "others"])

    return files.select(F.col("file_id").cast("bigint").alias("file_id"), "payload").mapInArrow(run, "file_id bigint, section string, record array<int>, declared map<string,string>, others map<string,string>")


def _read(name: str, sql: str) -> tuple[Column, Column]:
    """A declared field of ``records`` under its type, and what to say if it can't be cast."""
    raw = F.col("declared")[name]
    plain = F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw)
    cast = F.from_json(F.when(raw.startswith("{"), raw), sql) if sql.startswith("map") else F.try_cast(plain, sql) if hasattr(F, "try_cast") else plain.try_cast(sql)
    return cast, F.when(raw.isNotNull() & cast.isNull(), F.concat(F.lit(f"{name}="), raw))


def consistent(files: DataFrame, section: str, renamed: DataFrame) -> DataFrame:
    """All records of a section under the declared names and types, whatever the shape of their file.

    Returns ``file_id, record``, the declared fields, ``others``: the fields that aren't declared, under no known other name, as a map of name
    to JSON text, and ``failed``: the fields whose value is not null but can't be cast, as ``field=value``. ``renamed`` is from
    ``other_names``.
    """
    read = {name: _read(name, sql) for name, sql in DECLARED[section].items()}
    return records(files, renamed, (section,)).select("file_id", "record", *(cast.alias(n) for n, (cast, _) in read.items()), "others", F.array_compact(F.array(*(bad for _, bad in read.values()))).alias("failed"))


def table(files: DataFrame, renamed: DataFrame) -> DataFrame:
    """All records of all sections, declared or not, as one table: ``file_id, section, record``, the declared fields of every section, ``others`` and ``failed`` as in
    ``consistent``. A field that several sections declare has the widest of their types; those that a section doesn't declare are
    null in its rows."""
    widths = ["smallint", "int", "bigint"]
    types, casts, failed = {}, {}, []
    for section, fields in DECLARED.items():
        own = F.col("section") == section
        for name, sql in fields.items():
            cast, bad = _read(name, sql)
            types[name] = max(types.get(name, sql), sql, key=lambda t: widths.index(t) if t in widths else 0)
            casts.setdefault(name, []).append(F.when(own, cast))
            failed.append(F.when(own, bad))
    fields = [F.coalesce(*(c.cast(types[n]) for c in own)).alias(n) for n, own in casts.items()]
    return records(files, renamed).select("file_id", "section", "record", *fields, "others", F.array_compact(F.array(*failed)).alias("failed"))
