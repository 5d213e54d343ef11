import json

from conftest import DATA, rows
from pyspark.sql import functions as F

from snapmill.common import load
from snapmill.operators import drift

TYPES = "file_id bigint, collector string, file_seq bigint, payload string"


def doc(instance=None, hosts=(), waits=(), snaps=()):
    awrs = [{"host_cpu": h} for h in hosts] + [{"snap_info": s} for s in snaps] + [{"foreground_wait_events": w} for w in waits]
    out = {"awrs": awrs}
    if instance is not None:
        out["db_instance_information"] = instance
    return json.dumps(out)


def changed(spark, docs, collector="c", **kwargs):
    df = spark.createDataFrame([(i + 1, collector, i + 1, x) for i, x in enumerate(docs)], TYPES)
    return sorted((r.file_id, r.section.split(".")[-1], r.field, r.change_kind, r.new_field) for r in drift.changes(df, **kwargs).collect())


def test_kinds_of_change(spark):
    docs = [doc({"release": "19.3.0.0.0", "cpus": 4, "rac": "NO"}), doc({"cpus": 4, "version": "19.3.0.0.0", "rac": "NO"}), doc({"cpus": "4", "version": "19.3.0.0.0"}), doc({"cpus": "4", "version": "19.3.0.0.0", "edition": "EE"})]
    assert changed(spark, docs) == [(2, "db_instance_information", "release", "renamed", "version"), (3, "db_instance_information", "cpus", "retyped", None), (3, "db_instance_information", "rac", "removed", None), (4, "db_instance_information", "edition", "added", None)]
    assert changed(spark, docs, partitions=3) == changed(spark, docs)


def test_nulls_and_empty_lists_say_nothing(spark):
    docs = [doc({"a": 1}, waits=[[{"event": "x", "waits": 1}]]), doc({"a": None}, waits=[[]]), doc({"a": 2.5}), doc({"a": None}), doc({"a": "2"}, waits=[[{"event": "x", "waits": None}]])]
    assert changed(spark, docs) == [(5, "db_instance_information", "a", "retyped", None)]


def test_fields_seen_together_are_no_renaming(spark):
    docs = [doc(hosts=[{"pct_user": 1.5, "pct_steal": 1.5}]), doc(hosts=[{"pct_user": 1.5}]), doc(hosts=[{"pct_steal": 1.5}])]
    assert [(i, f, k) for i, _, f, k, _ in changed(spark, docs)] == [(2, "pct_steal", "removed"), (3, "pct_steal", "added"), (3, "pct_user", "removed")]


def test_lists_and_what_lies_inside(spark):
    docs = [doc(waits=[[{"event": "x", "waitevent_histogram_ms": {"a": 1}}, {"event": "y"}]]), doc(waits=[[{"event": "x", "waitevent_histogram_ms": {"b": "q"}}]]), doc(waits=[[{"event": "x", "wait_histogram": {"b": 1}}]]), doc(waits=[[{"event": "x", "wait_histogram": [1]}]])]
    assert [(i, f, k, n) for i, _, f, k, n in changed(spark, docs)] == [(3, "waitevent_histogram_ms", "renamed", "wait_histogram"), (4, "wait_histogram", "retyped", None)]


def test_edges(spark):
    df = spark.createDataFrame([(1, "c", 1, doc({"a": 1})), (2, "c", 2, "no json"), (3, "c", 3, None), (4, "c", 4, ""), (5, "c", 5, "[]"), (6, "c", 6, '{"db_instance_information": null, "awrs": null}'), (7, "c", 7, doc({"a": 1, "b": "x" * 200_000})), (8, None, 1, doc({"z": 1})), (9, None, None, doc({"y": 1})), (7, "c", 7, doc({"a": 1, "b": "x" * 200_000}))], TYPES)
    clash = df.withColumn("section", F.lit(1)).withColumn("field", F.lit(2)).withColumn("rank", F.lit(3))
    got = sorted((r.file_id, r.field, r.change_kind) for r in drift.changes(clash).collect())
    assert got == [(7, "b", "added"), (8, "y", "removed"), (8, "z", "added")]
    assert drift.changes(df.limit(0)).count() == 0


def brute(files):
    """Changes but renamings, file after file."""
    out, last, kinds = set(), {}, {}
    word = lambda v: "truth" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "text" if isinstance(v, str) else "list" if isinstance(v, list) else "object"
    for f in sorted(files, key=lambda f: (f.collector, f.file_seq, f.file_id)):
        top = json.loads(f.payload)
        awrs = top.get("awrs") or []
        of = {"db_instance_information": [top["db_instance_information"]] if top.get("db_instance_information") else [], "awrs.snap_info": [a["snap_info"] for a in awrs if a.get("snap_info")], "awrs.host_cpu": [a["host_cpu"] for a in awrs if a.get("host_cpu")], "awrs.foreground_wait_events": [e for a in awrs for e in a.get("foreground_wait_events") or []]}
        for section, objects in of.items():
            if not objects:
                continue
            fields = {k for o in objects for k in o}
            known = {k: word(o[k]) for o in objects for k in o if o[k] is not None}
            before = last.get((f.collector, section))
            if before is not None:
                out |= {(f.file_id, section, k, "added") for k in fields - before} | {(f.file_id, section, k, "removed") for k in before - fields}
                out |= {(f.file_id, section, k, "retyped") for k in fields & before if k in known and kinds.get((f.collector, section, k), known[k]) != known[k]}
            kinds |= {(f.collector, section, k): v for k, v in known.items()}
            last[f.collector, section] = fields
    return out


def test_same_as_brute_force(spark):
    files = load(spark, f"{DATA}/sf0.01", "report_files")
    got = set()
    for r in drift.changes(files).where(F.col("section").isin(*drift.DECLARED)).collect():
        got |= {(r.file_id, r.section, r.field, "removed"), (r.file_id, r.section, r.new_field, "added")} if r.change_kind == "renamed" else {(r.file_id, r.section, r.field, r.change_kind)}
    assert got == brute(files.collect())


def test_consistent_table(spark):
    files = spark.createDataFrame([(1, "c", 1, doc(hosts=[{"cpus": 4, "pct_idle": 1}])), (2, "c", 2, doc(hosts=[{"num_cpus": "4", "pct_idle": "n/a"}])), (3, "c", 3, doc(hosts=[{"num_cpus": 4, "pct_idle": None}]))], TYPES)
    names = drift.other_names(spark.createDataFrame([(2, "awrs.host_cpu", "cpus", "renamed", "num_cpus")], "file_id bigint, section string, field string, change_kind string, new_field string"))
    got = rows(drift.consistent(files, "awrs.host_cpu", names).select("file_id", "cpus", "pct_idle", "failed"))
    assert got == [(1, 4, 1.0, []), (2, 4, None, ['pct_idle="n/a"']), (3, 4, None, [])]


RENAMED = "file_id bigint, section string, field string, change_kind string, new_field string"


def test_table_holds_all_sections(spark):
    instance = {"db_id": 7, "cpus": 3_000_000_000, "edition": "EE"}
    files = spark.createDataFrame([(1, "c", 1, doc(instance, [{"cpus": 4, "pct_steal": 0.5, "numa_nodes": None}], [[{"event": "x", "con_id": 3}, {"event": None}]], [{"begin_snap_id": "12", "sessions": [1]}])), (2, "c", 2, doc(hosts=[{"cpus": None, "num_cpus": 8}, {"cpus": 2, "num_cpus": 9}, {}]))], TYPES)
    names = drift.other_names(spark.createDataFrame([(2, "awrs.host_cpu", "cpus", "renamed", "num_cpus")], RENAMED))
    got = drift.table(files, names)
    assert got.select("cpus", "event", "waits", "release", "load_avg_end").dtypes == [("cpus", "bigint"), ("event", "string"), ("waits", "bigint"), ("release", "string"), ("load_avg_end", "double")]
    told = sorted((r.file_id, r.section.split(".")[-1], r.record, r.cpus, r.event, r.begin_snap_id, sorted(r.others.items()), r.failed) for r in got.collect())
    assert told == [
        (1, "db_instance_information", [], None, None, None, [("edition", '"EE"')], ["cpus=3000000000"]),
        (1, "foreground_wait_events", [2, 0], None, "x", None, [("con_id", "3")], []),
        (1, "foreground_wait_events", [2, 1], None, None, None, [], []),
        (1, "host_cpu", [0], 4, None, None, [("numa_nodes", None), ("pct_steal", "0.5")], []),
        (1, "snap_info", [1], None, None, 12, [("sessions", "[1]")], []),
        (2, "host_cpu", [0], 8, None, None, [("cpus", None)], []),
        (2, "host_cpu", [1], 2, None, None, [("num_cpus", "9")], []),
        (2, "host_cpu", [2], None, None, None, [], []),
    ]


def test_table_loses_no_value(spark):
    files = load(spark, f"{DATA}/sf0.01", "report_files")
    got = drift.table(files, drift.other_names(drift.changes(files)))
    declared = sorted({n for fields in drift.DECLARED.values() for n in fields})
    held = sum((F.col(n).isNotNull().cast("int") for n in declared), F.size("failed")) + F.size(F.filter(F.map_values("others"), lambda v: v.isNotNull()))
    n = got.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum(held).alias("held")).collect()
    want = dict.fromkeys(drift.DECLARED, (0, 0))
    for f in files.collect():
        top = json.loads(f.payload)
        awrs = top.get("awrs") or []
        of = {"db_instance_information": [top.get("db_instance_information")], "awrs.snap_info": [a.get("snap_info") for a in awrs], "awrs.host_cpu": [a.get("host_cpu") for a in awrs], "awrs.foreground_wait_events": [e for a in awrs for e in a.get("foreground_wait_events") or []]}
        for section, objects in of.items():
            objects = [o for o in objects if o is not None]
            want[section] = (want[section][0] + len(objects), want[section][1] + sum(v is not None for o in objects for v in o.values()))
    assert {r.section: (r.n, r.held) for r in n if r.section in want} == want
    assert {r.section for r in n} - set(want) == {"awrs"}


def test_names_through_many_renamings(spark):
    chain = ["cpus", "num_cpus", "cpu_num", "cpu_total", "total_cpu", "cpu_sum"]
    changed = spark.createDataFrame([(i, "awrs.host_cpu", a, "renamed", b) for i, (a, b) in enumerate(zip(chain, chain[1:]))], RENAMED)
    names = {(r.section, r.field): r.declared for r in drift.other_names(changed).collect()}
    assert {names["awrs.host_cpu", n] for n in chain} == {"cpus"}
    assert names["db_instance_information", "cpus"] == "cpus" and len(names) == sum(map(len, drift.DECLARED.values())) + 5


def test_sections_that_nobody_declared(spark):
    """A new section is a change of what it lies in, its own changes are told, and the table holds its records."""
    docs = [{"db_instance_information": {"a": 1}, "awrs": [{"file_name": "f", "host_cpu": {"cpus": 1}}]} for _ in range(4)]
    docs[2]["awrs"][0]["sga_stats"] = [{"pool": "x", "mb": 1}]
    docs[3]["awrs"][0]["sga_stats"] = [{"pool": "x", "mb": "1"}, {"pool": "y", "mb": "2", "free": True}]
    docs[3]["note"] = "q"
    texts = [json.dumps(d) for d in docs]
    assert changed(spark, texts) == [(3, "awrs", "sga_stats", "added", None), (4, "$", "note", "added", None), (4, "sga_stats", "free", "added", None), (4, "sga_stats", "mb", "retyped", None)]
    files = spark.createDataFrame([(i + 1, "c", i + 1, x) for i, x in enumerate(texts)], TYPES)
    got = drift.table(files, drift.other_names(drift.changes(files))).where("section in ('$', 'awrs', 'awrs.sga_stats')")
    told = sorted((r.file_id, r.section, r.record, sorted(r.others.items())) for r in got.collect())
    assert told[-3:] == [(4, "awrs", [0], [("file_name", '"f"')]), (4, "awrs.sga_stats", [0, 0], [("mb", '"1"'), ("pool", '"x"')]), (4, "awrs.sga_stats", [0, 1], [("free", "true"), ("mb", '"2"'), ("pool", '"y"')])]
    assert (4, "$", [], [("note", '"q"')]) in told and len(told) == 8


def test_mixed_kinds_are_counted(spark):
    files = spark.createDataFrame([(1, "c", 1, doc(hosts=[{"a": 4}, {"a": "x"}, {"a": 5}, {"a": None}])), (2, "c", 2, doc(hosts=[{"a": "4"}, {"a": "x"}, {"a": 5}]))], TYPES)
    got = {(r.file_id, r.field, r.kind): r.n for r in drift.kinds_of(files).where("section = 'awrs.host_cpu'").collect()}
    assert got == {(1, "a", "number"): 2, (1, "a", "text"): 1, (2, "a", "number"): 1, (2, "a", "text"): 2}
    assert [(r.file_id, r.field, r.change_kind) for r in drift.changes(files).collect()] == [(2, "a", "retyped")]


def test_unreadable_files_are_told(spark):
    files = spark.createDataFrame([(1, "c", 1, doc({"a": 1})), (2, "c", 2, '{"a": '), (3, "c", 3, None), (4, "c", 4, "[1]"), (5, "c", 5, '{"a": NaN}'), (6, "c", 6, "[" * 100_000)], TYPES)
    assert rows(drift.unreadable(files)) == [(2, "no JSON"), (3, "missing"), (4, "no object"), (5, "no JSON"), (6, "no JSON")]


def test_five_renamings_reach_the_declared_name(spark):
    names = ["cpus", "num_cpus", "num_cpus_all", "cpus_all", "total_cpus_all", "total_cpus"]
    files = spark.createDataFrame([(i + 1, "c", i + 1, doc(hosts=[{n: i + 1, "pct_idle": 1.0}])) for i, n in enumerate(names)], TYPES)
    changes = drift.changes(files)
    assert [(r.field, r.new_field) for r in changes.orderBy("file_id").collect()] == [*zip(names, names[1:], strict=False)]
    assert [r.cpus for r in drift.consistent(files, "awrs.host_cpu", drift.other_names(changes)).orderBy("file_id").collect()] == [1, 2, 3, 4, 5, 6]


def test_odd_texts(spark):
    files = spark.createDataFrame([(1, "c", 1, '{"awrs": [{"host_cpu": {"a": "\\ud800", "\\ud801k": "\u00e4", "big": ' + "9" * 400 + "}}]}"), (2, "c", 2, doc(hosts=[{"a": "x"}]))], TYPES)
    assert {(r.field, r.change_kind) for r in drift.changes(files).collect()} == {("?k", "removed"), ("big", "removed")}
    assert drift.table(files, drift.other_names(drift.changes(files))).where("size(others) > 0").count() == 2
