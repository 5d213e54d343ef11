"""Collections of reports as nested JSON, and the long tables in them.

The schema is declared, so a read infers nothing and prunes to the sections that a query uses. Counters that wrapped below zero
are read as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, ShortType, StructType, IntegerType

# The nested schema; misspelt names are part of the format.
_WAIT = "struct<event:string,waits:bigint,total_wait_time_s:double,avg_wait:double,pct_dbtime:double,waitevent_histogram_ms:map<string,float>>"
_PCTS = "pct_total:double,pct_cpu:double,pct_io:double,sql_module:string"
SECTIONS = {
    "load_profile": "array<struct<stat_name:string,per_second:double,per_transaction:double>>",
    "instance_efficiency": "array<struct<eff_stat:string,eff_pct:float>>",
    "redo_log": "struct<stat_name:string,per_hour:double>",
    "wait_classes": "array<struct<wait_class:string,waits:bigint,total_wait_time_s:double,avg_wait_ms:double,db_time_pct:double>>",
    "host_cpu": "struct<cpus:bigint,cores:bigint,sockets:smallint,load_avg_begin:double,load_avg_end:double,pct_user:double,pct_system:double,pct_wio:double,pct_idle:double>",
    "time_model_stats": "array<struct<stat_name:string,time_s:double,pct_dbtime:double>>",
    "foreground_wait_events": f"array<{_WAIT}>",
    "background_wait_events": f"array<{_WAIT}>",
    "sql_elapsed_time": f"array<struct<sql_id:string,elapsed_time_s:double,executions:bigint,elpased_time_exec_s:double,{_PCTS},sql_type:string>>",
    "sql_cpu_time": f"map<string,struct<sql_id:string,cpu_time_s:double,executions:bigint,cpu_time_exec_s:double,{_PCTS}>>",
    "sql_io_time": f"map<string,struct<sql_id:string,io_time_s:double,executions:bigint,io_time_exec_s:double,{_PCTS}>>",
    "sql_gets": f"map<string,struct<sql_id:string,buffer_gets:double,executions:bigint,gets_per_exec:double,{_PCTS}>>",
    "sql_reads": "map<string,struct<sql_id:string,physical_reads:double,executions:bigint,reads_per_exec:double,pct_total:double,cpu_time_pct:double,pct_io:double,sql_module:string>>",
    "top_sql_with_top_events": "map<string,struct<sql_id:string,plan_hash_value:bigint,executions:bigint,pct_activity:double,event_name:string,pct_event:double,top_row_source:string,pct_row_source:double>>",
    "instance_stats": "array<struct<statname:string,total:bigint>>",
    "dictionary_cache": "array<struct<statname:string,get_requests:bigint,final_usage:bigint>>",
    "io_stats_byfunc": "map<string,struct<reads_data:double,reads_req_s:double,reads_data_s:double,writes_data:double,writes_req_s:double,writes_data_s:double,waits_count:bigint,avg_time:double>>",
    "library_cache": "array<struct<statname:string,get_requests:bigint,get_pct_miss:double,pin_requests:bigint>>",
    "latch_activity": "array<struct<statname:string,get_requests:bigint,get_pct_miss:double,wait_time:double>>",
    "segment_stats": "map<string,array<struct<obj:bigint,objd:bigint,object_name:string,object_type:string,stat_name:string,stat_vlalue:double>>>",
}
SNAPSHOT = "struct<file_name:string,status:string,snap_info:struct<begin_snap_id:bigint,end_snap_id:bigint,begin_snap_time:string,end_snap_time:string>," + ",".join(f"{k}:{v}" for k, v in SECTIONS.items()) + ">"
INSTANCE = "struct<db_id:bigint,instance_num:smallint,startup_time:string,release:string,rac:string,platform:string,cpus:int,cores:int,sockets:smallint,memory:int,db_block_size:int>"
SCHEMA = f"db_instance_information {INSTANCE}, initialization_parameters map<string,string>, sql_text map<string,string>, awrs array<{SNAPSHOT}>"
# Fields that are never negative.
UNSIGNED = frozenset((
    "begin_snap_id", "cores", "cpus", "db_block_size", "db_id", "end_snap_id", "executions", "final_usage", "get_requests", "instance_num",
    "memory", "obj", "objd", "pin_requests", "plan_hash_value", "samples", "sockets", "total", "waits", "waits_count",
))


def clamped(value: Column, kind, name: str = "") -> Column:
    """A nested value with negative numbers of the unsigned fields as 0."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(clamped(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: clamped(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: clamped(v, kind.valueType))
    if isinstance(kind, LongType | IntegerType | ShortType) and name in UNSIGNED:
        return F.when(value.isNotNull(), F.greatest(value, F.lit(0).cast(kind)))
    return value


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Collections of a path, one row per file, unsigned fields clamped."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return raw.select(*(clamped(F.col(f.name), f.dataType, f.name).alias(f.name) for f in raw.schema.fields))


def snapshots(collections: DataFrame) -> DataFrame:
    """One row per report with its instance and snapshot ids; sections as columns, pruned to those a query uses."""
    info = F.col("db_instance_information")
    rows = collections.select(info["db_id"].alias("db_id"), info["instance_num"].alias("instance_num"), F.explode("awrs").alias("a"))
    si = F.col("a.snap_info")
    return rows.select("db_id", "instance_num", si["begin_snap_id"].alias("snap_id"), si["end_snap_id"].alias("end_id"), si["begin_snap_time"].alias("begins"), si["end_snap_time"].alias("ends"), F.col("a.file_name").alias("file_name"), F.col("a.status").alias("status"), *(F.col(f"a.{s}").alias(s) for s in SECTIONS))


def section(reports: DataFrame, name: str) -> DataFrame:
    """One section of ``snapshots`` as a long table; a map's keys, where they are not in its values, as ``category``."""
    at = ["db_id", "instance_num", "snap_id"]
    kind = reports.schema[name].dataType
    if isinstance(kind, StructType):
        return reports.where(F.col(name).isNotNull()).select(*at, f"{name}.*")
    if isinstance(kind, ArrayType):
        return reports.select(*at, F.explode(name).alias("x")).select(*at, "x.*")
    rows = reports.select(*at, F.explode(name).alias("category", "x"))
    if isinstance(kind.valueType, ArrayType):
        return rows.select(*at, "category", F.explode("x").alias("y")).select(*at, "category", "y.*")
    return rows.select(*at, "category", "x.*")


def histogram(reports: DataFrame, kind: str = "foreground") -> DataFrame:
    """Wait histograms, one row per bucket: its number, label and share."""
    waits = section(reports, f"{kind}_wait_events")
    rows = waits.select("db_id", "instance_num", "snap_id", "event", F.explode("waitevent_histogram_ms").alias("bucket", "pct"))
    return rows.withColumn("bucket_no", F.split("bucket", ":")[0].cast("int")).withColumn("label", F.trim(F.substring_index("bucket", ":", -1)))


def metrics(reports: DataFrame) -> DataFrame:
    """All numeric series as ``db_id, instance_num, snap_id, kind, name, field, value``."""
    out = None
    for name, label in (("load_profile", "stat_name"), ("time_model_stats", "stat_name"), ("instance_stats", "statname"), ("wait_classes", "wait_class"), ("foreground_wait_events", "event"), ("background_wait_events", "event"), ("dictionary_cache", "statname"), ("library_cache", "statname"), ("latch_activity", "statname"), ("sql_elapsed_time", "sql_id"), ("sql_cpu_time", "sql_id"), ("sql_io_time", "sql_id"), ("sql_gets", "sql_id"), ("sql_reads", "sql_id"), ("redo_log", "stat_name"), ("io_stats_byfunc", "category")):
        df = section(reports, name)
        numbers = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "bigint", "float") and f.name not in ("db_id", "snap_id")]
        long = df.select("db_id", "instance_num", "snap_id", F.lit(name).alias("kind"), F.col(label).alias("name"), *(F.col(n).cast("double").alias(n) for n in numbers)).unpivot(["db_id", "instance_num", "snap_id", "kind", "name"], numbers, "field", "value")
        out = long if out is None else out.unionByName(long)
    return out.where("value is not null")


def masked(reports: DataFrame, level: int) -> DataFrame:
    """Segment names hidden at level 0."""
    if level > 0:
        return reports
    hidden = F.transform_values("segment_stats", lambda _, v: F.transform(v, lambda x: x.withField("object_name", F.lit("#"))))
    return reports.withColumn("segment_stats", hidden)


def merged_texts(texts: DataFrame) -> DataFrame:
    """``sql_id, text`` of several files (``file_name, sql_text``): the first file's text of each id holds."""
    rows = texts.select("file_name", F.explode("sql_text").alias("sql_id", "text"))
    return rows.groupBy("sql_id").agg(F.min_by("text", "file_name").alias("text"))
