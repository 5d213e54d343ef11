"""The queries pN_ of the text problems 8 to 10 and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmill.common import load
from snapmill.llm import mixing, packing, reading


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(load(spark, d, "documents"), load(spark, d, "pack_sizes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversize(p8_packed(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d), load(spark, d, "pack_sizes"))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p9_chosen(spark: SparkSession, d: str) -> DataFrame:
    return p9_mixed(spark, d).where("repeats > 0").select("doc_id", "source", "repeats")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached(p9_mixed(spark, d), load(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).where("short").select("source")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(load(spark, d, "documents"), load(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).select("doc_id", "read_level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    graded = load(spark, d, "documents").select("doc_id", "source").join(p10_levels(spark, d), "doc_id")
    return graded.groupBy("source", "read_level").agg(F.count(F.lit(1)).alias("documents"), F.avg("certainty").alias("certainty"))


QUERIES = {f.__name__: f for f in (p8_found, p8_packed, p8_fill, p9_found, p9_chosen, p9_shares, p10_found, p10_profile)}
SQL: dict[str, str] = {}
SQL["p9_found"] = """
WITH size AS (SELECT source, sum(length(text)) AS n FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN size USING (source)
WHERE coalesce(size.n, 0) * m.max_repeats < m.target_share * (SELECT sum(n) FROM size)"""
