"""Alert events and new reports as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapmill.functions.text import alert_event
from snapmill.sources.reports import parsed


def hourly_events(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Alert events per hour and kind of a stream of lines (``line, logged_at``), lines later than ``late`` left out."""
    rows = lines.withColumn("event", alert_event(F.col("line"))).where("event is not null").withWatermark("logged_at", late)
    return rows.groupBy(F.window("logged_at", "1 hour").alias("w"), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event", "n")


def stream_reports(spark: SparkSession, folder: str, checkpoint: str, store: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Parses reports as they arrive in a folder and hands each batch to ``store``; with ``once`` what is there now."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "[!.]*.{html,txt}").load(folder)
    writer = files.writeStream.foreachBatch(lambda batch, i: store(parsed(batch.select("path", "content")), i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
