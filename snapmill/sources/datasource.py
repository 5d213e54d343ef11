"""``spark.read.format("snapreport").load(folder)``: reports of a folder as rows, and folders as streams."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from snapmill.sources.reports import read_report

COLUMNS = "file_name string, begin_snap_id bigint, end_snap_id bigint, document string"


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapreport"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return ReportReader(self.options["path"])


class ReportReader(DataSourceReader):
    """A partition per file, so that a folder is parsed in parallel."""

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        files = sorted(f for e in ("html", "txt") for f in glob.glob(os.path.join(self.path, f"*.{e}")) if not os.path.basename(f).startswith("."))
        return [InputPartition(f) for f in files] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        with open(partition.value, "rb") as file:
            doc = read_report(os.path.basename(partition.value), file.read().decode("utf-8", "replace"))
        info = doc["snapshot"]["snap_info"]
        yield os.path.basename(partition.value), info.get("begin_snap_id"), info.get("end_snap_id"), json.dumps(doc)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportSource)
