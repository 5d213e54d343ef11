"""Results as files and texts: nested documents with rounded numbers, compact text, size budgets."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def rounded(value: Any, digits: int = 3) -> Any:
    """All decimal numbers of a nested value rounded, -0 as 0; whole numbers and texts as they are."""
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [rounded(v, digits) for v in value]
    if isinstance(value, float) and math.isfinite(value):
        return round(value, digits) + 0.0
    return value


def rounded_column(value: Column, kind: DataType, digits: int = 3) -> Column:
    """The same of a column of any nested type."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(rounded_column(value[f.name], f.dataType, digits).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: rounded_column(x, kind.elementType, digits))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: rounded_column(v, kind.valueType, digits))
    return F.round(value, digits) + F.lit(0.0) if isinstance(kind, DoubleType | FloatType) else value


def as_json(df: DataFrame, digits: int = 3) -> DataFrame:
    """One JSON text per row, numbers rounded."""
    return df.select(F.to_json(F.struct(*(rounded_column(F.col(f.name), f.dataType, digits).alias(f.name) for f in df.schema.fields))).alias("json"))


def compact(value: Any, name: str = "", depth: int = 0) -> str:
    """A nested value as indented text in which lists of equal records are tables: names once, then a line per record."""
    pad = "  " * depth
    label = f"{pad}{name}" if name else pad.rstrip()
    if isinstance(value, dict):
        head = [f"{label}:"] if name else []
        return "\n".join([*head, *(compact(v, k, depth + bool(name)) for k, v in value.items())])
    if isinstance(value, list):
        flat = lambda v: not isinstance(v, dict | list)
        if value and all(isinstance(v, dict) and list(v) == list(value[0]) and all(map(flat, v.values())) for v in value):
            return "\n".join([f"{label}[{len(value)}]{{{','.join(value[0])}}}:", *(f"{pad}  " + ",".join(scalar(x) for x in v.values()) for v in value)])
        if all(map(flat, value)):
            return f"{label}[{len(value)}]: " + ",".join(map(scalar, value))
        return "\n".join([f"{label}[{len(value)}]:", *(f"{pad}  -\n" + compact(v, "", depth + 2) for v in value)])
    return f"{label}: {scalar(value)}"


def scalar(value: Any) -> str:
    if value is None or isinstance(value, bool | int | float):
        return json.dumps(value)
    text = str(value)
    return json.dumps(text) if not text or re.search(r'[,:"\n\[\]{}]|^\s|\s$|^-?[\d.]+$|^(true|false|null)$', text) else text


def fitting(items: Sequence[str], budget: int, fixed: int = 0) -> int:
    """How many first items fit into a token budget beside what is fixed; none for budgets under 256."""
    if budget < 256:
        return 0
    used = fixed
    for k, item in enumerate(items):
        used += -(-len(item) // 4)
        if used > budget:
            return k
    return len(items)


def shortened(results: Sequence[str], budget: int, keep: int = 2048) -> list[str]:
    """Results cut to ``keep`` characters, longest first, until all fit into a token budget or none is longer."""
    out = list(results)
    while sum(-(-len(r) // 4) for r in out) > budget:
        k = max(range(len(out)), key=lambda i: len(out[i]))
        if len(out[k]) <= keep:
            break
        out[k] = out[k][:keep]
    return out


def write_long_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Long tables as parquet, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
