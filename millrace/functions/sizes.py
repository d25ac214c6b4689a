"""Measured sizes of tables, before they are sent anywhere."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from .. import settings
from .values import col


def measured_bytes(table: DataFrame) -> int | None:
    """Size of a table's values from one aggregation; None for nested columns."""
    text, fixed = [], 0
    for f in table.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            text.append(F.coalesce(F.sum(F.octet_length(col(f.name))), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return None
        fixed += 16
    row = table.agg(F.count("*").alias("n"), sum(text, F.lit(0)).cast("bigint").alias("b")).first()
    return row["n"] * fixed + row["b"]


def is_small(table: DataFrame) -> bool:
    size = measured_bytes(table)
    return size is not None and size <= settings.BROADCAST_BYTES


def sent_if_small(table: DataFrame) -> DataFrame:
    """The table marked for broadcast if it was measured small, else as it is."""
    return F.broadcast(table) if is_small(table) else table


def bounded_parts(table: DataFrame) -> DataFrame:
    """The rows dealt out so that a task of an iterative fit holds a bounded number, the same ones in every run."""
    rows = table.count()
    if rows <= settings.FIT_TASK_ROWS:
        return table
    return table.repartition(math.ceil(rows / settings.FIT_TASK_ROWS)).sortWithinPartitions(*[col(n) for n in table.columns])
