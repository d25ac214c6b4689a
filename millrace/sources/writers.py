"""File writers.  Every task writes its own files; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.values import col, number
from ..operators.base import SPLIT


def split_tables(df: DataFrame, path: str) -> None:
    """Parquet partitioned by the split marker."""
    df.write.mode("overwrite").partitionBy(SPLIT).parquet(path)


def split_summary(train: DataFrame, held: DataFrame, target: str | None = None, **facts) -> DataFrame:
    """One row: row counts, positive shares and the given facts about a split."""
    def part(df, name):
        share = F.avg(number(df, target)) if target in df.columns else F.lit(None).cast("double")
        return df.agg(F.count("*").alias(f"{name}_rows"), share.alias(f"positive_ratio_{name}"))
    other = part(held, "std_test")
    numbers = other.first().asDict()
    return part(train, "train").select(
        "train_rows", "positive_ratio_train",
        *[F.lit(numbers[f.name]).cast(f.dataType).alias(f.name) for f in other.schema.fields],
        *[F.lit(v).alias(k) for k, v in sorted(facts.items())])


def summary_json(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)


def result_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
