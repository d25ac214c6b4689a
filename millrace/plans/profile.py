"""Table summaries, each from one aggregation over the table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.ordering import first_rows
from ..functions.values import col, is_number, number, value


def _null_ratio(df: DataFrame):
    gaps = [F.avg(value(df, n).isNull().cast("double")) for n in df.columns]
    return sum(gaps[1:], gaps[0]) / F.lit(float(len(gaps)))


def table_summary(df: DataFrame) -> DataFrame:
    """One row: row count, column count, columns per kind, mean share of missing values."""
    numeric = sum(is_number(f.dataType) for f in df.schema.fields)
    text = sum(isinstance(f.dataType, T.StringType) for f in df.schema.fields)
    return df.agg(F.count("*").alias("n_rows"), _null_ratio(df).alias("null_ratio")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(numeric).cast("bigint").alias("n_numeric"), F.lit(text).cast("bigint").alias("n_text"),
        F.lit(len(df.columns) - numeric - text).cast("bigint").alias("n_other"), "null_ratio")


def target_distribution(df: DataFrame, target: str, with_missing: bool = False) -> DataFrame:
    out = df.groupBy(value(df, target).cast("string").alias("value")).agg(F.count("*").alias("n_rows"))
    return out if with_missing else out.where("value is not null")


# Names of the dataset statistics, in order (fixed values).
STATISTICS = ("is_tabular", "is_rec", "log_numeric", "log_categorical", "log_list", "log_text", "log10_rows",
              "log10_columns", "null_ratio", "has_user", "has_item", "has_aux", "target_mean", "target_std",
              "positive_share", "has_target", "has_time", "has_id")


def dataset_statistics(df: DataFrame, target: str | None = None, kind: str = "tabular", text_cols=(),
                       n_aux: int = 0, has_user=False, has_item=False, time_col=None, id_col=None) -> DataFrame:
    """One row of size, missing-value and target statistics."""
    fields = [f for f in df.schema.fields]
    numeric = sum(is_number(f.dataType) for f in fields)
    lists = sum(isinstance(f.dataType, T.ArrayType) for f in fields)
    labels = sum(isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in text_cols for f in fields)
    usable = target in df.columns and (is_number(df.schema[target].dataType)
                                       or isinstance(df.schema[target].dataType, T.BooleanType))
    y = number(df, target) if usable else F.lit(None).cast("double")
    row = df.agg(F.count("*").alias("n"), _null_ratio(df).alias("null_ratio"), F.avg(y).alias("m"),
                 F.stddev_samp(y).alias("s"),
                 F.avg(F.coalesce((y > 0).cast("double"), F.lit(0.0))).alias("p"))
    zero, one = F.lit(0.0), F.lit(1.0)

    def flag(x):
        return one if x else zero
    values = [flag(kind == "tabular"), flag(kind != "tabular"), F.lit(math.log1p(numeric)),
              F.lit(math.log1p(labels)), F.lit(math.log1p(lists)), F.lit(math.log1p(len(text_cols))),
              F.log10(F.greatest(F.col("n"), F.lit(1)).cast("double")), F.lit(math.log10(max(len(fields), 1))),
              F.coalesce("null_ratio", zero), flag(has_user), flag(has_item), flag(n_aux),
              F.coalesce("m", zero), F.coalesce("s", zero), F.coalesce("p", zero) if usable else zero,
              flag(target), flag(time_col), flag(id_col)]
    return row.select(*[v.alias(n) for n, v in zip(STATISTICS, values)])


def observation(df: DataFrame, order: list, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(schema with missing share per column, first ``n`` rows under the order)."""
    gaps = df.agg(F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                                     F.avg(value(df, f.name).isNull().cast("double")).alias("null_ratio"))
                            for f in df.schema.fields]).alias("c"))
    return gaps.select(F.explode("c").alias("c")).select("c.*"), first_rows(df, n, order)
