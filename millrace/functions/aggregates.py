"""Named aggregates over groups, planned to survive one very large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordering import join_on_keys
from .quantiles import grouped_quantile
from .values import col, is_float, is_number, value

# Aggregate names with a built-in, partially combined Spark counterpart.
BUILT_IN = {
    "mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct,
}


def group_statistics(df: DataFrame, keys: list[str], wanted: list[tuple[str, str, str]]) -> DataFrame:
    """One row per non-missing key.  ``wanted`` holds (column, function, output name).

    Sum of an all-missing group is 0.
    Medians of very large groups go through a distributed sort.
    """
    known = df
    for k in keys:
        known = known.where(value(df, k).isNotNull())
    unknown = sorted({f for _, f, _ in wanted} - set(BUILT_IN) - {"median", "size"})
    if unknown:
        raise ValueError(f"unknown aggregate {unknown}")
    plain = [w for w in wanted if w[1] != "median"]
    medians = [w for w in wanted if w[1] == "median"]
    stats = known.groupBy(*[col(k) for k in keys]).agg(
        *([_aggregate(df, n, f).alias(out) for n, f, out in plain] or [F.count("*").alias("__n__")]))
    if not plain:
        stats = stats.drop("__n__")
    if medians:
        middle = grouped_quantile(known, keys, {out: value(df, n) for n, _, out in medians}, 0.5)
        stats = join_on_keys(stats, middle, keys, "left").select(
            *[col(k) for k in keys], *[col(out) for _, _, out in wanted])
    return stats


def _aggregate(df: DataFrame, name: str, func: str) -> Column:
    if func == "size":
        return F.count("*")
    v = value(df, name)
    if func == "sum" and is_number(df.schema[name].dataType):
        zero = F.lit(0.0) if is_float(df.schema[name].dataType) else F.lit(0).cast("bigint")
        return F.coalesce(F.sum(v), zero)
    return BUILT_IN[func](v)

