"""Joins of a large table with a per-key table, safe when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .. import settings
from ..session import materialise
from .ordering import POSITION, join_on_keys, row_index
from .sizes import is_small, measured_bytes, sent_if_small  # noqa: F401  (measured_bytes is used by importers of this module)
from .values import col


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame | None:
    """Keys with more rows than one task should take, or None.

    Counted with map-side combine; at most rows/limit keys can exceed the limit.
    """
    limit = settings.MAX_GROUP_ROWS if limit is None else limit
    found = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("__rows__")) \
        .where(F.col("__rows__") > limit).drop("__rows__")
    return None if found.isEmpty() else materialise(found)


def split_join(df: DataFrame, other: DataFrame, keys: list[str], how: str, hot: DataFrame | None) -> DataFrame:
    """Rows of hot keys stay where they are and meet a slice of ``other`` measured small; the rest is shuffled.

    A larger slice (many hot keys or wide rows) meets them dealt out over salts.
    """
    if hot is None:
        return join_on_keys(df, other, keys, how)
    few = sent_if_small(hot)
    cold = join_on_keys(join_on_keys(df, few, keys, "left_anti"), join_on_keys(other, few, keys, "left_anti"), keys, how)
    rows, slice_ = join_on_keys(df, few, keys, "left_semi"), join_on_keys(other, few, keys, "left_semi")
    warm = join_on_keys(rows, F.broadcast(slice_), keys, how) if is_small(slice_) else salted_join(rows, slice_, keys, how)
    return cold.unionByName(warm.select(*[col(c) for c in cold.columns]))


def keyed_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left",
               limit: int | None = None, stored: bool = False, largest: int | None = None) -> DataFrame:
    """Join with a table of one row per key (how: left, inner, left_semi, left_anti).

    A measured small table is broadcast.  A larger one is shuffled, after the rows of
    hot keys have been split off.  Missing keys match missing keys.  ``largest``, if known, is at least the number
    of rows of any key; within the limit the rows are not counted again.
    """
    other = other if stored else materialise(other)
    if is_small(other):
        return join_on_keys(df, F.broadcast(other), keys, how)
    bounded = largest is not None and largest <= (settings.MAX_GROUP_ROWS if limit is None else limit)
    return split_join(df, other, keys, how, None if bounded else hot_keys(df, keys, limit))


def salted_join(df: DataFrame, other: DataFrame, keys: list[str], how: str, limit: int | None = None) -> DataFrame:
    """Join where a key may be large on both sides.

    Rows of ``df`` are numbered by a distributed sort and dealt out over as many
    salts as keep a key's share bounded; ``other`` is repeated once per salt.
    """
    limit = settings.MAX_GROUP_ROWS if limit is None else limit
    orderable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    placed = row_index(df, [F.xxhash64(*[col(n) for n in orderable]), *orderable])
    salts = max(1, math.ceil(placed.count() / limit))
    left = placed.withColumn("__salt__", (F.col(POSITION) % salts).cast("int")).drop(POSITION)
    right = other.withColumn("__salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_on_keys(left, right, [*keys, "__salt__"], how).drop("__salt__")


def wide_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left",
              limit: int | None = None) -> DataFrame:
    """Left, inner, right or outer join with a table that may repeat keys; missing matches missing.

    A measured small table is broadcast.  Otherwise keys that are large on the left
    or on the right are split off: the other side's slice is broadcast if measured
    small, and salted if not.  A right join is the left join from the other side; an outer
    join is a left join and the rows of ``other`` that it does not meet.
    """
    if how == "right":
        out = wide_join(other, df, keys, "left", limit)
        return out.select(*[col(c) for c in df.columns], *[col(c) for c in other.columns if c not in keys])
    if how == "outer":
        alone = keyed_join(other, df.select(*[col(k) for k in keys]).distinct(), keys, "left_anti", limit)
        return wide_join(df, other, keys, "left", limit).unionByName(alone, allowMissingColumns=True)
    if is_small(other):
        return join_on_keys(df, F.broadcast(other), keys, how)
    parts = []
    for side in ("left", "right"):
        hot = hot_keys(df if side == "left" else other, keys, limit)
        if hot is None:
            continue
        few = sent_if_small(hot)
        left, right = join_on_keys(df, few, keys, "left_semi"), join_on_keys(other, few, keys, "left_semi")
        df, other = join_on_keys(df, few, keys, "left_anti"), join_on_keys(other, few, keys, "left_anti")
        if side == "left":
            parts.append(join_on_keys(left, F.broadcast(right), keys, how) if is_small(right)
                         else salted_join(left, right, keys, how, limit))
        else:
            # The right side has rows for each of these keys, so every left row matches.
            parts.append(join_on_keys(F.broadcast(left), right, keys, "inner") if is_small(left)
                         else salted_join(right, left, keys, "inner", limit))
    out = join_on_keys(df, other, keys, how)
    for part in parts:
        out = out.unionByName(part.select(*[col(c) for c in out.columns]))
    return out
