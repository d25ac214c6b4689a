"""Global row numbers and ordered windows that hold up under skew.

A plain ``Window.partitionBy(key)`` sorts each key in one task, and a window with
no key sorts the table in one task.  Both are fine for bounded groups only.  The
helpers here check the largest group and send oversized ones through a range
partitioned sort, cut into equal blocks that overlap by the rows a frame needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .. import settings
from ..session import materialise
from .sizes import sent_if_small
from .values import col, scalar_array

POSITION = "__position__"


def order_columns(names: list, nulls_last: bool = True) -> list[Column]:
    """Ascending sort keys, missing values last; Columns pass through unchanged."""
    return [n if isinstance(n, Column) else (col(n).asc_nulls_last() if nulls_last else col(n).asc())
            for n in names]


def row_index(df: DataFrame, order: list, name: str = POSITION) -> DataFrame:
    """Add the 0-based global position of each row under ``order``.

    A range partitioned sort, a durable copy (so positions survive task retries)
    and per-partition offsets: no task sees more than its own range.
    """
    marked = "__partition_row__"
    ordered = df.orderBy(*order_columns(order)).withColumn(marked, F.monotonically_increasing_id())
    table = materialise(ordered)
    part = F.shiftright(col(marked), 33).cast("int")
    # One row per sort partition, whatever the table size.
    counts = {r["p"]: r["n"] for r in table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    if not offsets:
        return table.withColumn(name, F.lit(0).cast("long")).drop(marked)
    local = col(marked).bitwiseAND(F.lit((1 << 33) - 1))
    return table.withColumn(name, F.element_at(scalar_array(offsets, "bigint"), part + 1) + local).drop(marked)


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, missing equal to missing; the keys are taken from the left.

    The right keys are renamed first, so tables that share an origin can be joined.
    """
    other = {k: f"__right_{i}__" for i, k in enumerate(keys)}
    side = right.select(*[col(n).alias(other[n]) if n in other else col(n) for n in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & col(k).eqNullSafe(F.col(other[k]))
    joined = left.join(side, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*other.values())


def split_by_group_size(df: DataFrame, keys: list[str], limit: int | None = None):
    """(rows of bounded groups, rows of oversized groups or None).

    Counts are combined before the shuffle.  At most rows/limit keys are oversized,
    measured before they are sent; then their rows are split off without a shuffle.
    """
    limit = settings.MAX_GROUP_ROWS if limit is None else limit
    large = df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("__rows__")) \
        .where(F.col("__rows__") > limit).drop("__rows__")
    if large.isEmpty():
        return df, None
    large = materialise(large)
    few = sent_if_small(large)
    return join_on_keys(df, few, keys, "left_anti"), join_on_keys(df, few, keys, "left_semi")


def add_window_columns(df: DataFrame, group: list[str], order: list,
                       build: Callable[[WindowSpec], dict[str, Column]], halo: int,
                       limit: int | None = None) -> DataFrame:
    """Columns of an ordered window whose frames reach at most ``halo`` rows back.

    ``build`` receives the ordered window and returns the new columns.
    """
    limit = settings.MAX_GROUP_ROWS if limit is None else limit
    keys = order_columns(order)
    if not group:
        return _blocked(df, group, order, build, halo, limit)
    small, large = split_by_group_size(df, group, limit)
    window = Window.partitionBy(*[col(g) for g in group]).orderBy(*keys)
    out = small.withColumns(build(window))
    if large is None:
        return out
    return out.unionByName(_blocked(large, group, order, build, halo, limit))


def _blocked(df, group, order, build, halo, limit):
    size = max(int(limit), int(halo), 1)
    placed = row_index(df, [col(g).asc_nulls_first() for g in group] + order_columns(order))
    # Only the last ``halo`` rows of a block are copied, once, into the next block.
    tail = F.col(POSITION) % size >= size - halo
    copies = placed.withColumn("__copy__", F.explode(
        F.when(tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    block = (F.floor(F.col(POSITION) / size) + F.col("__copy__")).alias("__block__")
    copies = copies.withColumn("__block__", block)
    window = Window.partitionBy(F.col("__block__"), *[col(g) for g in group]).orderBy(F.col(POSITION))
    return copies.withColumns(build(window)).where(F.col("__copy__") == 0) \
        .drop("__copy__", "__block__", POSITION)


def running_total(df: DataFrame, order: list, amounts: dict[str, Column],
                  prefix: str = "", block_rows: int | None = None) -> DataFrame:
    """Inclusive running sums over the whole table under ``order``.

    Blocks of equal length are summed first; a window runs over the block totals
    (one row per block) and within each block, never over the whole table.
    """
    size = settings.MAX_GROUP_ROWS if block_rows is None else block_rows
    placed = row_index(df.withColumns({f"__in_{n}__": c for n, c in amounts.items()}), order)
    placed = placed.withColumn("__block__", F.floor(F.col(POSITION) / size))
    totals = placed.groupBy("__block__").agg(*[F.sum(f"__in_{n}__").alias(f"__t_{n}__") for n in amounts])
    # One row per block: rows / block size.
    earlier = Window.orderBy("__block__").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__block__", *[
        F.coalesce(F.sum(f"__t_{n}__").over(earlier), F.lit(0)).alias(f"__s_{n}__") for n in amounts])
    inside = Window.partitionBy("__block__").orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(starts, "__block__")
    out = joined.withColumns({
        f"{prefix}{n}": F.sum(f"__in_{n}__").over(inside) + F.col(f"__s_{n}__") for n in amounts})
    return out.drop("__block__", POSITION, *[f"__in_{n}__" for n in amounts], *[f"__s_{n}__" for n in amounts])


def first_rows(df: DataFrame, n: int, order: list) -> DataFrame:
    """The ``n`` first rows under ``order``: a distributed top-n, not a global sort."""
    return df.orderBy(*order_columns(order)).limit(int(n))


def value_at(df: DataFrame, order: list, position: int, columns: list[str]):
    """The row at one 0-based position of the total order, or None."""
    row = row_index(df.select(*[col(c) for c in columns]), order) \
        .where(F.col(POSITION) == int(position)).drop(POSITION).take(1)
    return row[0] if row else None


def group_running_sum(df: DataFrame, group: list[str], order: list, amount: Column, name: str,
                      limit: int | None = None) -> DataFrame:
    """Inclusive running sum inside each group; oversized groups run in blocks."""
    small, large = split_by_group_size(df, group, limit)
    window = Window.partitionBy(*[col(g) for g in group]).orderBy(*order_columns(order)) \
        .rowsBetween(Window.unboundedPreceding, 0)
    out = small.withColumn(name, F.sum(amount).over(window))
    if large is None:
        return out
    total, own = "__total__", "__amount__"
    marked = large.withColumn(own, amount)
    run = running_total(marked, [col(g).asc_nulls_first() for g in group] + order_columns(order),
                        {total: col(own)}, block_rows=limit)
    run = materialise(run.withColumn("__rank_before__", col(total) - col(own)))
    # One row per oversized group.
    base = materialise(run.groupBy(*[col(g) for g in group]).agg(F.min("__rank_before__").alias("__base__")))
    joined = join_on_keys(run, sent_if_small(base), group).select(
        *[col(n) for n in df.columns], (col(total) - col("__base__")).alias(name))
    return out.unionByName(joined)
