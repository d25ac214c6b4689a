"""Cutting a table at one position of a total order, without sorting it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .ordering import POSITION, order_columns, row_index
from .values import col

# Rows drawn as splitters in each round, and rows of a range that are few enough to be put in order.
SPLITTERS, FEW = 16, 50_000


def _parts(order: list) -> list[tuple[str, bool]]:
    """(name, descending) of every order entry: a name, or (name, "desc").  Missing values come last either way."""
    return [(o, False) if isinstance(o, str) else (o[0], o[1] == "desc") for o in order]


def _sort_keys(order: list) -> list[Column]:
    return [col(n).desc_nulls_last() if down else col(n).asc_nulls_last() for n, down in _parts(order)]


def _position(parts: list[tuple[str, bool]], values: list[Column]) -> Column | None:
    """One comparable value whose order (reversed if descending) is that of the columns; None for mixed directions."""
    downs = {down for _, down in parts}
    if len(downs) > 1:
        return None
    present = downs == {True}
    return F.struct(*[x for v in values for x in (v.isNotNull() if present else v.isNull(), v)])


def _literals(df: DataFrame, order: list, row) -> list[Column]:
    return [F.lit(v).cast(df.schema[n].dataType) for v, (n, _) in zip(row, _parts(order), strict=True)]


def before(df: DataFrame, order: list, row) -> Column:
    """True for rows of ``df`` that come before the values ``row`` under ``order``."""
    parts, values = _parts(order), _literals(df, order, row)
    own = [col(n) for n, _ in parts]
    place = _position(parts, own)
    if place is not None:
        at = _position(parts, values)
        return place > at if parts[0][1] else place < at
    out, equal = F.lit(False), F.lit(True)
    for c, (_, down), v, missing in zip(own, parts, values, [v is None for v in row], strict=True):
        earlier = c.isNotNull() if missing else F.coalesce(c > v if down else c < v, F.lit(False))
        out, equal = out | (equal & earlier), equal & c.eqNullSafe(v)
    return out


def equal_to(df: DataFrame, order: list, row) -> Column:
    return reduce(lambda a, b: a & b, [
        col(n).eqNullSafe(v) for (n, _), v in zip(_parts(order), _literals(df, order, row), strict=True)])


def at_rank(df: DataFrame, order: list, rank: int):
    """(row, earlier, equal): the order values at a 0-based position, and how many rows come before and equal them.

    Rounds draw a few rows of the remaining range as splitters (smallest hashes), count what lies before and on each of
    them, and keep the range between two, until it holds at most FEW rows.  Every round scans the order's columns only and
    moves no rows.
    """
    keys = df.select(*[col(n) for n, _ in _parts(order)])
    inside, skipped, left = keys, 0, keys.count()
    while True:
        if rank >= skipped + left:
            return None
        if left <= FEW:
            row = tuple(inside.orderBy(*_sort_keys(order)).offset(rank - skipped).limit(1).first())
            n = inside.agg(F.count_if(before(keys, order, row)).alias("b"), F.count_if(equal_to(keys, order, row)).alias("e")).first()
            return row, skipped + n["b"], n["e"]
        drawn = inside.orderBy(F.xxhash64(*[col(c) for c in keys.columns])).limit(SPLITTERS)
        rows = list(dict.fromkeys(tuple(r) for r in drawn.orderBy(*_sort_keys(order)).collect()))
        counts = inside.agg(*[F.count_if(before(keys, order, r)).alias(f"b{i}") for i, r in enumerate(rows)],
                            *[F.count_if(equal_to(keys, order, r)).alias(f"e{i}") for i, r in enumerate(rows)]).first()
        low, high = None, None
        for i, row in enumerate(rows):
            if skipped + counts[f"b{i}"] > rank:
                high = i
                break
            if rank < skipped + counts[f"b{i}"] + counts[f"e{i}"]:
                return row, skipped + counts[f"b{i}"], counts[f"e{i}"]
            low = i
        if high is not None:
            inside = inside.where(before(keys, order, rows[high]))
        end = skipped + left if high is None else skipped + counts[f"b{high}"]
        if low is not None:
            inside = inside.where(~before(keys, order, rows[low]) & ~equal_to(keys, order, rows[low]))
            skipped += counts[f"b{low}"] + counts[f"e{low}"]
        left = end - skipped


def cut_at(df: DataFrame, order: list, position: int) -> tuple[DataFrame, DataFrame]:
    """(rows before a position of the order, the others): two filters of ``df``.

    Rows that tie at the position are settled by their other columns, through a distributed sort of those rows alone.
    Entries of ``order`` are names, (name, "desc"), or Columns; with Columns the whole table is sorted.
    """
    if position <= 0:
        return df.where(F.lit(False)), df
    if any(isinstance(o, Column) for o in order):
        placed = row_index(df, order)
        return placed.where(F.col(POSITION) < position).drop(POSITION), placed.where(F.col(POSITION) >= position).drop(POSITION)
    found = at_rank(df, order, position)
    if found is None:
        return df, df.where(F.lit(False))
    row, earlier, equal = found
    first = before(df, order, row)
    if earlier == position:
        return df.where(first), df.where(~first)
    tie = equal_to(df, order, row)
    others = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    placed = row_index(df.where(tie), order_columns(others))
    taken = F.col(POSITION) < position - earlier
    return (df.where(first).unionByName(placed.where(taken).drop(POSITION)),
            df.where(~first & ~tie).unionByName(placed.where(~taken).drop(POSITION)))
