"""Exact quantiles and modes that do not gather a column in one place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings
from ..session import materialise
from .ordering import POSITION, join_on_keys, row_index, split_by_group_size
from .sizes import sent_if_small
from .values import col

ACCURACY = 2_000


def exact_quantiles(df: DataFrame, exprs: dict[str, Column], probs: list[float],
                    small: int | None = None, bracket: int | None = None) -> dict[str, list]:
    """Linear-interpolated quantiles of each expression; NULLs are skipped.

    Columns within the small bound use the built-in exact ``percentile``.  Larger
    ones narrow an open interval around each wanted rank with mergeable sketches,
    counting exactly what lies on each side, until few enough values remain.
    """
    small = settings.MAX_PERCENTILE_ROWS if small is None else small
    bracket = settings.MAX_BRACKET_VALUES if bracket is None else bracket
    names = list(exprs)
    if not names:
        return {}
    values = df.select(*[exprs[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    counts = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]).first()
    out: dict[str, list] = {n: [None] * len(probs) for n in names}
    little = [i for i in range(len(names)) if 0 < counts[f"n{i}"] <= small]
    if little:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        row = values.agg(*[F.percentile(f"v{i}", grid).alias(f"q{i}") for i in little]).first()
        for i in little:
            out[names[i]] = list(row[f"q{i}"])
    large = [i for i in range(len(names)) if counts[f"n{i}"] > small]
    if large:
        wanted = {}
        for i in large:
            for p in probs:
                rank = p * (counts[f"n{i}"] - 1)
                wanted.setdefault((i, math.floor(rank)), None)
                wanted.setdefault((i, math.ceil(rank)), None)
        found = {}
        for i in large:
            ranks = [w for w in wanted if w[0] == i]
            if len(ranks) > SORTED_FROM_RANKS:
                found.update(_ranks_by_sort(values, i, [r for _, r in ranks]))
        few = [w for w in wanted if w not in found]
        if few:
            # Each rank may gather its share of the bound, so that all together stay below it.
            found.update(_select_ranks(values, few, max(1, bracket // len(few))))
        for i in large:
            for j, p in enumerate(probs):
                rank = p * (counts[f"n{i}"] - 1)
                low, high = found[(i, math.floor(rank))], found[(i, math.ceil(rank))]
                out[names[i]][j] = low + (high - low) * (rank - math.floor(rank))
    return out


# From so many ranks of one column on, one distributed sort is cheaper than a search for each.
SORTED_FROM_RANKS = 16


def _ranks_by_sort(values: DataFrame, i: int, ranks: list[int]) -> dict:
    """Value at each rank of one column, read off a distributed sort of the column alone.

    A row number breaks ties, so that equal values need not meet in one task.
    """
    name = f"v{i}"
    alone = values.where(F.col(name).isNotNull()).select(name, F.monotonically_increasing_id().alias("tie"))
    placed = row_index(alone, [name, "tie"])
    # As many rows as ranks were asked for.
    rows = placed.where(F.col(POSITION).isin(sorted(set(ranks)))).select(POSITION, name).collect()
    return {(i, r[0]): r[1] for r in rows}


def _select_ranks(values: DataFrame, wanted: list[tuple[int, int]], bracket: int) -> dict:
    """Value at each (column, rank).  One aggregation over the table per round."""
    state = {w: {"low": None, "high": None, "below": 0} for w in wanted}
    found: dict = {}

    def inside(w):
        c, s = F.col(f"v{w[0]}"), state[w]
        keep = c.isNotNull()
        if s["low"] is not None:
            keep = keep & (c > F.lit(s["low"]))
        if s["high"] is not None:
            keep = keep & (c < F.lit(s["high"]))
        return F.when(keep, c)

    while len(found) < len(wanted):
        todo = [w for w in wanted if w not in found]
        sizes = values.agg(*[F.count(inside(w)).alias(f"m{k}") for k, w in enumerate(todo)]).first()
        few = [(k, w) for k, w in enumerate(todo) if sizes[f"m{k}"] <= bracket]
        if few:
            row = values.agg(*[F.sort_array(F.collect_list(inside(w))).alias(f"s{k}") for k, w in few]).first()
            for k, w in few:
                found[w] = row[f"s{k}"][w[1] - state[w]["below"]]
        many = [(k, w) for k, w in enumerate(todo) if w not in found]
        if not many:
            break
        cuts = []
        for k, w in many:
            q = (w[1] - state[w]["below"]) / max(sizes[f"m{k}"] - 1, 1)
            grid = [min(max(q + d, 0.0), 1.0) for d in (-3 / ACCURACY, 3 / ACCURACY)]
            cuts.append(F.percentile_approx(inside(w), grid, ACCURACY).alias(f"c{k}"))
        bounds = values.agg(*cuts).first()
        checks = []
        for k, w in many:
            low, high = bounds[f"c{k}"]
            c = inside(w)
            checks += [F.count(F.when(c < low, c)).alias(f"lt{k}"), F.count(F.when(c == low, c)).alias(f"le{k}"),
                       F.count(F.when(c < high, c)).alias(f"ht{k}"), F.count(F.when(c == high, c)).alias(f"he{k}")]
        row = values.agg(*checks).first()
        for k, w in many:
            low, high = bounds[f"c{k}"]
            s, rank = state[w], w[1] - state[w]["below"]
            if rank < row[f"lt{k}"]:
                s["high"] = low
            elif rank < row[f"lt{k}"] + row[f"le{k}"]:
                found[w] = low
            elif rank < row[f"ht{k}"]:
                s["below"] += row[f"lt{k}"] + row[f"le{k}"]
                s["low"], s["high"] = low, high
            elif rank < row[f"ht{k}"] + row[f"he{k}"]:
                found[w] = high
            else:
                s["below"] += row[f"ht{k}"] + row[f"he{k}"]
                s["low"] = high
    return found


def grouped_quantile(df: DataFrame, keys: list[str], exprs: dict[str, Column], prob: float,
                     limit: int | None = None) -> DataFrame:
    """Per-group exact quantile of each expression, one row per group.

    Bounded groups use ``percentile``; an oversized group is ordered by a
    distributed sort and read at its two middle positions.
    """
    limit = settings.MAX_PERCENTILE_ROWS if limit is None else limit
    base = df.select(*[col(k) for k in keys], *[c.cast("double").alias(n) for n, c in exprs.items()])
    small, large = split_by_group_size(base, keys, limit)
    out = small.groupBy(*[col(k) for k in keys]).agg(*[F.percentile(col(n), prob).alias(n) for n in exprs])
    if large is None:
        return out
    full = large.select(*[col(k) for k in keys]).distinct()
    for n in exprs:
        placed = row_index(large.where(col(n).isNotNull()).select(*[col(k) for k in keys], col(n)),
                           [col(k).asc_nulls_first() for k in keys] + [col(n)])
        span = placed.groupBy(*[col(k) for k in keys]).agg(
            F.min(POSITION).alias("__first__"), F.count("*").alias("__n__"))
        span = materialise(span.withColumn("__rank__", (F.col("__n__") - 1) * F.lit(float(prob))))
        middle = (F.col(POSITION) == F.col("__first__") + F.floor("__rank__")) | \
            (F.col(POSITION) == F.col("__first__") + F.ceil("__rank__"))
        # One row per oversized group.
        picked = join_on_keys(placed, sent_if_small(span), keys).where(middle)
        weight = F.first(F.col("__rank__") - F.floor("__rank__"))
        one = picked.groupBy(*[col(k) for k in keys]).agg(
            (F.min(col(n)) + (F.max(col(n)) - F.min(col(n))) * weight).alias(n))
        full = join_on_keys(full, one, keys, "left")
    return out.unionByName(full)


def modes(df: DataFrame, exprs: dict[str, Column]) -> dict[str, object]:
    """Most frequent value of each expression, the smallest on a tie; None when all missing.

    Values are counted before they move, so one value holding most rows stays cheap.
    """
    names = list(exprs)
    if not names:
        return {}
    types = {n: df.select(exprs[n].alias("v")).schema["v"].dataType.simpleString() for n in names}
    out: dict[str, object] = {n: None for n in names}
    for kind in sorted(set(types.values())):
        same = [n for n in names if types[n] == kind]
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("name"), exprs[n].alias("v")) for n in same])).alias("e")) \
            .select("e.name", "e.v").where(F.col("v").isNotNull())
        counted = pairs.groupBy("name", "v").agg(F.count("*").alias("n"))
        best = counted.groupBy("name").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
        for r in best.collect():
            out[r["name"]] = r["v"]
    return out
