"""Row-wise, grouped, calendar, ordered and sequence features."""

from __future__ import annotations

import inspect
from functools import reduce
from itertools import combinations, combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import settings
from ..functions.aggregates import group_statistics
from ..functions.joins import keyed_join
from ..functions.ordering import add_window_columns, order_columns, row_index, split_by_group_size, POSITION
from ..functions.values import as_list, col, dtype_of, number, numeric_columns, present, timestamp, value
from .base import HELD_OUT, SPLIT, OrderedPart, Operator, apply_ordered, choose
from .encoding import text_of
from .integration import CustomTransform

ROW_METHODS = ("mean", "sum", "std", "min", "max", "median", "product", "diff", "ratio", "inc_ratio",
               "concat", "identity")


class CreateFeature(Operator):
    """One new column from a few source columns of the same row."""

    def __init__(self, source_cols, output_col, method="mean", method_kwargs=None, return_type="double",
                 vectorized=False):
        super().__init__()
        self.source_cols, self.output_col = as_list(source_cols), output_col
        if not self.source_cols:
            raise ValueError("source_cols must not be empty")
        if not callable(method):
            choose("method", method, ROW_METHODS)
        self.method, self.method_kwargs = method, dict(method_kwargs or {})
        self.return_type, self.vectorized = return_type, bool(vectorized)
        self.output_col_types = {output_col: "numeric"}

    def _apply(self, df):
        names = present(df, self.source_cols)
        if not names:
            return df
        made = self._called(df, names) if callable(self.method) else self._built_in(df, names)
        return df.withColumn(self.output_col, made)

    def _called(self, df, names):
        """A frame callable returns a Column, a vectorized one maps pandas columns; any other runs per row."""
        method, extra = self.method, self.method_kwargs
        if self.vectorized:
            def whole(*xs: pd.Series) -> pd.Series:
                return method(*xs, **extra)
            return F.pandas_udf(whole, self.return_type)(*[value(df, n) for n in names])
        try:
            first = next(iter(inspect.signature(method).parameters), "")
        except (TypeError, ValueError):
            first = ""
        if first in ("df", "frame", "data"):
            return method(df, names, **extra)
        if len(names) == 1:
            run = F.udf(lambda x: method(x, **extra), self.return_type, useArrow=True)
        else:
            run = F.udf(lambda *xs: method(dict(zip(names, xs)), **extra), self.return_type, useArrow=True)
        return run(*[value(df, n) for n in names])

    def _built_in(self, df, names):
        m = self.method
        if m == "identity":
            return col(names[0])
        if m == "concat":
            sep = self.method_kwargs.get("sep", "_")
            return F.concat_ws(sep, *[F.coalesce(text_of(df, n), F.lit("nan")) for n in names])
        if m in ("diff", "ratio", "inc_ratio"):
            if len(names) < 2:
                raise ValueError(f"{m} needs two source columns")
            a, b = number(df, names[0]), number(df, names[1])
            if m == "diff":
                return a - b
            return F.try_divide(a, b if m == "ratio" else F.lit(float(self.method_kwargs.get("offset", 1))) + b)
        # Plain arithmetic over the columns stays in generated code.
        xs = [number(df, n) for n in names]
        size = sum([F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in xs], F.lit(0.0))
        total = sum([F.coalesce(x, F.lit(0.0)) for x in xs], F.lit(0.0))
        if m == "sum":
            return total
        if m == "product":
            return reduce(lambda a, x: a * F.coalesce(x, F.lit(1.0)), xs, F.lit(1.0))
        if m in ("min", "max"):
            return xs[0] if len(xs) == 1 else (F.least if m == "min" else F.greatest)(*xs)
        if m == "mean":
            return F.try_divide(total, size)
        if m == "std":
            mean = F.try_divide(total, size)
            squares = sum([F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in xs], F.lit(0.0))
            return F.when(size > 1, F.sqrt(F.try_divide(squares, size - 1)))
        ordered = F.array_sort(F.filter(F.array(*xs), lambda x: x.isNotNull()))
        low = F.try_element_at(ordered, F.floor((size + 1) / 2).cast("int"))
        high = F.try_element_at(ordered, F.ceil((size + 1) / 2).cast("int"))
        return F.when(size > 0, (low + high) / 2)


class CreatePolynomialFeature(Operator):
    """Products of columns up to a degree; missing counts as 0."""

    def __init__(self, cols, degree=2, interaction_only=False):
        super().__init__()
        self.cols, self.degree, self.interaction_only = as_list(cols), int(degree), bool(interaction_only)

    def _apply(self, df):
        names = present(df, self.cols)
        filled = {n: F.coalesce(number(df, n), F.lit(0.0)) for n in names}
        choice = combinations if self.interaction_only else combinations_with_replacement
        new = {}
        for degree in range(2, self.degree + 1):
            for picked in choice(names, degree):
                powers = {n: picked.count(n) for n in picked}
                label = "_".join(n if p == 1 else f"{n}p{p}" for n, p in powers.items())
                product = filled[picked[0]]
                for n in picked[1:]:
                    product = product * filled[n]
                new[f"poly_{label.replace(' ', '_')}"] = product
        return df.withColumns(new) if new else df


class CrossFeature(Operator):
    """Joined text of several columns; missing joins as empty text."""

    def __init__(self, cols, output_col=None, separator=None):
        super().__init__()
        self.cols, self.output_col = as_list(cols), output_col
        self.separator = "_" if separator is None else separator

    def _apply(self, df):
        names = present(df, self.cols)
        if len(names) < 2:
            return df
        return df.withColumn(self.output_col or self.separator.join(names), F.concat_ws(
            self.separator, *[F.coalesce(text_of(df, n), F.lit("")) for n in names]))


class AggregateGroupFeature(Operator):
    """Per-group statistics joined back to every row.

    Aggregated first, so a huge group reaches the join as one row.
    """

    cross_row = True

    def __init__(self, group_cols, agg_cols=None, agg_funcs=None):
        super().__init__()
        self.group_cols, self.agg_cols = as_list(group_cols), agg_cols
        self.agg_funcs = as_list(agg_funcs) or ["mean", "sum", "count", "std"]

    def _apply(self, df):
        keys = present(df, self.group_cols)
        names = numeric_columns(df, exclude=[*keys, SPLIT]) if self.agg_cols is None else [
            n for n in present(df, self.agg_cols) if n not in keys]
        if not keys or not names:
            return df
        wanted = [(n, f, f"{n}_{f}") for n in names for f in self.agg_funcs]
        return keyed_join(df, group_statistics(df, keys, wanted), keys).select(
            *[col(n) for n in df.columns], *[col(n) for _, _, n in wanted])


CALENDAR = {
    "year": lambda t: F.year(t), "month": lambda t: F.month(t), "day": lambda t: F.dayofmonth(t),
    "dayofweek": lambda t: F.weekday(t), "day_of_week": lambda t: F.weekday(t),
    "quarter": lambda t: F.quarter(t),
    "is_weekend": lambda t: F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0)),
    "dayofyear": lambda t: F.dayofyear(t), "hour": lambda t: F.hour(t), "hour_of_day": lambda t: F.hour(t),
    "days_since_epoch": lambda t: F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")),
}


class ExtractDateTimeFeature(Operator):
    """Calendar parts; weekdays count from Monday = 0, numbers are epoch seconds."""

    default_features = ("year", "month", "day", "dayofweek", "quarter", "is_weekend", "dayofyear")

    def __init__(self, cols, features=None, drop_original=False):
        super().__init__()
        self.cols, self.features = as_list(cols), as_list(features) or list(self.default_features)
        self.drop_original = bool(drop_original)

    def _apply(self, df):
        names = present(df, self.cols)
        new = {f"{n}_{f}": make(timestamp(df, n)) for n in names for f, make in CALENDAR.items()
               if f in self.features}
        out = df.withColumns(new) if new else df
        return out.drop(*names) if self.drop_original else out


def _masked(df, group, column):
    """Rows with a missing group key belong to no group."""
    known = F.lit(True)
    for g in group:
        known = known & value(df, g).isNotNull()
    return F.when(known, column) if group else column


def _group_and_order(df, step) -> tuple[list[str], list[str]]:
    order = present(df, [step.time_col, *step.tie_cols])
    if not order:
        raise ValueError("time_col or tie_cols must order the rows")
    return present(df, step.group_cols), order


class CreateLagFeature(Operator):
    """Value of the k-th previous row of the group."""

    cross_row = True

    def __init__(self, target_col, lags, group_cols=None, time_col=None, tie_cols=None):
        super().__init__()
        self.target_col, self.lags = target_col, [int(k) for k in as_list(lags)]
        self.group_cols, self.time_col, self.tie_cols = as_list(group_cols), time_col, as_list(tie_cols)

    def ordered_part(self, df):
        if self.target_col not in df.columns:
            return None
        group, order = _group_and_order(df, self)

        def build(w):
            return {f"{self.target_col}_lag_{k}": _masked(df, group, F.lag(col(self.target_col), k).over(w))
                    for k in self.lags}
        return OrderedPart(tuple(group), tuple(order), build, max(self.lags), frozenset([self.target_col]),
                           frozenset(f"{self.target_col}_lag_{k}" for k in self.lags))

    def _apply(self, df):
        part = self.ordered_part(df)
        return df if part is None else apply_ordered(df, [part])


class CreateRollingFeature(Operator):
    """Statistics of the previous ``window`` rows of the group, the row itself excluded."""

    cross_row = True

    allowed = ("mean", "std", "min", "max", "median", "sum")

    def __init__(self, target_col, windows, aggs=None, group_cols=None, time_col=None, tie_cols=None):
        super().__init__()
        self.target_col, self.windows = target_col, [int(w) for w in as_list(windows)]
        self.aggs = as_list(aggs) or ["mean", "std"]
        for a in self.aggs:
            choose("aggs", a, self.allowed)
        self.group_cols, self.time_col, self.tie_cols = as_list(group_cols), time_col, as_list(tie_cols)

    def ordered_part(self, df):
        if self.target_col not in df.columns:
            return None
        group, order = _group_and_order(df, self)
        v = value(df, self.target_col)
        make = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum,
                "median": lambda c: F.percentile(c, 0.5)}

        def build(w):
            return {f"{self.target_col}_roll_{a}_{n}": _masked(df, group, make[a](v).over(w.rowsBetween(-n, -1)))
                    for n in self.windows for a in self.aggs}
        return OrderedPart(tuple(group), tuple(order), build, max(self.windows), frozenset([self.target_col]),
                           frozenset(f"{self.target_col}_roll_{a}_{n}" for n in self.windows for a in self.aggs))

    def _apply(self, df):
        part = self.ordered_part(df)
        return df if part is None else apply_ordered(df, [part])


class CreateSequence(Operator):
    """The user's last ``max_len`` earlier items, most recent last.

    With a split marker, held-out rows see training history only and never add to it.
    """

    uses_history = True

    def __init__(self, user_col="user_id", item_col="item_id", time_col="timestamp",
                 seq_col="item_id_seq", max_len=50, tie_cols=None, limit=None):
        super().__init__()
        if max_len < 1:
            raise ValueError("max_len must be at least 1")
        self.user_col, self.item_col, self.time_col = user_col, item_col, time_col
        self.seq_col, self.max_len, self.tie_cols = seq_col, int(max_len), as_list(tie_cols)
        self.limit = limit
        self.output_col_types = {seq_col: "categorical_list"}

    def ordered_part(self, df):
        order = present(df, [self.time_col, *self.tie_cols])
        if SPLIT in df.columns or not order:
            return None

        def build(w):
            got = F.collect_list(F.struct(col(self.item_col).alias("v"))).over(w.rowsBetween(-self.max_len, -1))
            return {self.seq_col: F.transform(got, lambda s: s["v"])}
        return OrderedPart((self.user_col,), tuple(order), build, self.max_len, frozenset([self.item_col]),
                           frozenset([self.seq_col]), self.limit)

    def _apply(self, df):
        part = self.ordered_part(df)
        if part is not None:
            return apply_ordered(df, [part])
        held = (col(SPLIT) == HELD_OUT) if SPLIT in df.columns else F.lit(False)
        order = [*order_columns(present(df, [self.time_col])), held.cast("int").asc(),
                 *order_columns(present(df, self.tie_cols))]
        return self._with_split(df, held, order, F.struct(col(self.item_col).alias("v")))

    def _with_split(self, df, held, order, item):
        """Training rows carry their history including themselves; others read the last one seen."""
        train, test = df.where(~F.coalesce(held, F.lit(False))), df.where(held)
        carry = "__carry__"

        def build(w):
            got = F.collect_list(item).over(w.rowsBetween(-self.max_len, 0))
            return {carry: F.transform(got, lambda s: s["v"])}
        train = add_window_columns(train, [self.user_col], order, build, self.max_len, self.limit)
        size = F.size(carry)
        own = train.withColumn(self.seq_col, F.slice(carry, F.lit(1), size - 1)).drop(carry)
        marks = train.withColumn(carry, F.slice(carry, F.greatest(size - self.max_len + 1, F.lit(1)),
                                                F.lit(self.max_len)))
        both = marks.unionByName(test.withColumn(carry, F.lit(None).cast(marks.schema[carry].dataType)))
        seen = last_seen(both, [self.user_col], order, carry, self.seq_col, self.limit)
        empty = F.array().cast(marks.schema[carry].dataType)
        out = seen.where(held).withColumn(self.seq_col, F.coalesce(col(self.seq_col), empty)).drop(carry)
        return own.unionByName(out.select(*[col(n) for n in own.columns]))


def last_seen(df: DataFrame, group: list[str], order: list, source: str, out: str, limit=None) -> DataFrame:
    """Latest non-missing ``source`` at or before each row of the group.

    Oversized groups run in blocks; each block starts from the last value of the
    earlier blocks (one row per block and group).
    """
    limit = settings.MAX_GROUP_ROWS if limit is None else limit
    small, large = split_by_group_size(df, group, limit)
    keys = [col(g) for g in group]
    back = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = small.withColumn(out, F.last(col(source), ignorenulls=True).over(back))
    if large is None:
        return done
    placed = row_index(large, [col(g).asc_nulls_first() for g in group] + order) \
        .withColumn("__block__", F.floor(F.col(POSITION) / limit))
    ends = placed.where(col(source).isNotNull()).groupBy("__block__", *keys).agg(
        F.max_by(col(source), POSITION).alias("__end__"))
    blocks = placed.groupBy("__block__", *keys).agg(F.count("*").alias("__n__")).join(
        ends, ["__block__", *group], "left")
    earlier = Window.partitionBy(*keys).orderBy("__block__").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__block__", *keys, F.last("__end__", ignorenulls=True).over(earlier).alias("__start__"))
    inside = Window.partitionBy("__block__", *keys).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(starts, ["__block__", *group], "left")
    ran = joined.withColumn(out, F.coalesce(F.last(col(source), ignorenulls=True).over(inside), F.col("__start__")))
    return done.unionByName(ran.select(*[col(n) for n in done.columns]))


class TruncateSequence(Operator):
    def __init__(self, cols, max_len=50, keep="last"):
        super().__init__()
        choose("keep", keep, ("first", "last"))
        self.cols, self.max_len, self.keep = as_list(cols), int(max_len), keep

    def _apply(self, df):
        new = {}
        for n in present(df, self.cols):
            if isinstance(dtype_of(df, n), T.ArrayType):
                start = F.lit(1) if self.keep == "first" else F.greatest(
                    F.size(col(n)) - self.max_len + 1, F.lit(1))
                new[n] = F.slice(col(n), start, F.lit(self.max_len))
        return df.withColumns(new) if new else df


class CustomFE(CustomTransform):
    """A callable that maps a DataFrame to a DataFrame."""

    cross_row = True
