"""Joining, stacking, renaming, casting, parsing, sorting and splitting tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.aggregates import group_statistics
from ..functions.joins import keyed_join, wide_join
from ..functions.ordering import POSITION, order_columns, row_index
from ..functions.values import (as_list, col, dtype_of, is_number, number, numeric_columns, present,
                                timestamp, value)
from .base import Operator, choose

# Names accepted for a target type, and the Spark type each stands for (fixed values).
TYPE_NAMES = {
    "int": "bigint", "int8": "int", "int16": "int", "int32": "int", "int64": "bigint",
    "Int8": "int", "Int16": "int", "Int32": "int", "Int64": "bigint",
    "float": "double", "float32": "float", "float64": "double",
    "str": "string", "string": "string", "object": "string", "category": "string",
    "bool": "boolean", "boolean": "boolean",
    "datetime": "timestamp_ntz", "datetime64[ns]": "timestamp_ntz",
}

# Texts read as true and as false (fixed values).
TRUE_TEXTS = ["true", "1", "yes", "t", "y", "1.0"]
FALSE_TEXTS = ["false", "0", "no", "f", "n", "0.0"]


def cast_to(df: DataFrame, name: str, type_name: str) -> Column:
    """Cast where a value that does not fit becomes NULL."""
    target = TYPE_NAMES.get(type_name, type_name)
    if target == "timestamp_ntz":
        return timestamp(df, name)
    if target in ("int", "bigint"):
        # Text such as '1.0' is a whole number: go through double, keep whole values only.
        if is_number(dtype_of(df, name)) and not isinstance(
                dtype_of(df, name), (T.DoubleType, T.FloatType)):
            return col(name).try_cast(target)
        n = number(df, name)
        return F.when(n == F.floor(n), n).try_cast(target)
    if target in ("double", "float"):
        return number(df, name).cast(target)
    if target == "boolean":
        if isinstance(dtype_of(df, name), T.BooleanType):
            return col(name)
        text = F.lower(F.trim(value(df, name).cast("string")))
        return F.when(text.isin(TRUE_TEXTS), True).when(text.isin(FALSE_TEXTS), False)
    return value(df, name).try_cast(target)


class JoinTable(Operator):
    """Attach other tables: by key, by per-key statistics, or user and item tables."""

    @classmethod
    def side_tables(cls, params):
        if params.get("method") == "rec":
            return [("user_df", params.get("user_col", "user_id")), ("item_df", params.get("item_col", "item_id"))]
        return [("aux_df", None)]

    def __init__(self, method="key", aux_df=None, key_col=None, how="left", agg_funcs=None,
                 prefix=None, max_cols=None, user_col="user_id", item_col="item_id",
                 user_df=None, item_df=None):
        super().__init__()
        choose("method", method, ("key", "agg", "rec"))
        choose("how", how, ("left", "inner", "right", "outer"))
        self.method, self.aux_df, self.key_col, self.how = method, aux_df, key_col, how
        self.agg_funcs = as_list(agg_funcs) or ["mean", "max", "min"]
        self.prefix, self.max_cols = prefix, max_cols
        self.user_col, self.item_col = user_col, item_col
        self.user_df, self.item_df = user_df, item_df

    def _apply(self, df):
        if self.method == "rec":
            return self._users_and_items(df)
        if self.aux_df is None or self.key_col not in df.columns or self.key_col not in self.aux_df.columns:
            return df
        return self._by_key(df) if self.method == "key" else self._by_statistics(df)

    def _by_key(self, df):
        key = "__key__"
        left = df.withColumn(key, value(df, self.key_col).cast("string"))
        taken = set(df.columns)
        # Clashing names are renamed before the join and folded into the left column after it.
        renamed = {n: f"__aux__{n}" for n in self.aux_df.columns if n in taken and n != self.key_col}
        right = self.aux_df.select(
            value(self.aux_df, self.key_col).cast("string").alias(key),
            *[value(self.aux_df, n).alias(renamed.get(n, n)) for n in self.aux_df.columns if n != self.key_col])
        if self.how in ("left", "inner"):
            # A missing key matches nothing; the join below would match missing to missing.
            joined = wide_join(left, right.where(F.col(key).isNotNull()), [key], self.how)
        elif self.how == "right":
            joined = wide_join(left.where(F.col(key).isNotNull()), right, [key], "right")
        else:
            known = F.col(key).isNotNull()
            alone = keyed_join(right, left.where(known).select(key).distinct(), [key], "left_anti")
            joined = wide_join(left, right.where(known), [key], "left").unionByName(alone, allowMissingColumns=True)
        added = [n for n in right.columns if n not in taken and n != key and n not in renamed.values()]
        return joined.select(
            *[F.coalesce(col(n), col(renamed[n])).alias(n) if n in renamed else col(n) for n in df.columns],
            *[col(n) for n in added])

    def _by_statistics(self, df):
        aux = self.aux_df
        numeric = numeric_columns(aux, exclude=[self.key_col])
        labels = [f.name for f in aux.schema.fields if f.name != self.key_col
                  and isinstance(f.dataType, (T.StringType, T.BooleanType))]
        if self.max_cols is not None:
            numeric, labels = numeric[:self.max_cols], labels[:self.max_cols]
        lead = f"{self.prefix}_" if self.prefix else ""
        wanted = [(n, f, f"{lead}{n}_{f}") for n in numeric for f in self.agg_funcs]
        wanted += [(n, "nunique", f"{lead}{n}_nunique") for n in labels]
        if not wanted:
            return df
        # One row per key before the join; a missing key forms no group.
        stats = group_statistics(aux, [self.key_col], wanted)
        return keyed_join(df, stats, [self.key_col]).select(
            *[col(n) for n in df.columns], *[col(n) for _, _, n in wanted])

    def _users_and_items(self, df):
        for side, key in ((self.user_df, self.user_col), (self.item_df, self.item_col)):
            if side is not None:
                df = _merge_null_safe(df, side, key, self.how)
        return df


def _merge_null_safe(left, right, key, how):
    """Join where a missing key matches a missing key; clashing names get _x and _y."""
    clash = {n for n in left.columns if n in right.columns and n != key}
    left = left.select(*[col(n).alias(f"{n}_x" if n in clash else n) for n in left.columns])
    right_key = f"__right__{key}"
    right = right.select(*[col(n).alias(right_key if n == key else f"{n}_y" if n in clash else n)
                           for n in right.columns])
    joined = wide_join(left, right.withColumnRenamed(right_key, key), [key], how)
    return joined.select(*[col(n) for n in left.columns], *[col(n) for n in right.columns if n != right_key])


class ConcatTable(Operator):
    """Stack tables by column name, or set them side by side by row position."""

    many_tables = "other_dfs"

    def __init__(self, other_dfs=None, axis="vertical", dedup=False, fill_missing=True, order_cols=None):
        super().__init__()
        choose("axis", axis, ("vertical", "horizontal"))
        self.other_dfs = as_list(other_dfs)
        self.axis, self.dedup, self.fill_missing = axis, bool(dedup), bool(fill_missing)
        self.order_cols = order_cols
        self.per_split = axis == "vertical"

    def _apply(self, df):
        tables = [df, *self.other_dfs]
        if self.axis == "horizontal":
            return self._side_by_side(tables)
        if self.fill_missing:
            out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        else:
            shared = [n for n in df.columns if all(n in t.columns for t in tables)]
            out = reduce(DataFrame.unionByName, [t.select(*[col(n) for n in shared]) for t in tables])
        return out.dropDuplicates() if self.dedup else out

    def _side_by_side(self, tables):
        names = [n for t in tables for n in t.columns]
        if len(set(names)) != len(names):
            raise ValueError("side-by-side tables must not share column names")
        if not self.order_cols:
            raise ValueError("side-by-side tables need order_cols, one list per table")
        placed = [row_index(t, as_list(order)) for t, order in zip(tables, self.order_cols, strict=True)]
        out = reduce(lambda a, b: a.join(b, POSITION, "full"), placed)
        return out.drop(POSITION)


class AlignSchema(Operator):
    """Rename, add required columns, then cast."""

    def __init__(self, column_mapping=None, dtype_mapping=None, required_cols=None, fill_value=None):
        super().__init__()
        self.column_mapping = dict(column_mapping or {})
        self.dtype_mapping = dict(dtype_mapping or {})
        self.required_cols = as_list(required_cols)
        self.fill_value = fill_value

    def _apply(self, df):
        df = df.withColumnsRenamed({k: v for k, v in self.column_mapping.items() if k in df.columns})
        absent = [n for n in self.required_cols if n not in df.columns]
        if absent:
            fill = F.lit(self.fill_value)
            fill = fill.cast("string") if self.fill_value is None else fill
            df = df.withColumns({n: fill for n in absent})
        casts = {n: cast_to(df, n, t) for n, t in self.dtype_mapping.items() if n in df.columns}
        return df.withColumns(casts) if casts else df


class RenameColumn(Operator):
    def __init__(self, rename_map):
        super().__init__()
        if not isinstance(rename_map, dict):
            raise ValueError("rename_map must map old names to new names")
        self.rename_map = rename_map

    def _apply(self, df):
        return df.withColumnsRenamed({k: v for k, v in self.rename_map.items() if k in df.columns})


class DropColumns(Operator):
    def __init__(self, cols):
        super().__init__()
        if cols is None:
            raise ValueError("cols must name at least one column")
        self.cols = as_list(cols)

    def _apply(self, df):
        gone = set(self.cols)
        return df.select(*[col(n) for n in df.columns if n not in gone])


class CastType(Operator):
    def __init__(self, col_dtypes):
        super().__init__()
        if not isinstance(col_dtypes, dict):
            raise ValueError("col_dtypes must map columns to types")
        self.col_dtypes = col_dtypes

    def _apply(self, df):
        casts = {n: cast_to(df, n, t) for n, t in self.col_dtypes.items() if n in df.columns}
        return df.withColumns(casts) if casts else df


class ParseNumber(Operator):
    """Text to number; text that is no number becomes missing."""

    def __init__(self, cols, dtype="float64"):
        super().__init__()
        self.cols, self.dtype = as_list(cols), dtype

    def _apply(self, df):
        casts = {n: cast_to(df, n, self.dtype) for n in present(df, self.cols)}
        return df.withColumns(casts) if casts else df


# Parts a parsed date may be split into (fixed values).
DATE_PARTS = ("year", "month", "day", "days_since_epoch", "day_of_week")

# strftime directives and the matching Spark pattern letters (fixed values).
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy",
            "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS",
            "%a": "EEE", "%A": "EEEE"}


def spark_pattern(fmt: str) -> str:
    """Datetime pattern in Spark letters; strftime directives are translated."""
    if "%" not in fmt:
        return fmt
    for directive, letters in STRFTIME.items():
        fmt = fmt.replace(directive, letters)
    return fmt


class ParseDate(Operator):
    """Dates from text, from YYMMDD numbers, or from YYMMDD birth numbers that carry gender."""

    def __init__(self, cols, mode="string", target_format=None, out_features=None,
                 drop_original=False, formats=None):
        super().__init__()
        choose("mode", mode, ("string", "int_yymmdd", "berka_birth"))
        self.cols, self.mode, self.target_format = as_list(cols), mode, target_format
        self.explicit = out_features is not None
        self.out_features = as_list(out_features) or list(DATE_PARTS[:4])
        self.drop_original = bool(drop_original)
        self.formats = as_list(formats)

    def _parts(self, name, date):
        day = date.cast("date")
        wanted = ["day_of_week" if f == "dayofweek" else f for f in self.out_features]
        made = {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day),
                "days_since_epoch": F.datediff(day, F.lit("1970-01-01").cast("date")),
                "day_of_week": F.weekday(day)}
        return {f"{name}_{p}": made[p] for p in DATE_PARTS if p in wanted}

    def _from_text(self, df, name):
        plain = timestamp(df, name)
        if not isinstance(dtype_of(df, name), T.StringType):
            return plain
        tried = [F.try_to_timestamp(col(name), F.lit(spark_pattern(f))).cast("timestamp_ntz")
                 for f in self.formats]
        return F.coalesce(plain, *tried)

    def _from_digits(self, df, name):
        whole = number(df, name).try_cast("bigint")
        digits = F.when(whole > 0, F.lpad(whole.cast("string"), F.greatest(F.length(whole.cast("string")),
                                                                          F.lit(6)), F.lit("0")))
        yy, mm, dd = [F.substring(digits, s, 2).cast("int") for s in (1, 3, 5)]
        if self.mode == "berka_birth":
            gender = F.when(mm > 50, "F").otherwise("M")
            month, year = F.when(mm > 50, mm - 50).otherwise(mm), yy + 1900
        else:
            gender, month = None, mm
            year = F.when(yy >= 50, yy + 1900).otherwise(yy + 2000)
        zero = F.lit(0)
        date = F.try_make_timestamp_ntz(year, month, dd, zero, zero, zero.cast("decimal(16,6)")).cast("date")
        return date, (F.when(date.isNotNull(), gender) if gender is not None else None)

    def _apply(self, df):
        for name in present(df, self.cols):
            new = {}
            if self.mode == "string":
                parsed = self._from_text(df, name)
                if self.explicit:
                    new.update(self._parts(name, parsed))
                new[name] = F.date_format(parsed, spark_pattern(self.target_format)) \
                    if self.target_format else parsed
            else:
                date, gender = self._from_digits(df, name)
                new.update(self._parts(name, date))
                if gender is not None:
                    new[f"{name}_gender"] = gender
            df = df.withColumns(new)
            if self.drop_original:
                df = df.drop(name)
        return df


class SortRows(Operator):
    """Multi-key sort, missing values last in both directions.

    A hash of the row comes last, so that rows with equal keys need not meet in one task.
    """

    def __init__(self, by=None, ascending=True, tie_cols=None):
        super().__init__()
        self.by, self.ascending, self.tie_cols = as_list(by), ascending, as_list(tie_cols)

    def _apply(self, df):
        by = present(df, self.by)
        if not by:
            return df
        if isinstance(self.ascending, (list, tuple)):
            way = dict(zip(self.by, self.ascending, strict=True))
        else:
            way = dict.fromkeys(by, self.ascending)
        keys = [col(n).asc_nulls_last() if way[n] else col(n).desc_nulls_last() for n in by]
        hashed = [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        return df.orderBy(*keys, *order_columns(present(df, self.tie_cols)), F.xxhash64(*hashed))


class SplitColumn(Operator):
    """Split one text column into several; missing parts are missing."""

    def __init__(self, col, output_cols=None, sep=None, regex=False):
        super().__init__()
        self.col, self.output_cols, self.sep, self.regex = col, output_cols, sep, bool(regex)
        self.names = None

    def _pieces(self, df):
        text = value(df, self.col).cast("string")
        if self.sep is None:
            trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
            return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))
        if self.regex:
            return F.split(text, self.sep)
        return F.split(text, "\\Q" + self.sep.replace("\\E", "\\E\\\\E\\Q") + "\\E")

    def _fit(self, df):
        if self.col not in df.columns:
            self.names = []
        elif self.output_cols is not None:
            self.names = as_list(self.output_cols)
        else:
            width = df.agg(F.max(F.size(self._pieces(df))).alias("k")).first()["k"] or 0
            self.names = [f"{self.col}_{i}" for i in range(width)]

    def _apply(self, df):
        if not self.names or self.col not in df.columns:
            return df
        pieces = self._pieces(df)
        return df.withColumns({n: F.try_element_at(pieces, F.lit(i + 1)) for i, n in enumerate(self.names)})


class CustomTransform(Operator):
    """Apply a callable that maps a DataFrame to a DataFrame."""

    cross_row = True

    def __init__(self, func=None):
        super().__init__()
        self.func = func

    def _apply(self, df):
        if self.func is None:
            return df
        out = self.func(df)
        if not isinstance(out, DataFrame):
            raise TypeError(f"{type(self).__name__}: the callable must return a Spark DataFrame")
        return out
