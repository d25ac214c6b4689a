"""Missing values, safe casts and repeatable random draws as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text accepted as a number: optional sign, digits with optional fraction, optional exponent.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(name: str) -> Column:
    """Column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_list(value) -> list:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple, dict)) else [value]


def present(df: DataFrame, names) -> list[str]:
    """Names that exist in ``df``, in the given order."""
    have = set(df.columns)
    return [n for n in as_list(names) if n in have]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType) and f.name not in set(exclude)]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def value(df: DataFrame, name: str) -> Column:
    """The column with float NaN read as NULL."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_float(dtype_of(df, name)) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace float NaN with NULL in every floating column, in one projection."""
    floats = {f.name for f in df.schema.fields if is_float(f.dataType)}
    if not floats:
        return df
    return df.select(*[value(df, n).alias(n) if n in floats else col(n) for n in df.columns])


def number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is not a plain number becomes NULL."""
    dtype = dtype_of(df, name)
    if is_number(dtype):
        return value(df, name).cast("double")
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("double")
    if isinstance(dtype, T.StringType):
        return number_from_text(col(name))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        raise TypeError(f"column {name} holds dates, not numbers")
    return F.lit(None).cast("double")


def number_from_text(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def timestamp(df: DataFrame, name: str) -> Column:
    """The column as a zone-less timestamp; numbers are epoch seconds, bad text is NULL."""
    dtype = dtype_of(df, name)
    c = col(name)
    if is_number(dtype):
        micros = F.round(value(df, name) * F.lit(1_000_000)).cast("bigint")
        return F.timestamp_add("MICROSECOND", micros, epoch())
    if isinstance(dtype, T.StringType):
        return c.try_cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, as double with microseconds."""
    return F.timestamp_diff("MICROSECOND", epoch(), c).cast("double") / F.lit(1e6)


def hash_uniform(seed: int, *cols: Column) -> Column:
    """Repeatable uniform draw in [0, 1) from a row key and a seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), *cols), 11) / F.lit(float(1 << 53))


def hash_index(seed: int, size: Column, *cols: Column) -> Column:
    """Repeatable uniform integer in [0, size) from a row key and a seed."""
    draw = F.floor(hash_uniform(seed, *cols) * size.cast("double")).cast("long")
    return F.least(draw, size.cast("long") - 1)


def hash_normal(seed: int, *cols: Column) -> Column:
    """Repeatable standard normal draw (Box-Muller on two hash uniforms)."""
    u1 = F.lit(1.0) - hash_uniform(seed, F.lit("radius"), *cols)
    u2 = hash_uniform(seed, F.lit("angle"), *cols)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def any_true(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | F.coalesce(condition, F.lit(False))
    return out


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Set many columns in one projection, so earlier values feed every expression."""
    return df.withColumns(new) if new else df


def scalar_array(values: list, element_type: str) -> Column:
    """One array literal holding ``values``; cheaper to plan than one literal per element."""
    import json

    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element_type}>")
