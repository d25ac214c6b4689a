"""Categorical encoders: indicators, codes, hashes, target means and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import settings
from ..functions.joins import keyed_join
from ..functions.ordering import POSITION, row_index
from ..functions.values import as_list, col, dtype_of, present, string_columns, value
from ..session import materialise
from .base import Operator, choose


class Lookup:
    """A fitted value -> number table.

    Few entries become a literal map inside the projection.  More stay a durable
    table joined on the value.
    """

    def __init__(self, table: DataFrame):
        table = materialise(table.select("key", "code"))
        self.entries = table.limit(settings.MAX_LITERAL_ENTRIES + 1).collect()
        self.table = table if len(self.entries) > settings.MAX_LITERAL_ENTRIES else None

    @classmethod
    def from_pairs(cls, pairs: list[tuple]) -> "Lookup":
        self = cls.__new__(cls)
        self.entries, self.table = [{"key": k, "code": c} for k, c in pairs], None
        return self

    def attach(self, df: DataFrame, name: str, out: str, default: Column) -> DataFrame:
        """Add (or replace) ``out`` with the code of ``name``; ``default`` where unknown."""
        if self.table is None:
            if not self.entries:
                return df.withColumn(out, default)
            pairs = [F.lit(x) for e in self.entries for x in (e["key"], e["code"])]
            code = F.try_element_at(F.create_map(*pairs), value(df, name))
            return df.withColumn(out, F.coalesce(code, default))
        side = self.table.select(F.col("key").alias("__key__"), F.col("code").alias("__code__"))
        joined = keyed_join(df.withColumn("__key__", value(df, name)), side, ["__key__"], stored=True)
        code = F.coalesce(F.col("__code__"), default).alias(out)
        kept = [code if n == out else col(n) for n in df.columns]
        return joined.select(*kept, *([] if out in df.columns else [code]))


class OneHotEncode(Operator):
    """0/1 column per category seen in training, categories in sorted order."""

    fit_on_train = True

    def __init__(self, cols, max_cardinality=None):
        super().__init__()
        self.cols, self.max_cardinality = as_list(cols), max_cardinality
        self.categories: dict[str, list] = {}

    def _fit(self, df):
        for n in dict.fromkeys(present(df, self.cols)):
            seen = df.select(value(df, n).alias("v")).where("v is not null").distinct()
            # The categories become columns, so they are a result of the fit; max_cardinality bounds them.
            found = [r["v"] for r in (seen if self.max_cardinality is None else seen.limit(self.max_cardinality + 1)).collect()]
            if self.max_cardinality is not None and len(found) > self.max_cardinality:
                continue
            self.categories[n] = sorted(found)

    def _apply(self, df):
        names = [n for n in self.categories if n in df.columns]
        kept = [col(n) for n in df.columns if n not in names]
        made = [F.coalesce((value(df, n) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{n}_{v}")
                for n in names for v in self.categories[n]]
        return df.select(*kept, *made)


def first_seen_codes(df: DataFrame, name: str, order_cols: list[str]) -> DataFrame:
    """(key, code): 0-based codes by first appearance, or by value without an order."""
    v = value(df, name).alias("key")
    if order_cols:
        first = F.min(F.struct(*[x for c in order_cols for x in (col(c).isNull(), col(c))]))
        seen = df.groupBy(v).agg(first.alias("first")).where("key is not null")
        order = ["first", "key"]
    else:
        seen, order = df.select(v).where("key is not null").distinct(), ["key"]
    return row_index(seen, order).select("key", F.col(POSITION).cast("bigint").alias("code"))


class OrdinalEncode(Operator):
    """Codes in a given order, or by first appearance where none is given."""

    fit_on_train = True

    def __init__(self, cols, ordering=None, unknown_value=-1, order_cols=None):
        super().__init__()
        self.cols, self.ordering = as_list(cols), ordering or {}
        self.unknown_value, self.order_cols = unknown_value, as_list(order_cols)
        self.lookups: dict[str, Lookup] = {}

    def _fit(self, df):
        for n in present(df, self.cols):
            order = self.ordering.get(n) if isinstance(self.ordering, dict) else self.ordering
            self.lookups[n] = Lookup.from_pairs([(v, i) for i, v in enumerate(order)]) if order else \
                Lookup(first_seen_codes(df, n, self.order_cols))

    def _apply(self, df):
        for n in present(df, self.lookups):
            df = self.lookups[n].attach(df, n, n, F.lit(self.unknown_value))
        return df.withColumns({n: col(n).cast("bigint") for n in present(df, self.lookups)})


class LabelEncode(Operator):
    """Integer codes by first appearance in training; missing and unseen are -1."""

    fit_on_train = True

    def __init__(self, cols=None, order_cols=None):
        super().__init__()
        self.cols, self.order_cols = cols, as_list(order_cols)
        self.lookups: dict[str, Lookup] = {}

    def _fit(self, df):
        names = string_columns(df, exclude=["__split__"]) if self.cols is None else present(df, self.cols)
        self.lookups = {n: Lookup(first_seen_codes(df, n, self.order_cols)) for n in names}

    def _apply(self, df):
        for n in present(df, self.lookups):
            df = self.lookups[n].attach(df, n, n, F.lit(-1).cast("bigint"))
        return df


def text_of(df: DataFrame, name: str) -> Column:
    """Printed form of a value, booleans capitalised."""
    c = value(df, name)
    return F.initcap(c.cast("string")) if isinstance(dtype_of(df, name), T.BooleanType) else c.cast("string")


def md5_bucket(text: Column, n: int) -> Column:
    """First eight MD5 bytes, read big-endian, modulo ``n`` (below 2**31)."""
    digest = F.md5(text)
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    if (1 << 32) % n == 0:
        return F.pmod(low, F.lit(n)).cast("int")  # the upper half vanishes
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.pmod(F.pmod(high, F.lit(n)) * F.lit((1 << 32) % n) + low, F.lit(n)).cast("int")


class HashEncode(Operator):
    """Bucket number from the MD5 of the printed value; missing is bucket 0."""

    def __init__(self, cols, n_buckets=1024, prefix="h_", drop_original=False):
        super().__init__()
        self.cols, self.n_buckets = as_list(cols), int(n_buckets)
        self.prefix, self.drop_original = prefix, bool(drop_original)
        if not 0 < self.n_buckets < 1 << 31:
            raise ValueError("n_buckets must be positive and below 2**31")

    def _apply(self, df):
        names = present(df, self.cols)
        out = df.withColumns({f"{self.prefix}{n}": F.coalesce(md5_bucket(text_of(df, n), self.n_buckets), F.lit(0))
                              for n in names}) if names else df
        return out.drop(*names) if self.drop_original else out


class TargetEncode(Operator):
    """Smoothed training mean of the target per category."""

    fit_on_train = True

    def __init__(self, cols, target_col="rating", smoothing=1.0):
        super().__init__()
        if smoothing < 0:
            raise ValueError("smoothing must not be negative")
        self.cols, self.target_col, self.smoothing = as_list(cols), target_col, float(smoothing)
        self.overall = None
        self.lookups: dict[str, Lookup] = {}

    def _fit(self, df):
        if self.target_col not in df.columns:
            return
        y = value(df, self.target_col).cast("double")
        self.overall = df.agg(F.avg(y).alias("m")).first()["m"]
        if self.overall is None:
            return
        for n in present(df, self.cols):
            s = F.lit(self.smoothing)
            stats = df.groupBy(value(df, n).alias("key")).agg(F.avg(y).alias("m"), F.count(y).alias("n")) \
                .where("key is not null and m is not null")
            code = (F.col("n") * F.col("m") + s * F.lit(self.overall)) / (F.col("n") + s)
            self.lookups[n] = Lookup(stats.select("key", code.alias("code")))

    def _apply(self, df):
        for n in present(df, self.lookups):
            df = self.lookups[n].attach(df, n, f"{n}_{self.target_col}", F.lit(self.overall))
        return df


class FrequencyEncode(Operator):
    """Training count of each value; unseen and missing are 0."""

    fit_on_train = True

    def __init__(self, cols, suffix="_freq", drop_original=False):
        super().__init__()
        self.cols, self.suffix, self.drop_original = as_list(cols), suffix, bool(drop_original)
        self.output_col_types = {f"{n}{suffix}": "numeric" for n in self.cols}
        self.lookups: dict[str, Lookup] = {}

    def _fit(self, df):
        for n in present(df, self.cols):
            counts = df.groupBy(value(df, n).alias("key")).agg(F.count("*").alias("code"))
            self.lookups[n] = Lookup(counts.where("key is not null"))

    def _apply(self, df):
        names = present(df, self.lookups)
        for n in names:
            df = self.lookups[n].attach(df, n, f"{n}{self.suffix}", F.lit(0).cast("bigint"))
        return df.drop(*names) if self.drop_original else df
