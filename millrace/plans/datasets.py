"""Turning raw tables into datasets: panels, labels, long tables, dense ids, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.aggregates import group_statistics
from ..functions.joins import keyed_join
from ..functions.ordering import POSITION, row_index
from ..functions.quantiles import exact_quantiles
from ..functions.sampling import hash_sample
from ..functions.values import as_list, col, dtype_of, epoch, is_number, number, value
from ..operators.base import HELD_OUT, SPLIT
from ..session import materialise


def hourly_panel(df: DataFrame, entity: str, time_col: str, measures: dict[str, list[str]],
                 count_name: str | None = None) -> DataFrame:
    """One row per entity and hour; a missing entity or hour forms its own group."""
    hours = df.withColumn("_hour_ts", F.date_trunc("hour", col(time_col)).cast("timestamp_ntz"))
    pick = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    aggs = [pick[f](value(df, n)).alias(f"{n}_{f}") for n, fs in measures.items() for f in as_list(fs)
            if n in df.columns]
    if count_name or not aggs:
        aggs.append(F.count("*").alias(count_name or "row_count"))
    out = hours.groupBy(col(entity), col("_hour_ts")).agg(*aggs)
    return out.withColumn("_hour_idx", F.timestamp_diff("SECOND", epoch(), F.col("_hour_ts")))


def within(df: DataFrame, ranges: dict[str, tuple], window: tuple | None = None,
           blank: dict[str, tuple] | None = None) -> DataFrame:
    """Rows inside every inclusive range; missing fails.  ``blank`` ranges only clear values."""
    cleared = {n: F.when(number(df, n).between(*lohi), col(n)) for n, lohi in (blank or {}).items()
               if n in df.columns}
    out = df
    for n, (low, high) in ranges.items():
        if n in df.columns:
            out = out.where(_between(df, n, low, high))
    if window:
        name, start, end = window
        kind = dtype_of(df, name)
        when = col(name) if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)) \
            else col(name).try_cast("timestamp_ntz")
        kind = kind if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) else T.TimestampNTZType()
        out = out.where(when.between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    return out.withColumns(cleared) if cleared else out


def _between(df, name, low, high):
    """Inclusive range as plain comparisons, so the scan can skip on them (NaN is above any bound)."""
    v = col(name) if is_number(dtype_of(df, name)) else number(df, name)
    return (v >= F.lit(low)) & (v <= F.lit(high))


def within_then_iqr(df: DataFrame, name: str, low: float, high: float, width: float = 3.0,
                    window: tuple | None = None) -> DataFrame:
    """Range filter, then a quartile filter learned from what is left, then a date window."""
    out = df.where(_between(df, name, low, high))
    q1, q3 = exact_quantiles(out, {name: number(out, name)}, [0.25, 0.75])[name]
    if q1 is not None and q3 - q1 > 0:
        span = width * (q3 - q1)
        out = out.where(_between(out, name, q1 - span, q3 + span))
    return within(out, {}, window) if window else out


def busiest(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent keys (the smaller key on a tie)."""
    top = df.where(value(df, key).isNotNull()).groupBy(col(key)).agg(F.count("*").alias("__n__")) \
        .orderBy(F.desc("__n__"), col(key)).limit(int(n)).select(key)
    return keyed_join(df, top, [key], "left_semi").select(*[col(c) for c in df.columns])


def row_sample(df: DataFrame, n: int, seed: int = 42, keys=None) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), the same ones under any partitioning."""
    return hash_sample(df, [(F.lit(True), n)], seed, keys)


def normalise_trips(df: DataFrame, renames: dict[str, str], start: str = "started_at", end: str = "ended_at",
                    duration: str = "trip_duration") -> DataFrame:
    """One schema for old and new files: trimmed names, renamed columns, derived duration."""
    df = df.withColumnsRenamed({n: n.strip() for n in df.columns if n != n.strip()})
    df = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})
    if duration not in df.columns and start in df.columns and end in df.columns:
        micros = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
        df = df.withColumn(duration, micros / F.lit(1e6))
    return df


def wide_to_long(df: DataFrame, id_cols, groups: dict[str, list[str]], offset_name: str) -> DataFrame:
    """One row per id and step; step ``i`` takes the i-th column of every group."""
    ids = as_list(id_cols)
    steps = len(next(iter(groups.values())))
    if any(len(v) != steps for v in groups.values()):
        raise ValueError("every group needs the same number of columns")
    cells = F.array(*[F.struct(*[col(v[i]).alias(n) for n, v in groups.items()], F.lit(i).alias(offset_name))
                      for i in range(steps)])
    return df.select(*[col(i) for i in ids], F.explode(cells).alias("__c__")).select(
        *[col(i) for i in ids], "__c__.*")


def group_summary(df: DataFrame, key: str, means: list[str], count_name: str | None = None) -> DataFrame:
    """Per-key means and optional row count, as an auxiliary table."""
    wanted = [(n, "mean", f"{n}_mean") for n in means]
    if count_name:
        wanted.append((key, "size", count_name))
    return group_statistics(df, [key], wanted)


def latest_per_key(df: DataFrame, key: str, date_col: str, tie_cols=()) -> DataFrame:
    """The last row of each key; ranks are cut inside each task before the shuffle."""
    order = [col(date_col).desc_nulls_first(), *[col(t).desc_nulls_first() for t in tie_cols]]
    rank = F.row_number().over(Window.partitionBy(col(key)).orderBy(*order))
    return df.withColumn("__r__", rank).where("__r__ = 1").drop("__r__")


def label_from_status(df: DataFrame, status: str, mapping: dict, target: str, drop=()) -> DataFrame:
    """Label by a status map; rows with another status, and leaking columns, are dropped."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), col(status))
    out = df.withColumn(target, label).where(col(target).isNotNull())
    return out.drop(*[c for c in drop if c != target])


def binary_label(df: DataFrame, target: str, threshold=None, positive_label=1, negative_label=0,
                 mode: str = "ge") -> DataFrame:
    """'ge': at or above the threshold is positive (missing is negative); 'passthrough' checks."""
    if mode == "ge":
        if threshold is None:
            raise ValueError("mode 'ge' needs a threshold")
        hit = F.coalesce(number(df, target) >= F.lit(float(threshold)), F.lit(False))
        return df.withColumn(target, F.when(hit, positive_label).otherwise(negative_label))
    if mode != "passthrough":
        raise ValueError(f"unknown mode {mode!r}")
    bad = df.where(value(df, target).isNotNull() & ~col(target).isin(positive_label, negative_label)).limit(1)
    if not bad.isEmpty():
        raise ValueError(f"{target} holds other values than the two labels")
    return df.withColumn(target, col(target).cast("int"))


def time_key(df: DataFrame, year: str, month: str, day: str, hour: str, out: str = "time_key") -> DataFrame:
    """YYYYMMDDHH as one sortable integer."""
    y, m, d, h = [number(df, n).cast("bigint") for n in (year, month, day, hour)]
    return df.withColumn(out, y * 1_000_000 + m * 10_000 + d * 100 + h)


# Class vocabulary of node labels (fixed values): unknown -1, illicit 1, licit 0.
NODE_CLASSES = {"unknown": -1, "-1": -1, "1": 1, "2": 0, "0": 0}


def class_code(c: Column) -> Column:
    """Node class as a code; text outside the vocabulary is missing."""
    text = F.trim(c.cast("string"))
    whole = F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), F.floor(text.try_cast("double")).cast("string"))
    table = F.create_map(*[F.lit(x) for kv in NODE_CLASSES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, whole))


def attach_classes(nodes: DataFrame, classes: DataFrame, id_col: str, class_col: str = "class") -> DataFrame:
    """A node's own label first, then the lookup by id, else -1."""
    side = classes.select(col(id_col).cast("string").alias("__id__"), class_code(col(class_col)).alias("__c__"))
    side = side.groupBy("__id__").agg(F.max("__c__").alias("__c__"))
    joined = keyed_join(nodes.withColumn("__id__", col(id_col).cast("string")), side.where("__id__ is not null"), ["__id__"])
    own = class_code(col(class_col)) if class_col in nodes.columns else F.lit(None).cast("int")
    label = F.coalesce(own, F.col("__c__"), F.lit(-1)).cast("bigint").alias(class_col)
    return joined.select(*[col(n) for n in nodes.columns if n != class_col], label)


def _dense_numbers(values: DataFrame) -> DataFrame:
    """(v, no): distinct values numbered from 1 in the order of their text."""
    seen = values.where("v is not null").distinct()
    return row_index(seen, [F.col("v").cast("string").asc(), F.col("v").asc()]).select(
        "v", (F.col(POSITION) + 1).alias("no"))


def _renumber_lists(df: DataFrame, name: str, numbers: DataFrame) -> DataFrame:
    """Map every list element; unknown elements become 0."""
    row = "__row__"
    kept = materialise(df.withColumn(row, F.monotonically_increasing_id()))
    parts = kept.select(row, F.posexplode(col(name)).alias("p", "v"))
    mapped = keyed_join(parts, numbers, ["v"]).groupBy(row).agg(
        F.sort_array(F.collect_list(F.struct("p", F.coalesce("no", F.lit(0)).alias("no")))).alias("__l__"))
    joined = kept.join(mapped, row, "left")
    new = F.when(col(name).isNotNull(), F.coalesce(F.transform("__l__", lambda s: s["no"]),
                                                   F.array().cast("array<bigint>")))
    return joined.select(*[new.alias(n) if n == name else col(n) for n in df.columns])


def _tables_with(tables: dict[str, DataFrame], name: str):
    return [(t, d) for t, d in tables.items() if name in d.columns]


def dense_ids(tables: dict[str, DataFrame], id_col: str, list_cols=()) -> dict[str, DataFrame]:
    """Replace an id, and list columns of such ids, by 1..n over all tables at once."""
    found = None
    for d in tables.values():
        parts = [d.select(col(id_col).alias("v"))] if id_col in d.columns else []
        parts += [d.select(F.explode(col(n)).alias("v")) for n in list_cols if n in d.columns]
        for p in parts:
            found = p if found is None else found.unionByName(p)
    if found is None:
        return tables
    numbers = _dense_numbers(found)
    out = {}
    for t, d in tables.items():
        columns = d.columns
        if id_col in columns:
            joined = keyed_join(d.withColumn("v", col(id_col)), numbers, ["v"])
            d = joined.select(*[F.col("no").alias(n) if n == id_col else col(n) for n in columns])
        for n in list_cols:
            if n in columns:
                d = _renumber_lists(d, n, numbers)
        out[t] = d
    return out


def token_ids(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Replace a categorical (list) column by 1..n; dense integer columns stay as they are."""
    holders = _tables_with(tables, name)
    if not holders:
        return tables
    is_list = isinstance(dtype_of(holders[0][1], name), T.ArrayType)
    values = None
    for _, d in holders:
        v = d.select((F.explode(col(name)) if is_list else value(d, name)).alias("v"))
        values = v if values is None else values.unionByName(v)
    if isinstance(values.schema["v"].dataType, T.IntegralType):
        if is_list or not any(_sparse_integers(d, name) for _, d in holders):
            return tables
    numbers = _dense_numbers(values)
    out = dict(tables)
    for t, d in holders:
        if is_list:
            out[t] = _renumber_lists(d, name, numbers)
        else:
            joined = keyed_join(d.withColumn("v", value(d, name)), numbers, ["v"])
            out[t] = joined.select(*[F.coalesce("no", F.lit(0)).alias(n) if n == name else col(n)
                                     for n in d.columns])
    return out


def _sparse_integers(df, name):
    row = df.agg(F.min(col(name)).alias("lo"), F.max(col(name)).alias("hi"),
                 F.count_distinct(col(name)).alias("n")).first()
    # Wider than twice the distinct values plus ten (fixed rule).
    return row["lo"] is not None and row["hi"] - row["lo"] + 1 > row["n"] * 2 + 10


def edge_index(edges: DataFrame, src: str, dst: str, nodes: DataFrame, node_id: str, order: list) -> DataFrame:
    """(src, dst) as 0-based node positions; edges with an unknown end are dropped."""
    numbers = row_index(nodes.select(col(node_id).cast("string").alias("__id__"),
                                     *[col(o) for o in order]), order)
    a = numbers.select(F.col("__id__").alias("a"), F.col(POSITION).alias("src"))
    b = numbers.select(F.col("__id__").alias("b"), F.col(POSITION).alias("dst"))
    pairs = edges.select(col(src).cast("string").alias("a"), col(dst).cast("string").alias("b")).distinct()
    return keyed_join(keyed_join(pairs, a, ["a"], "inner"), b, ["b"], "inner").select("src", "dst")


def time_step_masks(nodes: DataFrame, step_col: str, class_col: str = "class", last_train: int = 34,
                    last_val: int = 39) -> DataFrame:
    """Boolean train / val / test / std_test columns for labelled nodes by time step."""
    step = F.coalesce(number(nodes, step_col).cast("bigint"), F.lit(0))
    known = F.coalesce(number(nodes, class_col), F.lit(-1.0)) >= 0
    held = (col(SPLIT) == HELD_OUT) & known if SPLIT in nodes.columns else F.lit(False)
    held = F.coalesce(held, F.lit(False))
    return nodes.withColumns({
        "train_mask": known & (step <= last_train) & ~held,
        "val_mask": known & (step > last_train) & (step <= last_val) & ~held,
        "test_mask": known & (step > last_val) & ~held,
        "std_test_mask": held,
    })
