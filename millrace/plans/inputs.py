"""Inputs of downstream models: vocabularies, padded sequences, windows, adjacency."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

from .. import settings
from ..functions.joins import keyed_join
from ..functions.ordering import add_window_columns
from ..functions.values import as_list, col, dtype_of, number, numeric_columns
from ..session import materialise


def vocabulary_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, size): largest integer + 1, or distinct values + 1; lists count elements."""
    out = None
    flat = [n for n in columns if n in df.columns and not isinstance(dtype_of(df, n), T.ArrayType)]
    if flat:
        cells = [F.struct(F.lit(n).alias("column"), _size(col(n), dtype_of(df, n)).alias("size")) for n in flat]
        out = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    for n in columns:
        if n in df.columns and n not in flat:
            items = df.select(F.explode(col(n)).alias("v"))
            one = items.agg(_size(F.col("v"), items.schema["v"].dataType).alias("size")) \
                .select(F.lit(n).alias("column"), "size")
            out = one if out is None else out.unionByName(one)
    return out


def _size(c, dtype):
    if isinstance(dtype, T.IntegralType):
        return F.coalesce(F.max(c).cast("bigint"), F.lit(0)) + 1
    return F.count_distinct(c) + 1


def pad_sequence(df: DataFrame, name: str, max_len: int, padding=0, length_name: str | None = None) -> DataFrame:
    """The last ``max_len`` elements, padded on the right, and the unpadded length."""
    items = F.coalesce(col(name), F.array().cast(dtype_of(df, name)))
    kept = F.slice(items, F.greatest(F.size(items) - max_len + 1, F.lit(1)), F.lit(max_len))
    fill = F.array_repeat(F.lit(padding).cast(dtype_of(df, name).elementType), F.lit(max_len) - F.size(kept))
    return df.withColumns({name: F.concat(kept, fill), length_name or f"{name}_length": F.size(kept)})


def clamp_ids(df: DataFrame, name: str, vocabulary: int) -> DataFrame:
    """Missing, negative and out-of-vocabulary ids become 0, also inside lists."""
    def safe(x):
        return F.when((x >= 0) & (x < vocabulary), x.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    if isinstance(dtype_of(df, name), T.ArrayType):
        return df.withColumn(name, F.transform(col(name), safe))
    return df.withColumn(name, safe(number(df, name)))


def sliding_windows(df: DataFrame, features: list[str], length: int, entity, order: list,
                    out: str = "window", prefix_rows: DataFrame | None = None,
                    limit: int | None = None) -> DataFrame:
    """Each row with the last ``length`` rows of its entity, itself last.

    The front is padded with the entity's earliest row.  ``prefix_rows`` (the training tail)
    warms up the first windows and is not returned.
    """
    group = as_list(entity)
    mark = "__own__"
    rows = df.withColumn(mark, F.lit(True))
    if prefix_rows is not None:
        rows = rows.unionByName(prefix_rows.withColumn(mark, F.lit(False)))
        order = [F.col(mark).cast("int").asc(), *order]
    packed = F.array(*[number(rows, n) for n in features])

    def build(w):
        return {out: F.collect_list(packed).over(w.rowsBetween(-(length - 1), 0))}
    made = add_window_columns(rows, group, order, build, max(length - 1, 1), limit)
    front = F.array_repeat(F.element_at(col(out), 1), F.lit(length) - F.size(col(out)))
    return made.withColumn(out, F.concat(front, col(out))).where(mark).drop(mark)


def keep_most_variable(df: DataFrame, limit: int, keep=()) -> DataFrame:
    """The ``limit`` numeric columns of largest variance, in table order, plus ``keep``."""
    names = numeric_columns(df, exclude=keep)
    if len(names) <= limit:
        return df
    row = df.agg(*[F.var_samp(F.coalesce(number(df, n), F.lit(0.0))).alias(f"v{i}")
                   for i, n in enumerate(names)]).first()
    ranked = sorted(range(len(names)), key=lambda i: (-(row[f"v{i}"] or 0.0), i))[:limit]
    chosen = {names[i] for i in ranked} | {n for n in df.columns if n not in names}
    return df.select(*[col(n) for n in df.columns if n in chosen])


def normalised_adjacency(edges: DataFrame, src: str, dst: str, nodes: DataFrame, node: str) -> DataFrame:
    """(src, dst, weight): both directions once, plus one self-loop per node, 1/sqrt(d_i d_j)."""
    pairs = edges.select(col(src).alias("src"), col(dst).alias("dst")).where("src is not null and dst is not null")
    both = materialise(both_directions(pairs, "src", "dst"))
    # Only self-loops can meet the nodes' own; all other pairs occur once.
    loops = both.where("src = dst").unionByName(nodes.select(col(node).alias("src"), col(node).alias("dst")).distinct())
    loops = loops.groupBy("src", "dst").agg(F.count("*").alias("times"))
    full = both.where("src <> dst").withColumn("times", F.lit(1).cast("bigint")).unionByName(loops)
    degree = materialise(full.groupBy("src").agg(F.sum("times").alias("d")))
    # Both directions are there, so a node is as often a target as a source.
    largest = degree.agg(F.max("d")).first()[0]
    joined = keyed_join(full, degree, ["src"], "inner", stored=True, largest=largest)
    joined = keyed_join(joined, degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), ["dst"], stored=True, largest=largest)
    weight = F.lit(1.0) / F.sqrt(F.col("d").cast("double") * F.coalesce("e", F.lit(1)).cast("double"))
    return joined.select("src", "dst", (F.col("times") * weight).alias("weight"))


def both_directions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs and their reverse, dealt out so that a task holds a bounded number."""
    both = pairs.unionByName(pairs.select(col(b).alias(a), col(a).alias(b)))
    parts = math.ceil(2 * pairs.count() / settings.PAIR_TASK_ROWS)
    if parts > 1:
        both = both.repartition(parts, a, b)
    return both.distinct()


def neighbour_means(edges: DataFrame, src: str, dst: str, nodes: DataFrame, node: str,
                    features: list[str]) -> DataFrame:
    """Mean feature of each node's neighbours (both directions, 0 for isolated nodes)."""
    pairs = edges.select(col(src).alias("a"), col(dst).alias("b")).where("a is not null and b is not null")
    both = materialise(both_directions(pairs, "a", "b"))
    table = nodes.select(col(node).alias("b"), *[F.coalesce(number(nodes, n), F.lit(0.0)).alias(n) for n in features])
    means = keyed_join(both, table, ["b"], "inner").groupBy("a").agg(*[F.avg(col(n)).alias(f"{n}_neighbours") for n in features])
    return nodes.select(col(node)).join(means, col(node) == F.col("a"), "left").select(
        col(node), *[F.coalesce(col(f"{n}_neighbours"), F.lit(0.0)).alias(f"{n}_neighbours") for n in features])
