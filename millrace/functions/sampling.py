"""Exact-size random samples that move no row to a single place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialise
from .ordering import POSITION, row_index
from .sizes import sent_if_small
from .values import as_list, col

# A draw has 60 bits and is read in 12-bit digits: a histogram has at most 4,096 bins a group.
DIGIT, DIGITS = 12, 5
CHOSEN = "__chosen__"
_GROUP, _DRAW = "__group__", "__draw__"


def key_columns(df: DataFrame, keys) -> list[Column]:
    return [col(n) for n in (as_list(keys) or df.columns)]


def key_draw(seed: int, *keys: Column) -> Column:
    """Whole number of 60 bits from the MD5 of seed and keys as text, joined by ``|``; missing keys are left out."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _cutoffs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(group, cut, ties): rows with a draw below the cut are chosen, and so many of those that equal it.

    Rows are counted by group and digit of the draw; only the digit in which a group's count reaches the wanted
    number is looked at again with the next digit.
    """
    end = 1 << (DIGIT * DIGITS)
    sizes = rows.groupBy(_GROUP).agg(F.count("*").alias("n")).withColumnRenamed(_GROUP, "g")
    state = materialise(wanted.join(sizes, wanted["group"].eqNullSafe(F.col("g"))).select(
        "group", "n", F.col("wanted").cast("bigint").alias("rest")))
    whole = F.col("rest") >= F.col("n")
    none = F.lit(0).cast("bigint")
    done = state.where(whole | (F.col("rest") <= 0)).select(
        "group", F.when(whole, F.lit(end)).otherwise(none).alias("cut"), none.alias("ties"))
    left = state.where(~whole & (F.col("rest") > 0)).select("group", "rest", none.alias("prefix"))
    for level in range(DIGITS):
        if left.isEmpty():
            break
        inside = rows.join(left, F.col(_GROUP).eqNullSafe(F.col("group")) & (
            F.shiftright(_DRAW, DIGIT * (DIGITS - level)) == F.col("prefix")))
        bins = inside.groupBy("group", "rest", F.shiftright(_DRAW, DIGIT * (DIGITS - level - 1)).alias("bin")).agg(
            F.count("*").alias("c"), F.min(_DRAW).alias("low"), F.max(_DRAW).alias("high"))
        run = bins.withColumn("to", F.sum("c").over(Window.partitionBy("group").orderBy("bin")))
        edge = materialise(run.where((F.col("to") >= F.col("rest")) & (F.col("to") - F.col("c") < F.col("rest"))).select(
            "group", (F.col("rest") - F.col("to") + F.col("c")).alias("rest"), F.col("bin").alias("prefix"), "c", "low", "high"))
        full, single = F.col("rest") == F.col("c"), F.col("low") == F.col("high")
        done = done.unionByName(edge.where(full | single).select(
            "group", F.when(full, F.col("high") + 1).otherwise(F.col("low")).alias("cut"),
            F.when(full, none).otherwise(F.col("rest")).alias("ties")))
        left = edge.where(~full & ~single).select("group", "rest", "prefix")
    return materialise(done)


def mark_sample(df: DataFrame, group: Column, wanted: DataFrame, seed: int, keys=None) -> DataFrame:
    """Every row with a boolean ``__chosen__``: of each group the wanted number of rows, by smallest draw of the keys.

    ``wanted`` has the columns group and wanted, one row per group; rows of other groups are not chosen.  Groups and
    rows can be any number: only bins are counted, and rows are filtered, not sorted.  Rows that equal the cut-off's
    draw are settled by a distributed sort of those rows alone.
    """
    drawn = df.withColumns({_GROUP: group, _DRAW: key_draw(seed, *key_columns(df, keys))})
    cuts = _cutoffs(materialise(drawn.select(_GROUP, _DRAW)), wanted)
    joined = drawn.join(sent_if_small(cuts), F.col(_GROUP).eqNullSafe(F.col("group")), "left")
    out = joined.withColumn(CHOSEN, F.coalesce(F.col(_DRAW) < F.col("cut"), F.lit(False)))
    if not cuts.where("ties > 0").isEmpty():
        tie = F.coalesce((F.col("ties") > 0) & (F.col(_DRAW) == F.col("cut")), F.lit(False))
        named = as_list(keys)
        others = [f.name for f in df.schema.fields if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType))]
        placed = row_index(out.where(tie), [_GROUP, *named, *others])
        first = placed.groupBy(_GROUP).agg(F.min(POSITION).alias("first")).withColumnRenamed(_GROUP, "tied")
        placed = placed.join(first, F.col(_GROUP).eqNullSafe(F.col("tied"))) \
            .withColumn(CHOSEN, F.col(POSITION) - F.col("first") < F.col("ties"))
        out = out.where(~tie).unionByName(placed.select(*[col(c) for c in out.columns]))
    return out.select(*[col(c) for c in df.columns], CHOSEN)


def sizes_table(df: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    return df.sparkSession.createDataFrame(sizes, "group int, wanted bigint")


def hash_sample(df: DataFrame, sizes: list[tuple[Column, int]], seed: int, keys=None) -> DataFrame:
    """From each condition's rows, exactly the wanted number, by smallest hash draw; conditions do not overlap."""
    group = F.lit(None).cast("int")
    for i, (condition, _) in reversed(list(enumerate(sizes))):
        group = F.when(condition, F.lit(i)).otherwise(group)
    wanted = sizes_table(df, [(i, int(n)) for i, (_, n) in enumerate(sizes)])
    return mark_sample(df, group, wanted, seed, keys).where(CHOSEN).drop(CHOSEN)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(group, n): rows per class that is not missing."""
    return df.groupBy(col(target).alias("group")).agg(F.count("*").alias("n")).where("group is not null")


def class_sizes(df: DataFrame, target: str) -> dict:
    """Rows per class that is not missing, for steps whose fitted result has a part for each class."""
    return {r["group"]: r["n"] for r in sorted(class_counts(df, target).collect(), key=lambda r: str(r["group"]))}


def repeat_rows(df: DataFrame, times: Column, name: str, rows_at_once: int = 10_000) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``name``; a row with a large number is spread over tasks."""
    counted = df.withColumn("__times__", times.cast("bigint")).where("__times__ > 0")
    parts = counted.withColumn("__part__", F.explode(F.expr(f"sequence(0L, (__times__ - 1) div {rows_at_once}L)")))
    spread = parts.repartition(*[col(c) for c in df.columns[:1]], F.col("__part__"))
    first = F.col("__part__") * rows_at_once
    return spread.withColumn(name, F.explode(F.sequence(
        first + 1, F.least(first + rows_at_once, F.col("__times__"))))).drop("__times__", "__part__")


def beta_draws(ids, alpha: float, seed: int):
    """Beta(alpha, alpha) draws, a function of (seed, id) only (Johnk's method)."""
    import numpy as np

    ids = np.asarray(ids, dtype=np.uint64)
    out = np.full(len(ids), np.nan)
    todo = np.arange(len(ids))
    turn = 0
    while len(todo):
        u = _mix(ids[todo], seed, 2 * turn)
        v = _mix(ids[todo], seed, 2 * turn + 1)
        x, y = np.log(u) / alpha, np.log(v) / alpha
        ok = np.logaddexp(x, y) <= 0.0
        out[todo[ok]] = np.exp(x[ok] - np.logaddexp(x[ok], y[ok]))
        todo = todo[~ok]
        turn += 1
    return out


def _mix(ids, seed: int, stream: int):
    """Uniforms in (0, 1) by a 64-bit integer mixer."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + stream * 7_919 + 1) & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
