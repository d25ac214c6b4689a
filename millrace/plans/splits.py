"""Building, attaching and trimming held-out rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import keyed_join
from ..functions.ordering import POSITION, join_on_keys, row_index, value_at
from ..functions.ranks import cut_at
from ..functions.sampling import CHOSEN, class_counts, hash_sample, key_columns, mark_sample
from ..functions.values import as_list, col, dtype_of, numeric_columns, value
from ..operators.base import HELD_OUT, SPLIT
from ..session import materialise
from ..operators.sampling import draw_unseen, is_time_name

FRACTION, SEED = 0.2, 42


def proportional_sizes(classes: DataFrame, total: int) -> DataFrame:
    """(group, n, kept): split ``total`` over the classes (group, n) in proportion, largest remainders first."""
    rows = classes.agg(F.sum("n")).first()[0] or 0
    exact = F.col("n") * F.lit(total) / F.lit(max(rows, 1))
    parts = classes.select("group", "n", exact.alias("exact"), F.floor(exact).alias("floor"))
    spare = total - (parts.agg(F.sum("floor")).first()[0] or 0)
    placed = row_index(parts, [F.col("floor") - F.col("exact"), F.col("group").cast("string")])
    return placed.select("group", "n", (F.col("floor") + (F.col(POSITION) < spare).cast("bigint")).alias("kept"))


def stratified_holdout(df: DataFrame, target: str, keys, fraction: float = FRACTION,
                       seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, held out): exact per-class sizes, rows chosen by hash draw of their ``keys``.

    Both parts are cut from one marker, so every row is in exactly one of them, also where keys repeat.
    Rows without a class stay in train.
    """
    classes = materialise(class_counts(df, target))
    rows = classes.agg(F.sum("n")).first()[0] or 0
    sizes = proportional_sizes(classes, rows - math.ceil(rows * fraction))
    # The cut-offs of the marker are durable, so both parts are filters of the input.
    marked = mark_sample(df, col(target), sizes.select("group", (F.col("n") - F.col("kept")).alias("wanted")), seed, keys)
    return marked.where(~F.col(CHOSEN)).drop(CHOSEN), marked.where(CHOSEN).drop(CHOSEN)


def chronological_tail(df: DataFrame, time_col: str, fraction: float = FRACTION):
    """(train, held out, cut): cut at a position of the distinct timestamps."""
    moments = df.select(value(df, time_col).alias(time_col)).where(col(time_col).isNotNull()).distinct()
    n = moments.count()
    row = value_at(moments, [time_col], int(n * (1 - fraction)), [time_col]) if n else None
    if row is None:
        return df, df.where(F.lit(False)), None
    cut = row[0]
    before = F.coalesce(value(df, time_col) < F.lit(cut).cast(dtype_of(df, time_col)), F.lit(False))
    return df.where(before), df.where(~before), cut


def positional_tail(df: DataFrame, order: list, fraction: float = FRACTION):
    """(train, held out): cut at a row position of the total order; both are filters of ``df``."""
    return cut_at(df, order, int(df.count() * (1 - fraction)))


def node_holdout(nodes: DataFrame, classes: DataFrame, id_col: str, class_col: str, labelled=("1", "2"),
                 fraction: float = FRACTION, seed: int = SEED):
    """(train, held out with class): a random share of the labelled nodes."""
    known = classes.where(col(class_col).cast("string").isin(list(labelled)))
    chosen = hash_sample(known, [(F.lit(True), int(known.count() * fraction))], seed, [id_col])
    side = chosen.select(col(id_col).cast("string").alias("__id__"), col(class_col).alias("__class__"))
    text = col(id_col).cast("string")
    train = nodes.join(side, text == F.col("__id__"), "left_anti")
    held = nodes.join(side, text == F.col("__id__")).withColumn(class_col, F.col("__class__")) \
        .drop("__id__", "__class__")
    return train, held


def recent_positives(df: DataFrame, order: list, target: str | None, positive_label=1, min_train: int = 1,
                     user: str = "user_id", item: str = "item_id", fraction: float = FRACTION):
    """(train, held out): the latest rows; held-out positives of users and items seen before."""
    # Counted, cut and read several times: what made the table runs once.
    df = materialise(df)
    n = df.count()
    if n < 2:
        raise ValueError("a temporal split needs at least two rows")
    train, late = cut_at(df, order, min(max(int(n * (1 - fraction)), 1), n - 1))
    if target is not None and target in df.columns:
        late = late.where(col(target) == F.lit(positive_label))
    users = train.groupBy(col(user)).agg(F.count("*").alias("__n__")).where(F.col("__n__") >= min_train).select(user)
    items = train.select(item).where(col(item).isNotNull()).distinct()
    return train, keyed_join(keyed_join(late, users, [user], "left_semi"), items, [item], "left_semi")


def holdout_negatives(held: DataFrame, train: DataFrame, user: str = "user_id", item: str = "item_id",
                      n: int = 1, seed: int = SEED, keys=None) -> DataFrame:
    """(user, item): per held-out positive, ``n`` distinct training items unseen by its user."""
    pool = train.select(item).where(col(item).isNotNull()).distinct()
    seen = train.select(user, item).unionByName(held.select(user, item)).where(col(item).isNotNull()).distinct()
    seen = materialise(seen)
    drawn = draw_unseen(held, seen, pool, user, item, seed, key_columns(held, keys), n, distinct=True)
    return drawn.select(col(user), F.col("__item__").alias(item))


def materialise_negatives(negatives: DataFrame, positives: DataFrame, train: DataFrame, target: str | None,
                          negative_label=0, users: DataFrame | None = None, user: str = "user_id",
                          item: str = "item_id", order=None) -> DataFrame:
    """Negative rows with the columns of the positives.

    User attributes come from the user table (or the user's first known row),
    interaction numbers are 0, item attributes and times stay missing.
    """
    attributes = [n for n in positives.columns if n.startswith("user_") and n not in (user, target)]
    numbers = set(numeric_columns(positives))
    out = negatives
    if attributes:
        source = users if users is not None and user in users.columns else train
        have = [n for n in attributes if n in source.columns]
        some = F.coalesce(*[value(source, n).cast("string") for n in have]).isNotNull()
        facts = F.struct(*[col(n) for n in have])
        rank = F.struct(*[x for n in (as_list(order) or source.columns) for x in (col(n).isNull(), col(n))]) \
            if order or source is train else facts
        first = source.where(some).groupBy(col(user)).agg(F.min_by(facts, rank).alias("__facts__"))
        out = keyed_join(out, first, [user])
    made = []
    for n in positives.columns:
        kind = dtype_of(positives, n)
        if n in (user, item):
            c = col(n)
        elif n == target:
            c = F.lit(negative_label)
        elif n in attributes:
            c = F.col("__facts__").getField(n) if n in have else F.lit(None)
        elif n in numbers and not (n.startswith("item_") or n.endswith("_seq") or is_time_name(n)):
            c = F.lit(0)
        else:
            c = F.lit(None)
        made.append(c.cast(kind).alias(n))
    return out.select(*made)


def attach_holdout(train: DataFrame, held: DataFrame) -> DataFrame:
    """One table with a split marker; columns missing on either side are padded."""
    if SPLIT not in train.columns:
        train = train.withColumn(SPLIT, F.lit("train"))
    return train.unionByName(held.drop(SPLIT).withColumn(SPLIT, F.lit(HELD_OUT)), allowMissingColumns=True)


def keep_known(df: DataFrame, user: str | None, item: str | None, target: str | None = None,
               positive_label=1) -> DataFrame:
    """Held-out rows limited to training users and items, then to users with a positive."""
    held = df.where(col(SPLIT) == HELD_OUT)
    train = df.where(~F.coalesce(col(SPLIT) == HELD_OUT, F.lit(False)))
    for key in (user, item):
        if key and key in df.columns:
            known = train.select(col(key)).where(col(key).isNotNull()).distinct()
            held = keyed_join(held, known, [key], "left_semi")
    if target and user and target in df.columns and user in df.columns:
        hits = held.where(col(target) == F.lit(positive_label)).select(col(user)) \
            .where(col(user).isNotNull()).distinct()
        held = keyed_join(held, hits, [user], "left_semi")
    return train.unionByName(held)


def split_tables(df: DataFrame) -> dict[str, DataFrame]:
    """One table per marker value, without the marker."""
    names = [r[0] for r in df.select(SPLIT).distinct().collect()]
    return {n: df.where(col(SPLIT).eqNullSafe(F.lit(n))).drop(SPLIT) for n in sorted(names, key=str)}


def budget_sample(df: DataFrame, rows: int, target: str | None = None, seed: int = SEED, keys=None) -> DataFrame:
    """``rows`` training rows and half as many held-out rows, balanced over classes."""
    held = F.coalesce(col(SPLIT) == HELD_OUT, F.lit(False))
    n = {r[0]: r[1] for r in df.groupBy(held).count().collect()}
    wanted: list[tuple[Column, int]] = [(~held, rows)]
    budget = max(1, rows // 2)
    if n.get(True, 0) > budget and target is not None and target in df.columns:
        classes = materialise(class_counts(df.where(held), target))
        few = classes.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
        if few["k"] > 1:
            each = max(1, budget // few["k"])
            # Groups are classes as text, one group for training rows and one for held-out rows without a class.
            group = F.when(~held, F.lit("t")).when(col(target).isNull(), F.lit("n")).otherwise(
                F.concat(F.lit("c"), col(target).cast("string")))
            wanted = classes.select(F.concat(F.lit("c"), F.col("group").cast("string")).alias("group"), F.lit(each).alias("wanted"))
            wanted = wanted.union(df.sparkSession.createDataFrame([("t", rows), ("n", each)], "group string, wanted int"))
            return mark_sample(df, group, wanted, seed, keys).where(CHOSEN).drop(CHOSEN)
    wanted.append((held, budget))
    return hash_sample(df, wanted, seed, keys)


def budget_sample_recent(df: DataFrame, rows: int, order_desc: list, user: str, target: str,
                         positive_label=1, seed: int = SEED, keys=None) -> DataFrame:
    """The latest ``rows`` training rows, and held-out rows grouped by positive users.

    ``order_desc`` lists (name, "desc") entries, latest first.
    """
    # Counted, cut and read several times: what made the table runs once.
    df = materialise(df)
    held = df.where(col(SPLIT) == HELD_OUT)
    train = df.where(~F.coalesce(col(SPLIT) == HELD_OUT, F.lit(False)))
    train = cut_at(train, order_desc, rows)[0]
    if held.count() <= rows:
        return train.unionByName(held)
    hit = col(target) == F.lit(positive_label)
    positives = held.where(hit)
    # One positive stands for about a hundred rows of its user (fixed value 101).
    chosen = hash_sample(positives, [(F.lit(True), max(1, rows // 101))], seed, keys)
    theirs = keyed_join(held, chosen.select(col(user)).where(col(user).isNotNull()).distinct(), [user], "left_semi")
    n = theirs.agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("p")).first()
    if n["n"] > rows:
        miss = ~F.coalesce(hit, F.lit(False))
        theirs = hash_sample(theirs, [(hit, n["p"]), (miss, max(0, rows - n["p"]))], seed, keys)
    return train.unionByName(theirs)
