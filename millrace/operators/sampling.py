"""Negative sampling, core filtering, class balancing and augmentation."""

from __future__ import annotations

from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import keyed_join
from ..functions.neighbors import nearest
from ..functions.ordering import POSITION, group_running_sum, join_on_keys, order_columns, row_index
from ..functions.sampling import CHOSEN, beta_draws, class_counts, class_sizes, key_columns, key_draw, mark_sample, repeat_rows
from ..functions.values import (as_list, col, dtype_of, hash_index, hash_normal, hash_uniform, is_number,
                                number, numeric_columns, present, value)
from ..session import materialise
from .base import Operator, choose

SEED = 42


def is_time_name(name: str) -> bool:
    return "time" in name.lower() or "date" in name.lower()


def draw_unseen(draws: DataFrame, seen: DataFrame, items: DataFrame, user: str, item: str,
                seed: int, keys: list, n: int = 1, distinct: bool = False) -> DataFrame:
    """``n`` rows per row of ``draws``, each with an item (``__item__``) its user has no row with.

    ``seen`` and ``items`` list pairs and the pool once each; further columns of ``items`` come with a drawn item.
    Items get dense numbers; a draw counts only the free numbers of its user and is then shifted past the taken
    ones.  The shift is a running count over draws and taken numbers, so no per-user list exists and no draw is
    rejected.  Users with no free item lose their draws.  ``distinct`` draws without replacement.
    """
    pool = row_index(items.withColumnRenamed(item, "__item__"), ["__item__"], "__no__")
    size = pool.count()
    pairs = seen.select(col(user).alias("__user__"), col(item).alias("__item__"))
    pairs = keyed_join(pairs, pool.select("__item__", "__no__"), ["__item__"], "inner", stored=True).select("__user__", "__no__")
    ranked = materialise(group_running_sum(pairs, ["__user__"], ["__no__"], F.lit(1), "__rank__"))
    taken = ranked.groupBy("__user__").agg(F.count("*").alias("__taken__"))
    joined = keyed_join(draws.withColumn("__user__", col(user)), taken, ["__user__"])
    free = F.lit(size) - F.coalesce(F.col("__taken__"), F.lit(0))
    joined = joined.withColumn("__free__", free).where("__free__ > 0").withColumn(
        "__at__", F.explode(free_positions(seed, F.col("__free__"), keys, n, distinct))) \
        .drop("__taken__", "__free__")
    joined = materialise(joined.withColumn("__kind__", F.lit(1)))
    # Free items before the i-th taken one: number - i.  A draw passes all taken with that count <= draw.
    marks = ranked.select("__user__", (F.col("__no__") - (F.col("__rank__") - 1)).alias("__at__"),
                          F.lit(0).alias("__kind__"))
    placed = group_running_sum(joined.unionByName(marks, allowMissingColumns=True), ["__user__"], ["__at__", "__kind__"],
                               F.when(F.col("__kind__") == 0, 1).otherwise(0), "__passed__").where("__kind__ = 1")
    placed = materialise(placed.withColumn("__no__", F.col("__at__") + F.col("__passed__"))
                         .drop("__kind__", "__passed__", "__at__", "__user__"))
    return keyed_join(placed, pool, ["__no__"], "inner", stored=True).drop("__no__")


def free_positions(seed: int, free, keys: list, n: int, distinct: bool):
    """Array of ``n`` uniform positions below ``free``; without repeats if ``distinct``."""
    if not distinct or n == 1:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: hash_index(seed, free, *keys, j))

    def add(drawn, j):
        raw = hash_index(seed, free - j, *keys, j)
        moved = F.aggregate(drawn, raw, lambda x, a: F.when(a <= x, x + 1).otherwise(x))
        return F.array_sort(F.array_append(drawn, moved))
    turns = F.sequence(F.lit(0), F.least(F.lit(n), free.cast("int")) - 1)
    return F.aggregate(turns, F.array().cast("array<bigint>"), add)


class SampleNegative(Operator):
    """Add, per positive row, rows with items the user never had."""

    cross_row = True

    train_only = True

    def __init__(self, user_col="user_id", item_col="item_id", target_col="rating", n_negatives=1,
                 positive_label=1, negative_label=0, seed=SEED, key_cols=None, order_cols=None):
        super().__init__()
        if n_negatives < 0:
            raise ValueError("n_negatives must not be negative")
        self.user_col, self.item_col, self.target_col = user_col, item_col, target_col
        self.n_negatives, self.seed = int(n_negatives), int(seed)
        self.positive_label, self.negative_label = positive_label, negative_label
        self.key_cols, self.order_cols = as_list(key_cols), as_list(order_cols)

    def _apply(self, df):
        if self.n_negatives == 0:
            return df
        # Read by every step below, so made once.
        df = materialise(df)
        y, user, item = col(self.target_col), self.user_col, self.item_col
        odd = df.where(y.isNotNull() & ~y.isin(self.positive_label, self.negative_label)).limit(1)
        if not odd.isEmpty():
            raise ValueError(f"{self.target_col} must hold only the two labels")
        item_features = [n for n in df.columns if n.startswith("item_") and n not in (item, self.target_col)
                         and not n.endswith("_seq")]
        fixed = {user, item, self.target_col, "__split__", *item_features}
        zeroed = [n for n in numeric_columns(df) if n not in fixed and not n.startswith("user_")
                  and not n.endswith("_seq") and not is_time_name(n)]
        draws = df.where(y == F.lit(self.positive_label))
        known = df.where(value(df, item).isNotNull())
        seen = materialise(known.select(col(user), col(item)).distinct())
        items = seen.select(col(item)).distinct()
        if item_features:
            # An item's features are those of its first row; combined before the shuffle.
            order = self.order_cols or df.columns
            rank = Window.partitionBy(col(item)).orderBy(*order_columns(order))
            items = known.withColumn("__r__", F.row_number().over(rank)).where("__r__ = 1") \
                .select(col(item), *[col(n).alias(f"__f_{n}") for n in item_features])
        drawn = draw_unseen(draws, seen, items, user, item, self.seed,
                            key_columns(df, self.key_cols), self.n_negatives)
        new = {item: F.col("__item__"), self.target_col: F.lit(self.negative_label).cast(dtype_of(df, self.target_col)),
               **{n: F.lit(0).cast(dtype_of(df, n)) for n in zeroed}, **{n: col(f"__f_{n}") for n in item_features}}
        drawn = materialise(drawn.withColumns(new).select(*[col(n) for n in df.columns]))
        return df.unionByName(drawn)


class FilterKCore(Operator):
    """Keep users and items with at least ``k`` rows each, repeated until stable.

    Keys below ``k`` are peeled off, users and items in turn; a round only looks at the pairs of the keys that it
    removes and lowers the counts of their partners.  With ``max_rounds`` a table that is not stable by then raises.
    """

    cross_row = True

    train_only = True

    def __init__(self, user_col="user_id", item_col="item_id", k=5, max_rounds=None):
        super().__init__()
        self.user_col, self.item_col, self.k, self.max_rounds = user_col, item_col, int(k), max_rounds

    def _apply(self, df):
        keys = [n for n in (self.user_col, self.item_col) if n]
        if self.k <= 1 or not keys:
            return df
        known = df.where(reduce(lambda a, b: a & b, [value(df, n).isNotNull() for n in keys]))
        # Rows collapse to weighted key pairs once; rounds never touch the wide table.
        pairs = materialise(known.groupBy(*[col(n).alias(f"k{i}") for i, n in enumerate(keys)])
                            .agg(F.count("*").alias("w")))
        degrees = [materialise(pairs.groupBy(f"k{i}").agg(F.sum("w").alias("n"))) for i in range(len(keys))]
        # Rows are only removed from here on, so no key ever has more than at first.
        largest = [d.agg(F.max("n")).first()[0] or 0 for d in degrees]
        if len(keys) == 1:
            return keyed_join(known, degrees[0].where(F.col("n") >= self.k).select(F.col("k0").alias(keys[0])), keys, "left_semi", stored=True,
                              largest=largest[0])
        for turn in count(1):
            peeled = False
            for side in (0, 1):
                mine, other = f"k{side}", f"k{1 - side}"
                frontier = degrees[side].where(F.col("n") < self.k).select(mine)
                if frontier.isEmpty():
                    continue
                peeled = True
                # A key leaves once, and takes its rows from the degrees of its partners.
                lost = keyed_join(pairs, frontier, [mine], "left_semi", stored=True, largest=largest[side]).groupBy(other).agg(F.sum("w").alias("lost"))
                degrees[side] = degrees[side].where(F.col("n") >= self.k)
                degrees[1 - side] = materialise(join_on_keys(degrees[1 - side], lost, [other], "left").select(
                    other, (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n")))
            if not peeled:
                break
            if self.max_rounds is not None and turn >= self.max_rounds:
                raise RuntimeError(f"not stable after {self.max_rounds} rounds")
        for i, n in enumerate(keys):
            known = keyed_join(known, degrees[i].select(F.col(f"k{i}").alias(n)), [n], "left_semi", stored=True, largest=largest[i])
        return known


def numbered_vectors(df: DataFrame, names: list[str], order) -> DataFrame:
    """A durable copy with row positions and the feature vector (missing as 0)."""
    placed = row_index(df, order)
    return placed.withColumn("__vec__", F.array(*[F.coalesce(number(placed, n), F.lit(0.0)) for n in names]))


class Undersample(Operator):
    """Shrink larger classes at random, by Tomek links, or by edited neighbours."""

    cross_row = True

    train_only = True

    def __init__(self, target_col, method="random", n_neighbors=3, key_cols=None):
        super().__init__()
        choose("method", method, ("random", "tomek", "enn"))
        self.target_col, self.method, self.n_neighbors = target_col, method, int(n_neighbors)
        self.key_cols = as_list(key_cols)

    def _apply(self, df):
        if self.target_col not in df.columns:
            return df
        y = col(self.target_col)
        if self.method == "random":
            classes = materialise(class_counts(df, self.target_col))
            least = classes.agg(F.min("n")).first()[0]
            if least is None:
                return df
            wanted = classes.select("group", F.lit(least).alias("wanted"))
            return mark_sample(df, y, wanted, SEED, self.key_cols).where(CHOSEN).drop(CHOSEN)
        sizes = class_sizes(df, self.target_col)
        if not sizes:
            return df
        names = numeric_columns(df, exclude=[self.target_col])
        table = numbered_vectors(df, names, self.key_cols or df.columns)
        points = table.select(F.col(POSITION).alias("id"), F.col("__vec__").alias("vec"))
        label = table.select(F.col(POSITION).alias("n_id"), y.alias("n_y"))
        k = 1 if self.method == "tomek" else self.n_neighbors
        near = nearest(points, points, k, same_table=True)
        near = near.join(label, F.col("neighbor") == F.col("n_id"))
        own = table.select(F.col(POSITION).alias("id"), y.alias("y"))
        near = near.join(own, "id")
        minority = F.lit(min(sizes, key=lambda c: (sizes[c], str(c))))
        if self.method == "enn":
            drop = near.groupBy("id", "y").agg(F.min((F.col("n_y") == F.col("y")).cast("int")).alias("same")) \
                .where((F.col("same") == 0) & (F.col("y") != minority)).select("id")
        else:
            near = materialise(near.select("id", "neighbor", "y", "n_y"))
            back = near.select(F.col("id").alias("b_id"), F.col("neighbor").alias("b_nn"))
            drop = near.join(back, (F.col("neighbor") == F.col("b_id")) & (F.col("b_nn") == F.col("id"))) \
                .where((F.col("y") != F.col("n_y")) & (F.col("y") != minority)).select("id")
        return table.join(drop, F.col(POSITION) == F.col("id"), "left_anti").select(*[col(n) for n in df.columns])


class Oversample(Operator):
    """Grow smaller classes by redrawing rows, or by interpolating between neighbours."""

    cross_row = True

    train_only = True

    def __init__(self, target_col, method="random", n_neighbors=5, key_cols=None):
        super().__init__()
        choose("method", method, ("random", "smote", "adasyn"))
        self.target_col, self.method, self.n_neighbors = target_col, method, int(n_neighbors)
        self.key_cols = as_list(key_cols)

    def _apply(self, df):
        if self.target_col not in df.columns:
            return df
        classes = materialise(class_counts(df, self.target_col))
        most = classes.agg(F.max("n")).first()[0]
        if most is None:
            return df
        return self._redrawn(df, classes, most) if self.method == "random" else self._synthetic(df, classes, most)

    def _redrawn(self, df, classes, most):
        """The largest classes as they are; of every other, ``most`` draws of its rows.

        Rows are numbered by one sort over (class, keys) for all classes; slots are made from the class table and
        meet the row whose number they draw.
        """
        y = col(self.target_col)
        placed, classes = _numbered_by_class(df, self.target_col, classes, self.key_cols or df.columns)
        small = classes.where(F.col("n") < most)
        slots = repeat_rows(small.select("group", "n", "first", F.lit(most).alias("times")), F.col("times"), "slot") \
            .select((F.col("first") + draw_below(F.col("n"), F.col("group"), F.col("slot") - 1)).alias(POSITION))
        # The slots are the large side of the join, which the engine splits where many pick the same row.  They come from
        # a few rows, by which the engine would take them for small and gather them in the driver.
        drawn = slots.hint("merge").join(placed, POSITION).select(*[col(c) for c in df.columns])
        large = classes.where(F.col("n") == most).select(F.col("group").alias(self.target_col))
        return keyed_join(df.where(y.isNotNull()), large, [self.target_col], "left_semi").unionByName(drawn)

    def _synthetic(self, df, classes, most):
        """All rows, and for smaller classes new rows on the way from a row to a neighbour of its class."""
        target = self.target_col
        names = [n for n in df.columns if n != target]
        numbers = df.select(*[col(n) if n == target else F.coalesce(number(df, n), F.lit(0.0)).alias(n)
                              for n in df.columns])
        table, classes = _numbered_by_class(numbers, target, classes, self.key_cols or df.columns)
        table = table.withColumn("__vec__", F.array(*[F.coalesce(number(table, n), F.lit(0.0)) for n in names]))
        points = materialise(table.select(F.col(POSITION).alias("id"), F.col("__vec__").alias("vec"), col(target).alias("y")))
        small = materialise(classes.where(F.col("n") < most).withColumn("missing", F.lit(most) - F.col("n")))
        own = materialise(keyed_join(points.withColumnRenamed("y", "group").where("group is not null"),
                                     small.select("group", "first"), ["group"], "inner", stored=True))
        # One more coordinate keeps classes farther apart than any two rows of one class are.
        apart = 1.0 + 2.0 * len(names) * (own.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 0.0)
        spread = own.select("id", F.concat("vec", F.array(F.col("first") * F.lit(apart))).alias("vec"))
        close = materialise(nearest(spread, spread, self.n_neighbors, same_table=True).where(F.col("distance") < apart)
                            .select("id", "rank", "neighbor"))
        # Slots come from a few rows, by which the engine would take them for small and gather them in the driver.
        made = self._slots(points, own, small).hint("merge").join(close.groupBy("id").agg(F.max("rank").alias("k")), "id").withColumn(
            "rank", (draw_below(F.col("k"), F.lit("rank"), F.col("slot")) + 1).cast("int"))
        made = made.join(close, ["id", "rank"]).join(own.select("id", "vec", "group"), "id") \
            .join(own.select(F.col("id").alias("neighbor"), F.col("vec").alias("other")), "neighbor")
        step = key_draw(SEED, F.lit("step"), F.col("slot")).cast("double") / F.lit(float(1 << 60))
        mixed = made.withColumn("t", step).withColumn(
            "new", F.zip_with("vec", "other", lambda a, b: a + F.col("t") * (b - a)))
        return table.select(*[col(n) for n in df.columns]).unionByName(mixed.select(
            *[F.element_at("new", names.index(x) + 1).alias(x) if x != target
              else F.col("group").cast(dtype_of(df, target)).alias(target) for x in df.columns]))

    def _slots(self, points, own, small):
        """(slot, id): which row each synthetic row starts from; a slot's name is its class and a number."""
        if self.method == "smote":
            slots = repeat_rows(small.select("group", "n", "first", "missing"), F.col("missing"), "i")
            return slots.select(
                F.concat_ws(":", F.col("group").cast("string"), F.col("i") - 1).alias("slot"),
                (F.col("first") + draw_below(F.col("n"), F.col("group"), F.col("i") - 1)).alias("id"))
        labels = points.select(F.col("id").alias("neighbor"), F.col("y").alias("n_y"))
        every = points.select("id", "vec")
        around = nearest(own.select("id", "vec"), every, self.n_neighbors, same_table=True).join(labels, "neighbor")
        share = materialise(around.join(own.select("id", "group"), "id").groupBy("group", "id").agg(
            F.avg(F.coalesce((F.col("n_y") != F.col("group")).cast("double"), F.lit(1.0))).alias("w")))
        totals = materialise(small.select("group", "missing").join(share.groupBy("group").agg(F.sum("w").alias("total")), "group", "left"))
        alone = totals.where(F.coalesce("total", F.lit(0.0)) == 0).first()
        if alone is not None:
            raise ValueError(f"no row of class {alone['group']} has a neighbour of another class")
        quota = F.bround(F.col("w") / F.col("total") * F.col("missing")).cast("int")
        return repeat_rows(keyed_join(share, totals, ["group"], "inner", stored=True).select("id", quota.alias("g")), F.col("g"), "i") \
            .select(F.concat_ws(":", F.col("id"), F.col("i")).alias("slot"), "id")


def draw_below(size, *keys):
    """Whole number below ``size`` from the MD5 of the keys."""
    return F.pmod(key_draw(SEED, *keys), size)


def _numbered_by_class(df: DataFrame, target: str, classes: DataFrame, order) -> tuple[DataFrame, DataFrame]:
    """Rows with positions in one order of (class, ``order``), and the classes with the position of their first row."""
    placed = row_index(df, [col(target).asc_nulls_last(), *order])
    firsts = placed.where(col(target).isNotNull()).groupBy(col(target).alias("group")).agg(F.min(POSITION).alias("first"))
    return placed, materialise(join_on_keys(classes, firsts, ["group"]))


class AugmentMixup(Operator):
    """Append convex mixes of random row pairs; other columns are missing."""

    cross_row = True

    train_only = True

    def __init__(self, label_col, cols=None, alpha=0.2, n_samples=None, key_cols=None):
        super().__init__()
        self.label_col, self.alpha, self.n_samples = label_col, float(alpha), n_samples
        self.cols = None if cols is None else as_list(cols)
        self.key_cols = as_list(key_cols)

    def _apply(self, df):
        if self.label_col not in df.columns:
            return df
        names = numeric_columns(df) if self.cols is None else present(df, self.cols)
        names = [n for n in names if n != self.label_col]
        rows = df.count()
        if rows < 2 or not names:
            return df
        mixed_names = [*names, self.label_col]
        table = row_index(df.select(*[number(df, n).alias(n) for n in mixed_names],
                                    *[col(n) for n in self.key_cols if n not in mixed_names]),
                          self.key_cols or mixed_names)
        alpha = self.alpha

        @F.pandas_udf("double")
        def weight(ids: pd.Series) -> pd.Series:
            return pd.Series(beta_draws(ids.to_numpy(), alpha, SEED))

        n = int(self.n_samples or rows)
        pairs = df.sparkSession.range(n).select(
            "id", weight("id").alias("t"),
            hash_index(SEED, F.lit(rows), F.lit("first"), F.col("id")).alias("i"),
            hash_index(SEED, F.lit(rows), F.lit("second"), F.col("id")).alias("j"))
        first = table.select(F.col(POSITION).alias("i"), *[col(x).alias(f"a_{x}") for x in mixed_names])
        second = table.select(F.col(POSITION).alias("j"), *[col(x).alias(f"b_{x}") for x in mixed_names])

        def between(a, b):
            # Rounding of the two products may leave the range of a and b.
            mix = F.col("t") * a + (F.lit(1.0) - F.col("t")) * b
            return F.when(a.isNull() | b.isNull(), None).otherwise(F.least(F.greatest(mix, F.least(a, b)), F.greatest(a, b)))

        mixed = pairs.join(first, "i").join(second, "j").select(*[
            between(col(f"a_{x}"), col(f"b_{x}")).alias(x) for x in mixed_names])
        base = df.withColumns({x: number(df, x) for x in mixed_names})
        return base.unionByName(mixed, allowMissingColumns=True).select(*[col(x) for x in df.columns])


class AugmentNoise(Operator):
    """Append copies of all rows with noise on some numeric columns."""

    cross_row = True

    train_only = True

    def __init__(self, cols, noise_type="gaussian", noise_scale=0.01, n_copies=1, key_cols=None):
        super().__init__()
        choose("noise_type", noise_type, ("gaussian", "jitter"))
        self.cols, self.noise_type = as_list(cols), noise_type
        self.noise_scale, self.n_copies = float(noise_scale), int(n_copies)
        self.key_cols = as_list(key_cols)

    def _apply(self, df):
        names = present(df, self.cols)
        if not names or self.n_copies <= 0:
            return df
        row = df.agg(*[F.stddev_samp(number(df, n)).alias(f"s{i}") for i, n in enumerate(names)]).first()
        keys = [*key_columns(df, self.key_cols), F.col("__copy__")]
        copies = df.withColumn("__copy__", F.explode(F.sequence(F.lit(1), F.lit(self.n_copies))))
        noisy = {}
        for i, n in enumerate(names):
            scale = F.lit((row[f"s{i}"] or 1.0) * self.noise_scale)
            draw = hash_normal(SEED, F.lit(n), *keys) if self.noise_type == "gaussian" else \
                F.lit(2.0) * hash_uniform(SEED, F.lit(n), *keys) - F.lit(1.0)
            noisy[n] = F.coalesce(number(df, n), F.lit(0.0)) + draw * scale
        base = df.withColumns({n: value(df, n).cast("double") if is_number(dtype_of(df, n)) else number(df, n)
                               for n in names})
        return base.unionByName(copies.withColumns(noisy).drop("__copy__"))
