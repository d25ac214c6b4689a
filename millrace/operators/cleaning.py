"""Missing values, outliers, rule violations, duplicates, labels, typos and row weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import settings
from ..functions.fuzzy import TermIndex
from ..functions.imputation import iterative_rounds, knn_fill
from ..functions.joins import keyed_join
from ..functions.ordering import order_columns
from ..functions.quantiles import exact_quantiles, modes
from ..functions.values import (any_true, as_list, col, dtype_of, is_float, is_number, number,
                                numeric_columns, present, value)
from .base import Operator, choose
from .integration import TYPE_NAMES  # noqa: F401  (re-exported for callers that extend it)


def class_probabilities(df: DataFrame, pred_probs) -> Column | None:
    """Row-wise class probabilities as an array, or None when the columns are absent."""
    if isinstance(pred_probs, str) and pred_probs in df.columns:
        if isinstance(dtype_of(df, pred_probs), T.ArrayType):
            return F.transform(col(pred_probs), lambda p: F.nanvl(p.cast("double"), F.lit(None)))
        p = number(df, pred_probs)
        return F.array(F.lit(1.0) - p, p)
    if isinstance(pred_probs, (list, tuple)) and pred_probs and all(c in df.columns for c in pred_probs):
        return F.array(*[number(df, c) for c in pred_probs])
    return None


def best_class(probs: Column) -> Column:
    """Index of the first largest probability."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


class HandleMV(Operator):
    """Delete rows with gaps, mark sentinels as missing, or fill gaps."""

    fit_on_train = True

    def __init__(self, cols=None, method="median", action="impute", n_neighbors=5, max_iter=10,
                 fill_value=None, na_values=None, key_cols=None):
        super().__init__()
        choose("action", action, ("delete", "impute", "mark"))
        if action == "impute":
            choose("method", method, ("median", "mean", "mode", "constant", "knn", "iterative"))
        self.cols = None if cols is None else as_list(cols)
        self.method, self.action = method, action
        self.n_neighbors, self.max_iter = int(n_neighbors), int(max_iter)
        self.fill_value = 0 if fill_value is None and method == "constant" else fill_value
        self.na_values = as_list(na_values)
        self.key_cols = as_list(key_cols)
        self.train_only = action == "delete"
        self.chosen: list[str] = []
        self.fills: dict[str, object] = {}
        self.donors = None
        self.rounds = None

    def _unmarked(self, df: DataFrame, names) -> DataFrame:
        """Sentinels of the chosen columns become missing."""
        if not self.na_values:
            return df
        new = {}
        for n in present(df, names):
            dtype = dtype_of(df, n)
            same = [v for v in self.na_values if isinstance(v, str) == isinstance(dtype, T.StringType)]
            if is_number(dtype) or isinstance(dtype, T.StringType):
                if same:
                    new[n] = F.when(~col(n).isin(same), col(n))
        return df.withColumns(new) if new else df

    def _fit(self, df):
        if self.cols is not None:
            chosen = present(df, self.cols)
        elif self.action in ("mark", "delete"):
            chosen = list(df.columns)
        elif self.method in ("knn", "iterative"):
            chosen = numeric_columns(df)
        else:
            gaps = df.agg(*[F.count(F.when(value(df, n).isNull(), 1)).alias(f"g{i}")
                            for i, n in enumerate(df.columns)]).first()
            chosen = [n for i, n in enumerate(df.columns) if gaps[f"g{i}"]]
        self.chosen = chosen
        if self.action != "impute" or not chosen:
            return
        df = self._unmarked(df, chosen)
        if self.method in ("knn", "iterative"):
            self._fit_multivariate(df)
        else:
            self.fills = self._fit_simple(df)

    def _fit_simple(self, df):
        if self.method == "constant":
            return {n: self.fill_value for n in self.chosen}
        numeric = [n for n in self.chosen if is_number(dtype_of(df, n))]
        fills: dict[str, object] = {}
        if self.method == "median":
            fills = {n: q[0] for n, q in
                     exact_quantiles(df, {n: value(df, n) for n in numeric}, [0.5]).items()}
        elif self.method == "mean" and numeric:
            row = df.agg(*[F.avg(value(df, n)).alias(f"m{i}") for i, n in enumerate(numeric)]).first()
            fills = {n: row[f"m{i}"] for i, n in enumerate(numeric)}
        rest = [n for n in self.chosen if n not in fills]
        for n, v in modes(df, {n: value(df, n) for n in rest}).items():
            fills[n] = 0 if v is None else v
        return fills

    def _fit_multivariate(self, df):
        numeric = [n for n in self.chosen if is_number(dtype_of(df, n))]
        if numeric:
            seen = df.agg(*[F.count(value(df, n)).alias(f"c{i}") for i, n in enumerate(numeric)]).first()
            numeric = [n for i, n in enumerate(numeric) if seen[f"c{i}"]]
        self.chosen = numeric
        if not numeric:
            return
        if self.method == "knn":
            self.donors = df.select(*[number(df, n).alias(n) for n in numeric])
        else:
            self.rounds = iterative_rounds(df, numeric, self.max_iter)

    def _apply(self, df):
        df = self._unmarked(df, self.chosen)
        if self.action == "mark":
            return df
        if self.action == "delete":
            names = present(df, self.chosen)
            gaps = any_true([value(df, n).isNull() for n in names])
            return df.where(~gaps) if names else df
        names = present(df, self.chosen)
        if not names:
            return df
        if self.method == "knn":
            return knn_fill(df, self.donors, names, self.n_neighbors)
        if self.method == "iterative":
            return self.rounds.apply(df)
        return df.withColumns({n: self._filled(df, n) for n in names if self.fills.get(n) is not None})

    def _filled(self, df, n):
        fill, dtype = self.fills[n], dtype_of(df, n)
        if isinstance(dtype, T.StringType):
            return F.coalesce(col(n), F.lit(str(fill)))
        if is_number(dtype):
            whole = isinstance(fill, int) or float(fill).is_integer()
            kind = dtype.simpleString() if whole or is_float(dtype) else "double"
            return F.coalesce(value(df, n).cast(kind), F.lit(fill).cast(kind))
        return F.coalesce(col(n), F.lit(fill).cast(dtype))


class HandleOutlier(Operator):
    """Delete or repair values outside quartile or z-score bounds."""

    fit_on_train = True
    train_only = True

    def __init__(self, cols=None, method="iqr", threshold=3.0, action="delete",
                 repair_method="clip", flag_col=None):
        super().__init__()
        choose("method", method, ("iqr", "zscore"))
        choose("action", action, ("delete", "repair"))
        choose("repair_method", repair_method, ("clip", "set_missing"))
        self.cols = None if cols is None else as_list(cols)
        self.method, self.threshold, self.action = method, float(threshold), action
        self.repair_method, self.flag_col = repair_method, flag_col
        self.bounds: dict[str, tuple[float, float]] = {}

    def _fit(self, df):
        names = numeric_columns(df) if self.cols is None else present(df, self.cols)
        if not names:
            return
        exprs = {n: number(df, n) for n in names}
        spread = df.agg(
            *[F.avg(e).alias(f"mean{i}") for i, e in enumerate(exprs.values())],
            *[F.stddev_samp(e).alias(f"std{i}") for i, e in enumerate(exprs.values())],
            *[F.min(e).alias(f"min{i}") for i, e in enumerate(exprs.values())],
            *[F.max(e).alias(f"max{i}") for i, e in enumerate(exprs.values())]).first()
        quartiles = exact_quantiles(df, exprs, [0.25, 0.75]) if self.method == "iqr" else {}
        for i, n in enumerate(names):
            if spread[f"min{i}"] is None:
                continue
            if self.method == "zscore":
                std = spread[f"std{i}"] or 1.0
                mean = spread[f"mean{i}"]
                self.bounds[n] = (mean - self.threshold * std, mean + self.threshold * std)
            else:
                q1, q3 = quartiles[n]
                width = q3 - q1
                self.bounds[n] = (spread[f"min{i}"], spread[f"max{i}"]) if width == 0 else (
                    q1 - self.threshold * width, q3 + self.threshold * width)

    def _apply(self, df):
        names = [n for n in self.bounds if n in df.columns]
        outside = {n: F.coalesce((number(df, n) < self.bounds[n][0]) | (number(df, n) > self.bounds[n][1]),
                                 F.lit(False)) for n in names}
        if self.action == "delete":
            return df.where(~any_true(list(outside.values()))) if names else df
        new = {}
        for n in names:
            low, high = self.bounds[n]
            if self.repair_method == "clip":
                v = number(df, n)
                new[n] = F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v)
            else:
                new[n] = F.when(~outside[n], col(n))
        if self.flag_col:
            new[self.flag_col] = any_true(list(outside.values())).cast("int")
        return df.withColumns(new) if new else df


class HandleError(Operator):
    """Delete or repair values that break a rule."""

    train_only = True

    def __init__(self, cols=None, rule=None, min_value=None, max_value=None, allowed_values=None,
                 rules=None, action="delete", repair_method="set_missing"):
        super().__init__()
        if rule is not None:
            choose("rule", rule, ("numeric", "positive", "in_range", "not_in"))
        choose("action", action, ("repair", "delete"))
        choose("repair_method", repair_method, ("set_missing", "clip"))
        self.action, self.repair_method = action, repair_method
        self.default = {"rule": rule, "min": min_value, "max": max_value, "allowed_values": allowed_values}
        self.rules = as_list(rules) or [{"col": c, **self.default} for c in as_list(cols)]

    def _violates(self, df, spec):
        name, rule = spec["col"], spec.get("rule")
        low, high = spec.get("min"), spec.get("max")
        if rule is None:
            rule = "in_range" if low is not None or high is not None else self.default["rule"] or "in_range"
        raw = value(df, name)
        if rule == "not_in":
            allowed = spec.get("allowed_values", self.default["allowed_values"]) or []
            known = F.coalesce(raw.isin([a for a in allowed if a is not None]), F.lit(None in allowed))
            return ~known if allowed else F.lit(True)
        if rule == "numeric":
            return raw.isNotNull() & number(df, name).isNull()
        if rule == "positive":
            return F.coalesce(number(df, name), F.lit(0.0)) <= 0
        read, low, high = self._comparable(df, name, low, high)
        broken = raw.isNotNull() & read.isNull()
        if low is not None:
            broken = broken | (read < low)
        if high is not None:
            broken = broken | (read > high)
        return F.coalesce(broken, F.lit(False))

    @staticmethod
    def _comparable(df, name, low, high):
        """Values and bounds on one scale; text bounds mean dates."""
        if isinstance(low, str) or isinstance(high, str):
            dtype = dtype_of(df, name)
            read = col(name).try_cast("timestamp_ntz") if isinstance(dtype, T.StringType) \
                else col(name).cast("timestamp_ntz")
            return read, *[None if b is None else F.lit(str(b)).cast("timestamp_ntz") for b in (low, high)]
        return number(df, name), *[None if b is None else F.lit(float(b)) for b in (low, high)]

    def _repaired(self, df, spec, broken):
        name = spec["col"]
        method = spec.get("repair_method", self.repair_method)
        choose("repair_method", method, ("set_missing", "clip"))
        if method == "set_missing":
            return F.when(~broken, col(name))
        low, high = spec.get("min", self.default["min"]), spec.get("max", self.default["max"])
        if low is None and high is None:
            return col(name)
        read, low, high = self._comparable(df, name, low, high)
        out = read
        if low is not None:
            out = F.when(read < low, low).otherwise(out)
        if high is not None:
            out = F.when(read > high, high).otherwise(out)
        return out

    def _apply(self, df):
        columns, marks = df.columns, []
        for i, spec in enumerate(self.rules):
            if spec.get("col") not in df.columns:
                continue
            action = spec.get("action", self.action)
            choose("action", action, ("repair", "delete"))
            broken = self._violates(df, spec)
            if action == "delete":
                # Later repairs must not change what this rule saw.
                marks.append(f"__broken_{i}__")
                df = df.withColumn(marks[-1], broken)
            else:
                df = df.withColumn(spec["col"], self._repaired(df, spec, broken))
        if not marks:
            return df
        return df.where(~any_true([col(m) for m in marks])).select(*[col(n) for n in columns])


class HandleNonIID(Operator):
    """Score rows by distance from the bulk; delete or down-weight the far ones."""

    cross_row = True

    train_only = True

    def __init__(self, feature_cols=None, pred_probs=None, threshold=0.95, action="reweight"):
        super().__init__()
        choose("action", action, ("delete", "reweight"))
        self.feature_cols, self.pred_probs = feature_cols, pred_probs
        self.threshold, self.action = float(threshold), action

    def _score(self, df):
        names = numeric_columns(df) if self.feature_cols is None else present(df, self.feature_cols)
        parts = []
        if names:
            filled = [F.coalesce(number(df, n), F.lit(0.0)) for n in names]
            row = df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(filled)],
                         *[F.stddev_samp(e).alias(f"s{i}") for i, e in enumerate(filled)]).first()
            # One row has no deviation: its score is missing and it is never flagged.
            zs = [F.abs((e - F.lit(row[f"m{i}"])) / F.lit(
                row[f"s{i}"] if row[f"s{i}"] != 0 else 1.0).cast("double")) for i, e in enumerate(filled)]
            parts.append(sum(zs[1:], zs[0]) / F.lit(float(len(zs))))
        probs = class_probabilities(df, self.pred_probs)
        if probs is not None:
            parts.append(F.lit(1.0) - F.array_max(probs))
        return sum(parts[1:], parts[0]) / F.lit(float(len(parts))) if parts else F.lit(0.0)

    def _apply(self, df):
        score = self._score(df)
        cutoff = exact_quantiles(df, {"score": score}, [self.threshold])["score"][0]
        far = F.lit(False) if cutoff is None else F.coalesce(score >= F.lit(cutoff), F.lit(False))
        if self.action == "delete":
            return df.where(~far)
        return df.withColumn("sample_weight", F.when(far, 0.2).otherwise(1.0))


class ReweightUPG(Operator):
    """Give rows of badly predicted groups twice the weight."""

    cross_row = True

    train_only = True

    def __init__(self, cluster_col=None, feature_cols=None, pred_probs=None, label_col=None,
                 threshold=0.9, n_bins=5):
        super().__init__()
        self.cluster_col, self.feature_cols, self.pred_probs = cluster_col, feature_cols, pred_probs
        self.label_col, self.threshold, self.n_bins = label_col, float(threshold), int(n_bins)

    def _group(self, df):
        if self.cluster_col and self.cluster_col in df.columns:
            return value(df, self.cluster_col).cast("string")
        names = numeric_columns(df) if self.feature_cols is None else present(df, self.feature_cols)
        names = names[:2]
        if not names:
            return F.lit("all")
        parts = []
        for n in names:
            v = number(df, n)
            # Only whether fewer than n_bins distinct values exist matters.
            seen = df.select(v.alias("v")).where("v is not null").distinct().limit(self.n_bins).count()
            bins = min(self.n_bins, max(1, seen))
            edges = exact_quantiles(df, {n: v}, [i / bins for i in range(bins + 1)])[n]
            inner = sorted({e for e in edges if e is not None})[1:-1]
            bin_no = sum([F.when(v > e, 1).otherwise(0) for e in inner], F.lit(0))
            parts.append(F.when(v.isNotNull(), bin_no.cast("string")))
        return parts[0] if len(parts) == 1 else F.concat(parts[0], F.lit("|"), parts[1])

    def _error(self, df):
        probs = class_probabilities(df, self.pred_probs)
        if probs is None:
            return F.lit(0.0)
        if self.label_col in df.columns:
            label = F.coalesce(number(df, self.label_col), F.lit(-1.0)).cast("int")
            return (best_class(probs) != label).cast("double")
        return F.lit(1.0) - F.array_max(probs)

    def _apply(self, df):
        scored = df.withColumns({"__group__": self._group(df), "__error__": self._error(df)})
        means = scored.where("__group__ is not null").groupBy("__group__").agg(
            F.avg("__error__").alias("__mean__"))
        joined = keyed_join(scored, means, ["__group__"])
        cutoff = exact_quantiles(joined, {"m": F.col("__mean__")}, [self.threshold])["m"][0]
        bad = F.lit(False) if cutoff is None else F.coalesce(F.col("__mean__") >= F.lit(cutoff), F.lit(False))
        return joined.select(*[col(n) for n in df.columns if n != "sample_weight"],
                             F.when(bad, 2.0).otherwise(1.0).alias("sample_weight"))


class CorrectLabel(Operator):
    """Flag or flip labels that confident predictions contradict."""

    def __init__(self, label_col, pred_probs=None, strategy="flip", confidence_threshold=0.9):
        super().__init__()
        choose("strategy", strategy, ("flip", "flag"))
        self.label_col, self.pred_probs, self.strategy = label_col, pred_probs, strategy
        self.confidence_threshold = float(confidence_threshold)

    def _apply(self, df):
        if self.label_col not in df.columns:
            return df
        mark = f"{self.label_col}_corrected"
        probs = class_probabilities(df, self.pred_probs)
        if probs is None:
            return df.withColumn(mark, F.lit(0))
        label = number(df, self.label_col).cast("int")
        wrong = F.coalesce((best_class(probs) != label)
                           & (F.array_max(probs) >= F.lit(self.confidence_threshold)), F.lit(False))
        new = {mark: wrong.cast("int")}
        if self.strategy == "flip":
            new[self.label_col] = F.when(wrong, best_class(probs).cast(dtype_of(df, self.label_col))) \
                .otherwise(col(self.label_col))
        return df.withColumns(new)


class Deduplicate(Operator):
    """Keep one row, or none, of rows equal on ``subset``; missing equals missing.

    ``order_cols`` say which duplicate comes first; without them rows are ordered by all their columns, as tables
    have no row order.
    """

    cross_row = True

    train_only = True

    def __init__(self, subset=None, keep="first", order_cols=None):
        super().__init__()
        choose("keep", keep, ("first", "last", False))
        self.subset = None if subset is None else as_list(subset)
        self.keep, self.order_cols = keep, as_list(order_cols)

    def _apply(self, df):
        keys = self.subset or df.columns
        if self.keep is False:
            # Combined before the shuffle: a key held by most rows sends one row per task.
            rest = [n for n in df.columns if n not in keys]
            kept = df.groupBy(*[col(n) for n in keys]).agg(
                F.count("*").alias("__n__"), *[F.first(col(n)).alias(n) for n in rest])
            return kept.where("__n__ = 1").select(*[col(n) for n in df.columns])
        if self.subset is None or set(keys) == set(df.columns):
            return df.dropDuplicates()
        named = self.order_cols or [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        order = order_columns(named) if self.keep == "first" else [col(n).desc_nulls_first() for n in named]
        # Spark limits the rank inside each task before the shuffle, so hot keys stay small.
        window = Window.partitionBy(*[col(n) for n in keys]).orderBy(*order)
        return df.withColumn("__rank__", F.row_number().over(window)).where("__rank__ = 1").drop("__rank__")


class CorrectTypo(Operator):
    """Exact replacement map, then the closest vocabulary term if close enough."""

    def __init__(self, cols, mapping=None, vocabulary=None, threshold=90):
        super().__init__()
        self.cols, self.mapping = as_list(cols), dict(mapping or {})
        self.vocabulary, self.threshold = as_list(vocabulary), int(threshold)

    def _apply(self, df):
        for n in present(df, self.cols):
            df = self._corrected(df, n)
        return df

    def _corrected(self, df, n):
        spark, columns = df.sparkSession, df.columns
        if not self.vocabulary and len(self.mapping) <= settings.MAX_LITERAL_ENTRIES:
            if not self.mapping:
                return df
            table = F.create_map(*[F.lit(x) for pair in self.mapping.items() for x in pair])
            return df.withColumn(n, F.coalesce(F.try_element_at(table, col(n)), col(n)))
        # Each distinct value is corrected once, then attached by an ordinary join.
        values = df.select(col(n).alias("__raw__")).where(col("__raw__").isNotNull()).distinct()
        if self.mapping:
            pairs = spark.createDataFrame(
                [(str(k), str(v)) for k, v in self.mapping.items()], "__raw__ string, __mapped__ string")
            values = values.join(pairs, "__raw__", "left")
        else:
            values = values.withColumn("__mapped__", F.lit(None).cast("string"))
        vocabulary, threshold = [str(v) for v in self.vocabulary], self.threshold

        @F.pandas_udf("string")
        def closest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = TermIndex(vocabulary, threshold)
            for raw in parts:
                held = raw.notna().to_numpy()
                found = np.full(len(raw), None, object)
                found[held] = index.closest(raw[held].tolist())
                yield pd.Series(found, dtype=object)

        fixed = F.coalesce(col("__mapped__"), closest(F.when(col("__mapped__").isNull(), col("__raw__"))),
                           col("__raw__")) if vocabulary else F.coalesce(col("__mapped__"), col("__raw__"))
        values = values.select("__raw__", fixed.alias("__fixed__"))
        joined = keyed_join(df.withColumn("__raw__", col(n)), values, ["__raw__"])
        return joined.select(*[col("__fixed__").alias(n) if c == n else col(c) for c in columns])


class CustomClean(Operator):
    """Rule-based value replacement, or text replacement."""

    def __init__(self, mode="map_values", cols=None, rules=None, replace_with=None,
                 pattern=None, replacement="", regex=True):
        super().__init__()
        choose("mode", mode, ("map_values", "replace_text"))
        self.mode, self.cols, self.rules = mode, as_list(cols), as_list(rules)
        self.replace_with, self.pattern = replace_with, pattern
        self.replacement, self.regex = replacement, bool(regex)

    @staticmethod
    def _matches(current: Column, rule: dict) -> Column:
        tests = {
            "eq": lambda t: current == F.lit(t), "ne": lambda t: ~current.eqNullSafe(F.lit(t)),
            "lt": lambda t: current < F.lit(t), "le": lambda t: current <= F.lit(t),
            "gt": lambda t: current > F.lit(t), "ge": lambda t: current >= F.lit(t),
            "in": lambda t: current.isin(as_list(t)),
        }
        for name, test in tests.items():
            if name in rule:
                return F.coalesce(test(rule[name]), F.lit(False))
        return F.lit(False)

    def _apply(self, df):
        if self.mode == "replace_text":
            if self.pattern is None:
                return df
            return df.withColumns({n: self._replaced(df, n) for n in present(df, self.cols)})
        new: dict[str, Column] = {}
        for rule in self.rules:
            for n in present(df, [rule["col"]] if rule.get("col") is not None else self.cols):
                current = new.get(n, value(df, n))
                with_what = rule.get("replace_with", self.replace_with)
                new[n] = F.when(self._matches(current, rule), F.lit(with_what)).otherwise(current)
        return df.withColumns(new) if new else df

    def _replaced(self, df, n):
        text = value(df, n).cast("string")
        if self.regex:
            return F.regexp_replace(text, self.pattern, self.replacement)
        return F.replace(text, F.lit(self.pattern), F.lit(self.replacement))
