"""Choosing features by variance, univariate score, model weight or elimination."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.sizes import bounded_parts
from ..functions.values import as_list, col, number, numeric_columns, value
from .base import SPLIT, Operator, choose

# A target with at most this many values is treated as classes (fixed value).
CLASS_LIMIT = 20


class SelectFeature(Operator):
    fit_on_train = True

    def __init__(self, target_col=None, method="variance", k=100, threshold=0.0, score_func="f_classif",
                 n_features_to_select=20, estimator="tree", exclude_cols=None, step=1):
        super().__init__()
        choose("method", method, ("variance", "univariate", "rfe", "model"))
        choose("estimator", estimator, ("tree", "forest", "linear"))
        self.target_col, self.method, self.k, self.threshold = target_col, method, int(k), float(threshold)
        self.score_func, self.n_features_to_select = score_func, int(n_features_to_select)
        self.estimator, self.exclude_cols, self.step = estimator, as_list(exclude_cols), int(step)
        self.keep: list[str] = []
        self.scores: dict[str, float] = {}

    def _fit(self, df):
        guarded = {*self.exclude_cols, self.target_col, SPLIT}
        names = [n for n in numeric_columns(df) if n not in guarded]
        rest = [n for n in df.columns if n not in names]
        if self.method == "variance":
            row = df.agg(*[F.var_samp(value(df, n)).alias(f"v{i}") for i, n in enumerate(names)]).first() \
                if names else {}
            self.scores = {n: row[f"v{i}"] for i, n in enumerate(names)}
            drop = {n for n, v in self.scores.items() if v is not None and v <= self.threshold}
            self.keep = [n for n in df.columns if n not in drop]
            return
        if self.target_col not in df.columns or not names:
            self.keep = list(df.columns)
            return
        wanted = self.n_features_to_select if self.method == "rfe" else self.k
        wanted = min(max(1, wanted), len(names))
        filled = df.select(*[F.coalesce(number(df, n), F.lit(0.0)).alias(f"x{i}") for i, n in enumerate(names)],
                           value(df, self.target_col).alias("y"))
        if self.method == "univariate":
            scores = univariate_scores(filled, len(names), self.score_func)
            # Among equal scores the later column wins.
            ranked = sorted(range(len(names)), key=lambda i: (scores[i], i))[-wanted:]
            self.scores = dict(zip(names, scores))
            chosen = [names[i] for i in sorted(ranked)]
        elif self.method == "model":
            weights = self._weights(bounded_parts(filled), list(range(len(names))))
            chosen = [names[i] for i in sorted(weights, key=lambda i: (-weights[i], -i))[:wanted]]
        else:
            left = list(range(len(names)))
            filled = bounded_parts(filled).cache()
            while len(left) > wanted:
                weights = self._weights(filled, left)
                out = sorted(left, key=lambda i: (weights[i], i))[:min(self.step, len(left) - wanted)]
                left = [i for i in left if i not in out]
            filled.unpersist()
            chosen = [names[i] for i in left]
        self.keep = [*rest, *chosen]

    def _weights(self, filled, left):
        known = filled.where("y is not null")
        distinct = [r["y"] for r in known.select("y").distinct().limit(CLASS_LIMIT + 1).collect()]
        classify = len(distinct) <= CLASS_LIMIT
        if classify:
            code = sum([F.when(F.col("y") == F.lit(v), float(i)).otherwise(0.0)
                        for i, v in enumerate(sorted(distinct, key=str))], F.lit(0.0))
        else:
            code = F.col("y").cast("double")
        data = VectorAssembler(inputCols=[f"x{i}" for i in left], outputCol="features").transform(
            known.withColumn("label", code)).select("features", "label")
        if self.estimator in ("tree", "forest"):
            kind = RandomForestClassifier if classify else RandomForestRegressor
            found = kind(numTrees=50, seed=42).fit(data).featureImportances.toArray()
        elif classify:
            # Several classes: the mean absolute weight over classes.
            found = abs(LogisticRegression(maxIter=200).fit(data).coefficientMatrix.toArray()).mean(axis=0)
        else:
            found = abs(LinearRegression().fit(data).coefficients.toArray())
        return {i: float(w) for i, w in zip(left, found)}

    def _apply(self, df):
        kept = [n for n in self.keep if n in df.columns]
        if SPLIT in df.columns and SPLIT not in kept:
            kept.append(SPLIT)
        return df.select(*[col(n) for n in kept])


def univariate_scores(filled: DataFrame, width: int, score: str) -> list[float]:
    """Score of each ``x{i}`` against ``y``, from one aggregation."""
    xs = [f"x{i}" for i in range(width)]
    if score == "f_regression":
        y = F.col("y").cast("double")
        row = filled.where(y.isNotNull()).agg(F.count("*").alias("n"), *[F.corr(x, y).alias(x) for x in xs]).first()
        out = []
        for x in xs:
            r = row[x]
            if r is None or math.isnan(r):
                out.append(0.0)
            else:
                out.append(math.inf if r * r >= 1 else r * r / (1 - r * r) * (row["n"] - 2))
        return out
    known = filled.where("y is not null")
    if score == "chi2":
        sums = known.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(F.greatest(x, F.lit(0.0))).alias(x)
                                                                 for x in xs]).collect()
        rows = sum(r["n"] for r in sums)
        out = []
        for x in xs:
            total = sum(r[x] for r in sums)
            parts = [(r[x], r["n"] / rows * total) for r in sums]
            out.append(sum((o - e) ** 2 / e for o, e in parts) if total > 0 else -math.inf)
        return out
    stats = known.groupBy("y").agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m_{x}") for x in xs],
                                   *[F.var_pop(x).alias(f"v_{x}") for x in xs]).collect()
    rows, classes = sum(r["n"] for r in stats), len(stats)
    out = []
    for x in xs:
        mean = sum(r["n"] * r[f"m_{x}"] for r in stats) / rows
        between = sum(r["n"] * (r[f"m_{x}"] - mean) ** 2 for r in stats)
        within = sum(r["n"] * r[f"v_{x}"] for r in stats)
        if classes < 2 or rows <= classes or (within == 0 and between == 0):
            out.append(-math.inf)
        else:
            out.append(math.inf if within == 0 else (between / (classes - 1)) / (within / (rows - classes)))
    return out
