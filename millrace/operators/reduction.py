"""Projections of numeric columns, learned from cross products summed by Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.moments import cross_products
from ..functions.values import as_list, col, number, numeric_columns, present
from .base import SPLIT, Operator, choose

# Up to this many products a projection is written out as plain arithmetic.
PLAIN_TERMS = 400


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """Turn each column so that its entry of largest size is positive."""
    top = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def top_vectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and vectors of a symmetric matrix."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(values)[::-1][:k]
    return values[order], fix_signs(vectors[:, order])


class ReduceDimension(Operator):
    """Append principal, singular, discriminant or kernel components; missing counts as 0.

    The kernel projection maps every row to ``landmarks`` distinct rows chosen by hash and decomposes the mapped
    rows; the number has no default, as it decides the result.
    """

    fit_on_train = True

    def __init__(self, cols=None, method="pca", n_components=8, target_col=None, prefix=None,
                 kernel="rbf", landmarks=None):
        super().__init__()
        choose("method", method, ("pca", "svd", "kernel_pca", "lda"))
        choose("kernel", kernel, ("rbf", "linear"))
        self.cols = as_list(cols)
        self.method, self.n_components, self.target_col = method, int(n_components), target_col
        self.prefix, self.kernel, self.landmarks = prefix or f"{method}_", kernel, landmarks
        if method == "kernel_pca" and landmarks is None:
            raise ValueError("kernel_pca needs a number of landmarks")
        self.names: list[str] = []
        self.centre = self.weights = self.points = None

    def _fit(self, df):
        self.names = present(df, self.cols) if self.cols else [
            n for n in numeric_columns(df) if n not in (self.target_col, SPLIT)]
        if not self.names:
            return
        filled = df.select(*[F.coalesce(number(df, n), F.lit(0.0)).alias(f"x{i}")
                             for i, n in enumerate(self.names)],
                           *([col(self.target_col).alias("y")] if self.method == "lda" else []))
        xs = [f"x{i}" for i in range(len(self.names))]
        rough = filled.agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in xs]).first()
        k = min(self.n_components, len(xs), max(1, rough["n"]))
        shift = [rough[x] or 0.0 for x in xs]
        if self.method == "lda":
            self._fit_lda(filled, xs, k, shift)
        elif self.method == "kernel_pca":
            self._fit_kernel(filled, xs, min(self.n_components, max(1, rough["n"])))
        elif self.method == "pca":
            n, sums, cross = cross_products(filled, xs, shift)
            mean = sums / max(n, 1)
            self.weights = top_vectors(cross - n * np.outer(mean, mean), k)[1]
            self.centre = mean + np.array(shift)
        else:
            _, _, cross = cross_products(filled, xs)
            self.weights, self.centre = top_vectors(cross, k)[1], np.zeros(len(xs))

    def _fit_lda(self, filled, xs, k, shift):
        parts = cross_products(filled.where("y is not null"), xs, shift, by="y")
        total = sum(p[0] for p in parts.values())
        mean = sum(p[1] for p in parts.values()) / total
        within = sum(p[2] - np.outer(p[1], p[1]) / p[0] for p in parts.values()) / max(total - len(parts), 1)
        between = sum(p[0] * np.outer(p[1] / p[0] - mean, p[1] / p[0] - mean) for p in parts.values())
        k = min(k, max(1, len(parts) - 1))
        spread, basis = np.linalg.eigh(within)
        solid = spread > spread.max() * 1e-10
        white = basis[:, solid] / np.sqrt(spread[solid])
        directions = top_vectors(white.T @ between @ white, k)[1]
        self.weights, self.centre = fix_signs(white @ directions), mean + np.array(shift)

    def _fit_kernel(self, filled, xs, k):
        vec = F.array(*[F.col(x) for x in xs])
        rows = filled.select(vec.alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(int(self.landmarks)).collect()
        points = np.array([r["v"] for r in rows], dtype=float)
        values, basis = np.linalg.eigh(self._kernel(points, points))
        solid = values > max(values.max(), 0.0) * 1e-10
        self.points, self.root = points, basis[:, solid] / np.sqrt(values[solid])
        # Every row takes part: its landmark features are made, centred and decomposed in the tasks.
        kernel, root = self._kernel, self.root
        width = root.shape[1]
        n, sums, cross = cross_products(filled, xs, mapped=lambda x: kernel(x, points) @ root)
        mean = sums / max(n, 1)
        self.weights = top_vectors(cross - n * np.outer(mean, mean), min(k, width))[1]
        self.centre = mean

    def _kernel(self, a, b):
        if self.kernel == "linear":
            return a @ b.T
        gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(-np.clip(gap, 0.0, None) / a.shape[1])

    def _projected(self):
        """The projection of a row's landmark features, batch by batch."""
        kernel, points, root, centre, weights = self._kernel, self.points, self.root, self.centre, self.weights

        @F.pandas_udf(", ".join(f"c{j} double" for j in range(weights.shape[1])))
        def landmark_features(x: pd.DataFrame) -> pd.DataFrame:
            found = (kernel(x.to_numpy(dtype=float), points) @ root - centre) @ weights
            return pd.DataFrame(found, columns=[f"c{j}" for j in range(weights.shape[1])])
        return landmark_features

    def _apply(self, df):
        if self.weights is None:
            return df
        values: list[Column] = [F.coalesce(number(df, n), F.lit(0.0)) for n in self.names]
        columns, k = df.columns, self.weights.shape[1]
        names = [f"{self.prefix}{j}" for j in range(k)]
        if self.method == "kernel_pca":
            df = df.withColumn("__x__", self._projected()(F.struct(*[v.alias(f"x{i}") for i, v in enumerate(values)])))
            return df.select(*[col(n) for n in columns], *[F.col(f"__x__.c{j}").alias(n) for j, n in enumerate(names)])
        if len(values) * k <= PLAIN_TERMS:
            return df.select(*[col(n) for n in columns], *[
                sum([(v - F.lit(float(c))) * F.lit(float(w)) for v, c, w in zip(values, self.centre, self.weights[:, j])],
                    F.lit(0.0)).alias(n) for j, n in enumerate(names)])
        df = df.withColumn("__x__", F.array(*values))
        # One dot product per component over the array, instead of a term per column.
        centre = F.array(*[F.lit(float(c)) for c in self.centre])
        df = df.withColumn("__x__", F.zip_with("__x__", centre, lambda a, b: a - b))
        made = []
        for j in range(k):
            w = F.array(*[F.lit(float(x)) for x in self.weights[:, j]])
            dot = F.aggregate(F.zip_with("__x__", w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
            made.append(dot.alias(names[j]))
        return df.select(*[col(n) for n in columns], *made)
