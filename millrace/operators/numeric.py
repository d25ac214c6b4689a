"""Scaling, power and quantile transforms, binning, clipping and row filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.values import any_true, as_list, col, number, numeric_columns, present, value
from ..session import materialise
from .base import Operator, choose
from .integration import CustomTransform

# Deviations and maxima below this count as zero (fixed value).
SMALL_SCALE = 1e-6

# Largest number of quantiles of the quantile transform, and its edge tolerance (fixed values).
QUANTILE_GRID = 1000
QUANTILE_EDGE = 1e-7


class ScaleFeature(Operator):
    """Standard, min-max, max-abs, robust or row-wise unit-length scaling."""

    fit_on_train = True

    def __init__(self, cols=None, method="standard", pattern=None, feature_range=(0.0, 1.0)):
        super().__init__()
        choose("method", method, ("standard", "minmax", "maxabs", "robust", "l2"))
        self.cols = None if cols is None else as_list(cols)
        self.method, self.pattern, self.feature_range = method, pattern, tuple(feature_range)
        self.names: list[str] = []
        self.params: dict[str, tuple] = {}

    def _fit(self, df):
        if self.cols is not None:
            self.names = present(df, self.cols)
        elif self.pattern is not None:
            self.names = [n for n in df.columns if self.pattern in n]
        if not self.names or self.method == "l2":
            return
        exprs = {n: number(df, n) for n in self.names}
        if self.method == "robust":
            for n, (q1, q2, q3) in exact_quantiles(df, exprs, [0.25, 0.5, 0.75]).items():
                spread = None if q1 is None else q3 - q1
                self.params[n] = (q2, spread if spread is not None and spread > 0 else 1.0)
            return
        pick = {"standard": lambda e: (F.avg(e), F.stddev_samp(e)), "minmax": lambda e: (F.min(e), F.max(e)),
                "maxabs": lambda e: (F.max(F.abs(e)), F.lit(None))}[self.method]
        aggs = []
        for i, e in enumerate(exprs.values()):
            first, second = pick(e)
            aggs += [first.alias(f"a{i}"), second.alias(f"b{i}")]
        row = df.agg(*aggs).first()
        self.params = {n: (row[f"a{i}"], row[f"b{i}"]) for i, n in enumerate(self.names)}

    def _apply(self, df):
        names = present(df, self.names)
        if not names:
            return df
        if self.method == "l2":
            filled = {n: F.coalesce(number(df, n), F.lit(0.0)) for n in names}
            norm = F.sqrt(sum([v * v for v in filled.values()], F.lit(0.0)))
            norm = F.when(norm == 0, 1.0).otherwise(norm)
            return df.withColumns({n: v / norm for n, v in filled.items()})
        return df.withColumns({n: self._scaled(number(df, n), *self.params[n]) for n in names})

    def _scaled(self, v, a, b):
        if a is None:
            return F.lit(None).cast("double")
        if self.method == "standard":
            return (v - F.lit(a)) / F.lit(b if b is not None and b >= SMALL_SCALE else 1.0)
        if self.method == "minmax":
            low, high = [float(x) for x in self.feature_range]
            return F.lit(low) if a == b else (v - F.lit(a)) / F.lit(b - a) * F.lit(high - low) + F.lit(low)
        if self.method == "maxabs":
            return v / F.lit(a if a >= SMALL_SCALE else 1.0)
        return (v - F.lit(a)) / F.lit(b)


class TransformPower(Operator):
    """Logarithm, square root, or rank transform to a uniform or normal shape."""

    fit_on_train = True

    def __init__(self, cols=None, method="log", offset=1.0, output_cols=None, output_distribution="uniform"):
        super().__init__()
        choose("method", method, ("log", "sqrt", "quantile"))
        self.cols = None if cols is None else as_list(cols)
        self.method, self.offset = method, float(offset)
        self.output_cols = None if output_cols is None else as_list(output_cols)
        self.output_distribution = output_distribution
        self.names: list[str] = []
        self.grids: dict[str, list] = {}

    def _fit(self, df):
        self.names = numeric_columns(df) if self.cols is None else present(df, self.cols)
        if self.method == "quantile" and self.names:
            n = min(QUANTILE_GRID, max(2, df.count()))
            exprs = {c: F.coalesce(number(df, c), F.lit(0.0)) for c in self.names}
            self.grids = exact_quantiles(df, exprs, [i / (n - 1) for i in range(n)])

    def _apply(self, df):
        names = present(df, self.names)
        if not names:
            return df
        if self.method == "quantile":
            return df.withColumns({n: rank_transform(self.grids[n], self.output_distribution)(
                F.coalesce(number(df, n), F.lit(0.0))) for n in names})
        out = {}
        for i, n in enumerate(names):
            x = number(df, n) + F.lit(self.offset)
            if self.method == "sqrt":
                made = F.sqrt(F.when(x < 0, 0.0).otherwise(x))
            else:
                # Zero maps to minus infinity; the built-in logarithm would give NULL.
                made = F.when(x == 0, F.lit(float("-inf"))).when(x > 0, F.ln(x))
            out[self.output_cols[i] if self.output_cols else n] = made
        return df.withColumns(out)


# Rational approximation of the inverse normal distribution by P. J. Acklam (fixed values; relative error below 1.2e-9).
INNER_TOP = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
             1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
INNER_BOTTOM = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
                6.680131188771972e+01, -1.328068155288572e+01, 1.0)
OUTER_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
             -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
OUTER_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
OUTER_BELOW = 0.02425


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile of probabilities between 0 and 1, whole arrays at a time."""
    q, tail = p - 0.5, np.minimum(p, 1 - p)
    inner = q * np.polyval(INNER_TOP, q * q) / np.polyval(INNER_BOTTOM, q * q)
    far = np.sqrt(-2 * np.log(tail))
    outer = np.polyval(OUTER_TOP, far) / np.polyval(OUTER_BOTTOM, far)
    return np.where(tail < OUTER_BELOW, np.where(q < 0, outer, -outer), inner)


def rank_transform(grid: list[float], shape: str):
    """Arrow UDF that places a value on the fitted quantile grid."""
    q = np.asarray(grid, dtype=float)
    ref = np.linspace(0.0, 1.0, len(q))
    normal = shape == "normal"

    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float)
        # Mean of the two one-sided positions: a run of equal values maps to its middle.
        at = 0.5 * (np.interp(v, q, ref) - np.interp(-v, -q[::-1], -ref[::-1]))
        if normal:
            at = np.where(v - QUANTILE_EDGE < q[0], 0.0, np.where(v + QUANTILE_EDGE > q[-1], 1.0, at))
            edge = QUANTILE_EDGE - np.spacing(1)
            return pd.Series(normal_quantile(np.clip(at, edge, 1 - edge)))
        return pd.Series(np.where(v == q[0], 0.0, np.where(v == q[-1], 1.0, at)))
    return place


class DiscretizeFeature(Operator):
    """Bin number = how many inner edges are at or below the value; missing is -1."""

    fit_on_train = True

    def __init__(self, cols=None, boundaries=None, n_bins=5, strategy="manual"):
        super().__init__()
        choose("strategy", strategy, ("manual", "uniform", "quantile", "kmeans"))
        self.boundaries = dict(boundaries or {})
        self.cols = as_list(cols) or list(self.boundaries)
        self.n_bins, self.strategy = int(n_bins), strategy
        self.output_col_types = {n: "categorical" for n in self.cols}
        self.edges: dict[str, list[float]] = {}

    def _fit(self, df):
        names = present(df, self.cols)
        exprs = {n: number(df, n) for n in names}
        inner = [i / self.n_bins for i in range(1, self.n_bins)]
        if self.strategy == "manual":
            self.edges = {n: [float(b) for b in self.boundaries.get(n, [])] for n in names}
        elif self.strategy == "quantile":
            found = exact_quantiles(df, exprs, inner) if inner else {n: [] for n in names}
            self.edges = {n: sorted({q for q in qs if q is not None}) for n, qs in found.items()}
        elif names:
            row = df.agg(*[F.min(e).alias(f"l{i}") for i, e in enumerate(exprs.values())],
                         *[F.max(e).alias(f"h{i}") for i, e in enumerate(exprs.values())]).first()
            for i, n in enumerate(names):
                low, high = row[f"l{i}"], row[f"h{i}"]
                uniform = [] if low is None else list(np.linspace(low, high, self.n_bins + 1))
                if self.strategy == "uniform" or not uniform:
                    self.edges[n] = [float(e) for e in uniform[1:-1]]
                else:
                    self.edges[n] = cluster_edges(df.select(exprs[n].alias("v")), uniform)

    def _apply(self, df):
        names = present(df, self.edges)
        return df.withColumns({n: F.when(number(df, n).isNull(), F.lit(-1)).otherwise(
            sum([F.when(number(df, n) >= F.lit(e), 1).otherwise(0) for e in self.edges[n]], F.lit(0))
        ).cast("bigint") for n in names}) if names else df


def cluster_edges(values: DataFrame, start: list[float], rounds: int = 300) -> list[float]:
    """Inner edges of a one-dimensional k-means, started from equal-width bins.

    Runs on value counts, so repeated values are summed before any round.  Raises if ``rounds`` are not enough.
    """
    counted = materialise(values.where("v is not null").groupBy("v").agg(F.count("*").alias("n")))
    moments = counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("s"),
                          F.sum(F.col("n") * F.col("v") * F.col("v")).alias("q")).first()
    variance = max(moments["q"] / moments["n"] - (moments["s"] / moments["n"]) ** 2, 0.0)
    tolerance = 1e-4 * variance
    centres = [(a + b) / 2 for a, b in zip(start[:-1], start[1:])]
    for _ in range(rounds):
        edges = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:])]
        bin_no = sum([F.when(F.col("v") > F.lit(float(e)), 1).otherwise(0) for e in edges], F.lit(0))
        sums = {r["b"]: r["s"] / r["n"] for r in counted.groupBy(bin_no.alias("b")).agg(
            F.sum(F.col("n") * F.col("v")).alias("s"), F.sum("n").alias("n")).collect()}
        moved = [sums.get(i, c) for i, c in enumerate(centres)]
        shift = sum((a - b) ** 2 for a, b in zip(moved, centres))
        centres = sorted(moved)
        if shift <= tolerance:
            break
    else:
        raise RuntimeError(f"bins have not settled after {rounds} rounds")
    return [float((a + b) / 2) for a, b in zip(centres[:-1], centres[1:])]


class ClipOutlier(Operator):
    """Limit values to training quantiles; missing stays missing."""

    fit_on_train = True

    def __init__(self, cols, lower_quantile=0.01, upper_quantile=0.99):
        super().__init__()
        self.cols = as_list(cols)
        self.lower_quantile, self.upper_quantile = float(lower_quantile), float(upper_quantile)
        self.bounds: dict[str, list] = {}

    def _fit(self, df):
        exprs = {n: number(df, n) for n in present(df, self.cols)}
        self.bounds = exact_quantiles(df, exprs, [self.lower_quantile, self.upper_quantile])

    def _apply(self, df):
        new = {}
        for n in present(df, self.bounds):
            low, high = self.bounds[n]
            v = number(df, n)
            new[n] = v if low is None else F.when(v < F.lit(low), low).when(v > F.lit(high), high).otherwise(v)
        return df.withColumns(new) if new else df


class FilterSample(Operator):
    """Keep rows that satisfy a Spark SQL predicate, or that lack gaps in ``subset``."""

    train_only = True

    def __init__(self, subset=None, query=None):
        super().__init__()
        self.subset, self.query = as_list(subset), query

    def _apply(self, df):
        if self.query is not None:
            return df.where(F.expr(self.query))
        names = present(df, self.subset) or ([] if self.subset else df.columns)
        return df.where(~any_true([value(df, n).isNull() for n in names]))


class CustomProcess(CustomTransform):
    """A callable, or dropping columns that are mostly missing in training."""

    fit_on_train = True

    def __init__(self, func=None, mode="code", threshold=0.8):
        super().__init__(func)
        choose("mode", mode, ("code", "drop_high_null"))
        self.mode, self.threshold = mode, float(threshold)
        self.dropped: list[str] = []

    def _fit(self, df):
        if self.func is None and self.mode == "drop_high_null":
            row = df.agg(*[F.avg(value(df, n).isNull().cast("double")).alias(f"r{i}")
                           for i, n in enumerate(df.columns)]).first()
            self.dropped = [n for i, n in enumerate(df.columns) if (row[f"r{i}"] or 0.0) > self.threshold]

    def _apply(self, df):
        if self.func is not None:
            return super()._apply(df)
        return df.select(*[col(n) for n in df.columns if n not in self.dropped])
