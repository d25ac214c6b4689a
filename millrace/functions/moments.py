"""Sums and cross products of many numeric columns in one distributed pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .values import col


# Up to this many columns the products are summed by plain aggregates.
PLAIN_COLUMNS = 12


def cross_products(df: DataFrame, names: list[str], shift: list[float] | None = None,
                   by: str | None = None, mapped: Callable[[np.ndarray], np.ndarray] | None = None):
    """(n, sums, cross products) of the columns minus ``shift``; missing counts as 0.

    Few columns are summed by plain aggregates.  Otherwise each task reduces its rows to one small matrix
    and Spark adds the matrices; ``mapped`` turns a block of rows into the columns to sum, inside the task.
    With ``by`` the result is a dict per value of that column.
    """
    width = len(names)
    offset = np.zeros(width) if shift is None else np.asarray(shift, dtype=float)
    label = F.lit(0) if by is None else col(by)
    values = [F.coalesce(col(n).cast("double"), F.lit(0.0)) for n in names]
    if mapped is None and width <= PLAIN_COLUMNS:
        out = _plain_products(df, label, values, offset)
    else:
        out = _matrix_products(df, label, values, offset, mapped, by is None)
    split = {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in out.items()}
    if by is not None:
        return split
    return split.get(0, (0.0, np.zeros(width), np.zeros((width, width))))


def _plain_products(df, label, values, offset) -> dict:
    moved = [(v - F.lit(float(o))).alias(f"x{i}") for i, (v, o) in enumerate(zip(values, offset))]
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1)]
    rows = df.select(label.alias("label"), *moved).groupBy("label").agg(
        F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(len(values))],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        m = np.zeros((len(values) + 1, len(values) + 1))
        m[0, 0] = r["n"]
        m[0, 1:] = m[1:, 0] = [r[f"s{i}"] for i in range(len(values))]
        for i, j in pairs:
            m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"p{i}_{j}"]
        out[r["label"]] = m
    return out


def _matrix_products(df, label, values, offset, mapped, single) -> dict:
    narrow = df.select(label.alias("label"), *[v.alias(f"x{i}") for i, v in enumerate(values)])
    kind, xs = narrow.schema["label"].dataType.simpleString(), narrow.columns[1:]

    def reduce_batches(batches):
        totals: dict = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = pdf[xs].to_numpy(dtype=float) - offset
            if mapped is not None:
                x = mapped(x)
            x = np.hstack([np.ones((len(x), 1)), x])
            labels = pdf["label"].to_numpy()
            for value in pd.unique(labels):
                part = x if single else x[labels == value]
                totals[value] = totals.get(value, 0.0) + part.T @ part
        for value, matrix in totals.items():
            yield pd.DataFrame({"label": [value] * len(matrix), "a": range(len(matrix)),
                                "row": [list(r) for r in matrix]})

    parts = narrow.mapInPandas(reduce_batches, f"label {kind}, a int, row array<double>")
    summed = parts.select("label", "a", F.posexplode("row").alias("b", "v")) \
        .groupBy("label", "a", "b").agg(F.sum("v").alias("v")).collect()
    # (columns + 1) squared numbers per label.
    size = max((r["a"] for r in summed), default=0) + 1
    out: dict = {}
    for r in summed:
        out.setdefault(r["label"], np.zeros((size, size)))[r["a"], r["b"]] = r["v"]
    return out
