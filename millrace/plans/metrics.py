"""Scores of predictions, and a downstream model fitted and scored on Spark."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import running_total
from ..functions.sizes import bounded_parts
from ..functions.values import col, number, numeric_columns
from ..operators.base import HELD_OUT, SPLIT
from ..session import materialise

# Probabilities are kept this far from 0 and 1 in the log loss (fixed value).
LOG_EDGE = 2.220446049250313e-16


def _scored(df, label, score):
    return df.select(number(df, label).alias("y"), number(df, score).alias("s")) \
        .where("y is not null and s is not null")


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: auc, logloss, accuracy, f1.

    Rows collapse to one per distinct score first; the ranking is a blocked running
    total, so neither many rows at one score nor many scores land in one task.
    """
    base = _scored(df, label, score)
    by_score = base.groupBy("s").agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("n"))
    run = running_total(by_score, ["s"], {"n": F.col("n")}, prefix="upto_")
    # A positive outranks the negatives below it, and half of those at its own score.
    wins = run.agg(F.sum(F.col("p") * (F.col("upto_n") - F.col("n") / 2.0)).alias("w"),
                   F.sum("p").alias("p"), F.sum("n").alias("n"))
    auc = wins.select(F.try_divide("w", F.col("p") * F.col("n")).alias("auc")).first()["auc"]
    q = F.least(F.greatest("s", F.lit(LOG_EDGE)), F.lit(1.0 - LOG_EDGE))
    hit = (F.col("s") >= threshold).cast("double")
    return base.agg(
        F.avg(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("logloss"),
        F.avg((hit == F.col("y")).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(2 * F.sum(hit * F.col("y")), F.sum(hit) + F.sum("y")), F.lit(0.0)).alias("f1")) \
        .select(F.lit(auc).cast("double").alias("auc"), "logloss", "accuracy", "f1")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: mse, rmse, mae, r2 (1 - residual over total sum of squares)."""
    error = F.col("y") - F.col("s")
    row = _scored(df, label, prediction).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop("y").alias("v"))
    return row.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                      (F.lit(1.0) - F.try_divide("mse", "v")).alias("r2"))


def best_f1_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (threshold, f1): the lowest score among those of largest f1, predicting s >= t."""
    base = _scored(df, label, score)
    by_score = base.groupBy("s").agg(F.sum("y").alias("p"), F.count("*").cast("double").alias("c"))
    run = materialise(running_total(by_score, [F.col("s").desc()], {"p": F.col("p"), "c": F.col("c")}, prefix="up_"))
    positives = run.agg(F.sum("p").alias("p")).first()["p"]
    scored = run.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("up_p"), F.col("up_c") + F.lit(positives).cast("double")), F.lit(0.0)))
    best = scored.agg(F.max_by(F.col("s"), F.struct(F.col("f1"), -F.col("s"))).alias("t"), F.max("f1").alias("f1"),
                      F.sum("p").alias("p"), F.sum("c").alias("n"))
    one_class = (F.col("p") == 0) | (F.col("p") == F.col("n"))
    return best.select(F.when(one_class, 0.5).otherwise(F.col("t")).alias("threshold"), "f1")


def positive_weight(df: DataFrame, label: str, cap: float = 100.0) -> DataFrame:
    """One row: negatives over positives, limited; missing unless both occur."""
    y = number(df, label)
    row = df.agg(F.count(F.when(y == 1, 1)).alias("p"), F.count(F.when(y == 0, 1)).alias("n"))
    return row.select(F.when((F.col("p") > 0) & (F.col("n") > 0),
                             F.least(F.col("n") / F.col("p"), F.lit(cap))).alias("pos_weight"))


def fit_and_score(df: DataFrame, target: str, task: str = "binary", drop=(), weight: str = "sample_weight",
                  rounds: int = 20, depth: int = 5) -> DataFrame:
    """Boosted trees fitted on training rows; metrics per other split.

    Features absent from a split, and missing values, count as 0.
    """
    gone = {target, weight, SPLIT, *drop}
    names = [n for n in numeric_columns(df) if n not in gone]
    w = F.coalesce(number(df, weight), F.lit(1.0)) if weight in df.columns else F.lit(1.0)
    ready = df.select(*[F.coalesce(number(df, n), F.lit(0.0)).alias(f"x{i}") for i, n in enumerate(names)],
                      number(df, target).alias("label"), w.alias("w"), col(SPLIT).alias("split"))
    ready = ready.where("label is not null")
    assembler = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features")
    data = assembler.transform(ready).select("features", "label", "w", "split")
    train = assembler.transform(bounded_parts(ready.where(F.col("split") == "train"))).select("features", "label", "w")
    if task == "binary":
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, weightCol="w", seed=42).fit(train)
        scored = model.transform(data).withColumn("s", vector_to_array("probability")[1])
    else:
        model = GBTRegressor(maxIter=rounds, maxDepth=depth, weightCol="w", seed=42).fit(train)
        scored = model.transform(data).withColumn("s", F.col("prediction"))
    out = None
    for split in ("val", HELD_OUT):
        part = scored.where(F.col("split") == split)
        if part.isEmpty():
            continue
        row = binary_metrics(part, "label", "s") if task == "binary" else regression_metrics(part, "label", "s")
        row = row.withColumn("split", F.lit(split))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no val or std_test rows to score")
    return out
