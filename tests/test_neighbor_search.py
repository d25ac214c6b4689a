"""The pivot tree of the neighbour search: exact on any data, few comparisons where data is clustered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import settings
from millrace.functions import imputation, neighbors


def clustered(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-100, 100, size=(max(2, n // 40), dims))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims))


def frame(spark, vectors, key="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{key} bigint, vec array<double>")


def compared(spark, n, block, depth=4):
    """Compared pairs of a search of all rows among themselves."""
    donors, queries = frame(spark, clustered(n, 1), "did"), frame(spark, clustered(n, 1), "qid")
    tree, placed = neighbors.PivotTree.grow(donors, block)
    located = tree.locate(queries, "qid")
    own = neighbors.compare_leaves(located.withColumn("bound", F.lit(float("inf"))), placed, depth, block)
    bounds = own.groupBy("qid").agg(F.max("distance").alias("bound"), F.count("*").alias("m"))
    bounded = located.join(bounds, "qid", "left").select(
        "qid", "vec", "leaf", F.when(F.col("m") >= depth, F.col("bound")).otherwise(F.lit(float("inf"))).alias("bound"))
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
    met = located.select("leaf").unionByName(tree.visits(bounded, depth).select("leaf"))
    return met.join(sizes, "leaf").agg(F.sum("n")).first()[0]


def test_comparisons_grow_far_below_the_square(spark):
    few, many = compared(spark, 1_000, 64), compared(spark, 8_000, 64)
    assert few < 1_000 * 1_000 / 5
    assert many < 16 * few and many < 8_000 * 8_000 / 40


@pytest.mark.parametrize("spread", ["clustered", "uniform", "line"])
def test_tree_search_equals_brute_force(spark, spread):
    rng = np.random.default_rng(2)
    donors = {"clustered": clustered(600, 3), "uniform": rng.uniform(size=(400, 12)),
              "line": np.repeat(2.0 ** np.arange(0, 40, 0.1)[:, None], 2, axis=1)}[spread]
    asked = np.concatenate([donors[:30], donors[:30] * 1.3 + 0.5, rng.normal(size=(10, donors.shape[1])) * 1e3])
    got: dict = {}
    for r in neighbors.nearest(frame(spark, asked), frame(spark, donors), 3, False, 16).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    for i, q in enumerate(asked):
        d = np.sqrt(neighbors.squared_distances(q[None, :], donors))[0]
        assert got[i] == np.lexsort((np.arange(len(d)), d))[:3].tolist()


def test_a_bounded_tree_leaves_larger_leaves_and_the_same_result(spark, monkeypatch):
    points = frame(spark, clustered(500, 5))
    want = sorted(map(tuple, neighbors.nearest(points, points, 3, True, 10_000).collect()))
    monkeypatch.setattr(settings, "NEIGHBOR_TREE_BYTES", 3_000)
    assert sorted(map(tuple, neighbors.nearest(points, points, 3, True, 8).collect())) == want


def test_points_of_a_tree_are_spread_over_tasks_and_lengths_of_one(spark):
    same = spark.createDataFrame([(i, []) for i in range(5)], "id bigint, vec array<double>")
    assert sorted((r["id"], r["neighbor"]) for r in neighbors.nearest(same, same, 1, True, 2).collect()) == [
        (0, 1), (1, 0), (2, 0), (3, 0), (4, 0)]


def gappy_rows(n, seed, dims=4):
    rng = np.random.default_rng(seed)
    x = np.round(clustered(n, seed, dims), 3)
    return [[None if rng.random() < 0.15 else float(v) for v in row] for row in x]


def plain_fill(data, row, c, k):
    near = []
    for d in data:
        shared = [(x - y) ** 2 for x, y in zip(row, d, strict=True) if x is not None and y is not None]
        if d[c] is not None and shared:
            near.append(((sum(shared) * len(row) / len(shared)) ** 0.5, d[c]))
    known = [d[c] for d in data if d[c] is not None]
    return np.mean([v for _, v in sorted(near)[:k]]) if near else np.mean(known)


@pytest.mark.parametrize("patterns", [256, 2])
def test_gaps_are_filled_as_by_comparing_with_all(spark, monkeypatch, patterns):
    monkeypatch.setattr(imputation.DonorBlocks, "PATTERNS", patterns)
    data = gappy_rows(400, 7) + [[1.0, None, None, 2.0]] * 30 + [[None] * 4]
    names = list("abcd")
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], "i int, a double, b double, c double, d double")
    got = {r["i"]: r for r in imputation.knn_fill(df, df.select(*names), names, 3, block_rows=24).collect()}
    assert len(got) == len(data)
    for i, row in enumerate(data):
        for c, n in enumerate(names):
            assert got[i][n] == (row[c] if row[c] is not None else pytest.approx(plain_fill(data, row, c, 3)))


def gap_comparisons(spark, n, block=64):
    """Pairs of rows with gaps and donors that meet."""
    data = gappy_rows(n, 1, 6)
    means = np.nanmean(np.array(data, float), axis=0).tolist()
    pool = spark.createDataFrame([(i, row) for i, row in enumerate(data)], "did bigint, vec array<double>")
    queries = pool.where(F.exists("vec", lambda x: x.isNull())).withColumnRenamed("did", "qid")
    met = []

    def counted(q, placed, k, block):
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"))
        met.append(q.join(sizes, "leaf").agg(F.sum("n")).first()[0])
        return original(q, placed, k, block)

    original = imputation._compare_gaps
    imputation._compare_gaps = counted
    try:
        imputation.gap_neighbours(queries, pool, means, 3, block)
    finally:
        imputation._compare_gaps = original
    return sum(met), queries.count() * n


def test_comparisons_of_rows_with_gaps_grow_below_the_square(spark):
    (few, all_few), (many, all_many) = gap_comparisons(spark, 500), gap_comparisons(spark, 4_000)
    assert many < all_many / 5 and many / few < 0.5 * all_many / all_few
