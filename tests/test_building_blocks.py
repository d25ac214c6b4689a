"""Distributed helpers: the path for oversized groups must equal the plain one."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from millrace import settings
from millrace.functions import imputation, joins, neighbors, ordering, quantiles, sampling
from millrace.functions.moments import cross_products
from millrace.functions.values import number


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; values repeat and miss."""
    rng = random.Random(1)
    data = [(i, "hot" if i % 2 else f"k{i % 7}" if i % 5 else None, rng.randrange(20),
             None if i % 11 == 0 else float(rng.randrange(50))) for i in range(400)]
    return spark.createDataFrame(data, "id bigint, g string, t int, v double").repartition(4)


def test_row_index_is_a_permutation_in_order(skewed):
    out = ordering.row_index(skewed, ["t", "id"]).orderBy(ordering.POSITION).collect()
    assert [r[ordering.POSITION] for r in out] == list(range(400))
    assert [(r.t, r.id) for r in out] == sorted((r.t, r.id) for r in out)


def test_row_index_of_empty_table(skewed):
    assert ordering.row_index(skewed.where("id < 0"), ["id"]).count() == 0


@pytest.mark.parametrize("limit", [5, 30, 10_000])
def test_window_in_blocks_equals_plain_window(skewed, rows, limit):
    def build(w):
        return {"lag2": F.lag("v", 2).over(w), "sum3": F.sum("v").over(w.rowsBetween(-3, -1))}
    plain = skewed.withColumns(build(Window.partitionBy("g").orderBy(F.col("t").asc_nulls_last(), "id")))
    assert rows(ordering.add_window_columns(skewed, ["g"], ["t", "id"], build, 3, limit)) == rows(plain)


def test_window_without_group(skewed, rows):
    def build(w):
        return {"lag1": F.lag("id", 1).over(w)}
    out = ordering.add_window_columns(skewed, [], ["id"], build, 1, 7)
    assert rows(out, "id", "lag1") == rows(skewed.select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("lag1")))


@pytest.mark.parametrize("limit", [4, 10_000])
def test_group_running_sum(skewed, rows, limit):
    out = ordering.group_running_sum(skewed, ["g"], ["t", "id"], F.col("t"), "run", limit)
    w = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(out) == rows(skewed.withColumn("run", F.sum("t").over(w)))


def test_running_total(skewed, rows):
    out = ordering.running_total(skewed, ["id"], {"t": F.col("t")}, "up_", block_rows=9)
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(out) == rows(skewed.withColumn("up_t", F.sum("t").over(w)))


@pytest.mark.parametrize("bracket", [1, 3, 1000])
def test_quantile_search_equals_numpy(spark, bracket):
    rng = random.Random(5)
    values = [7.0] * 300 + [rng.gauss(0, 100) for _ in range(500)] + [1e6, -1e6]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, {"v": F.col("v")}, probs, small=0, bracket=bracket)["v"]
    assert np.allclose(got, np.quantile(values, probs))
    assert np.allclose(quantiles.exact_quantiles(df, {"v": F.col("v")}, probs)["v"], np.quantile(values, probs))


def test_quantile_of_missing_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, {"v": F.col("v")}, [0.5]) == {"v": [None]}


@pytest.mark.parametrize("limit", [3, 10_000])
def test_grouped_median_of_hot_groups(skewed, limit):
    got = {r.g: (r.v, r.t) for r in quantiles.grouped_quantile(
        skewed, ["g"], {"v": F.col("v"), "t": F.col("t")}, 0.5, limit).collect()}
    data: dict = {}
    for r in skewed.collect():
        data.setdefault(r.g, []).append(r)
    for g, rs in data.items():
        assert got[g][0] == pytest.approx(statistics.median([r.v for r in rs if r.v is not None]))
        assert got[g][1] == pytest.approx(statistics.median([r.t for r in rs]))


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 10.0), ("b", 10.0), ("a", 2.0), (None, None)], "s string, x double")
    assert quantiles.modes(df, {"s": F.col("s"), "x": F.col("x")}) == {"s": "a", "x": 2.0}
    assert quantiles.modes(df.where("s is null"), {"s": F.col("s")}) == {"s": None}


@pytest.mark.parametrize("wanted", [0, 1, 37, 400, 999])
def test_hash_sample_size_and_repeatability(skewed, wanted, rows):
    a = sampling.hash_sample(skewed, [(F.lit(True), wanted)], 1, ["id"])
    b = sampling.hash_sample(skewed.repartition(3), [(F.lit(True), wanted)], 1, ["id"])
    assert a.count() == min(wanted, 400) and rows(a) == rows(b)


def test_hash_sample_of_identical_rows(spark):
    df = spark.range(50).select(F.lit(1).alias("x"))
    assert sampling.hash_sample(df, [(F.lit(True), 20)], 3).count() == 20


def test_beta_draws_look_like_beta():
    draws = sampling.beta_draws(np.arange(20_000), 2.0, 7)
    assert abs(draws.mean() - 0.5) < 0.01 and abs(draws.var() - 0.05) < 0.005
    assert ((draws >= 0) & (draws <= 1)).all()


def brute_neighbours(points, k):
    out = {}
    for i, p in points.items():
        near = sorted((round(float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum())), 12), j)
                      for j, q in points.items() if j != i)
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_equals_brute_force(spark, block):
    rng = random.Random(3)
    points = {i: [float(rng.randrange(6)), float(rng.randrange(6))] for i in range(80)}
    points.update({100 + i: [9.0, 9.0] for i in range(30)})  # copies of one point
    df = spark.createDataFrame(list(points.items()), "id bigint, vec array<double>")
    got: dict = {}
    for r in neighbors.nearest(df, df, 4, True, block).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    assert got == brute_neighbours(points, 4)


def test_nearest_with_fewer_donors_than_wanted(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id bigint, vec array<double>")
    assert sorted((r.id, r.neighbor) for r in neighbors.nearest(df, df, 5, True).collect()) == [(1, 2), (2, 1)]
    assert neighbors.nearest(df, df.where("id = 9"), 1, False).count() == 0


def test_knn_fill_equals_brute_force(spark):
    rng = random.Random(9)
    data = [[None if rng.random() < 0.2 else float(rng.randrange(100)) for _ in range(3)] for _ in range(60)]
    data += [[5.0, None, 7.0]] * 5
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, a double, b double, c double")
    donors = df.select("a", "b", "c")
    got = {r.i: (r.a, r.b, r.c) for r in imputation.knn_fill(df, donors, ["a", "b", "c"], 3, block_rows=7).collect()}
    for i, row in enumerate(data):
        for j in range(3):
            if row[j] is not None:
                assert got[i][j] == row[j]
                continue
            near = []
            for d in data:
                shared = [(x - y) ** 2 for x, y in zip(row, d) if x is not None and y is not None]
                if d[j] is not None and shared:
                    near.append(((sum(shared) * 3 / len(shared)) ** 0.5, d[j]))
            known = [d[j] for d in data if d[j] is not None]
            want = statistics.mean(v for _, v in sorted(near)[:3]) if near else statistics.mean(known)
            assert got[i][j] == pytest.approx(want)


def test_iterative_fill_recovers_a_linear_column(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), None if i % 9 == 0 else 3.0 * i - 2.0 * (i % 7) + 1)
                                for i in range(200)], "x double, y double, z double")
    out = imputation.iterative_rounds(df, ["x", "y", "z"], 5).apply(df)
    worst = out.agg(F.max(F.abs(F.col("z") - (3 * F.col("x") - 2 * F.col("y") + 1)))).first()[0]
    assert worst < 0.5


def test_cross_products(spark):
    x = np.random.default_rng(0).normal(size=(50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    n, sums, cross = cross_products(df, ["a", "b", "c"])
    assert n == 50 and np.allclose(sums, x.sum(0)) and np.allclose(cross, x.T @ x)


def test_number_rejects_text_that_is_not_a_number(spark):
    df = spark.createDataFrame([("1.5",), ("1d",), ("nan",), (" 2 ",), ("",), (None,), ("-.5e1",)], "s string")
    assert [r[0] for r in df.select(number(df, "s")).collect()] == [1.5, None, None, 2.0, None, None, -5.0]


@pytest.fixture(scope="module")
def hot_pair(spark):
    """Left and right tables where 'h' is large on the left, 'r' on the right, 'b' on both; keys may miss."""
    left = [(k, i) for i, k in enumerate(["h"] * 40 + ["b"] * 25 + ["r", "x", None, None, "y"])]
    right = [(k, i) for i, k in enumerate(["r"] * 30 + ["b"] * 25 + ["h", "h", "y", None])]
    return (spark.createDataFrame(left, "k string, a int"), spark.createDataFrame(right, "k string, b int"))


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("budget", [0, 200, 10**9])
def test_wide_join_equals_plain_join(hot_pair, rows, monkeypatch, how, budget):
    monkeypatch.setattr(settings, "BROADCAST_BYTES", budget)
    left, right = hot_pair
    plain = left.alias("l").join(right.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), how).select("l.k", "a", "b")
    assert rows(joins.wide_join(left, right, ["k"], how, limit=10), "k", "a", "b") == rows(plain)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("budget", [0, 10**9])
def test_keyed_join_equals_plain_join(hot_pair, rows, monkeypatch, how, budget):
    monkeypatch.setattr(settings, "BROADCAST_BYTES", budget)
    left, right = hot_pair
    one = right.groupBy("k").agg(F.max("b").alias("b")).where("k <> 'x' or k is null")
    plain = left.join(one.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), how).drop("k2")
    assert rows(joins.keyed_join(left, one, ["k"], how, limit=10)) == rows(plain)
