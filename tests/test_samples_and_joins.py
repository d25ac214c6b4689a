"""Samples from one marker, joins with hot keys on either side, default orders, many quantile ranks."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import operators as O
from millrace.functions import joins, quantiles, ranks, sampling
from millrace.functions.grouped import apply_groups, map_with_facts
from millrace.plans import splits as S


def test_stratified_holdout_keeps_every_row_with_repeated_keys(spark):
    df = spark.range(1000).select("id", (F.col("id") % 50).alias("k"), (F.col("id") % 3).alias("y"))
    train, held = S.stratified_holdout(df, "y", ["k"], 0.23)
    assert train.count() == 770 and held.count() == 230
    assert Counter(r["id"] for r in train.union(held).collect()) == Counter(range(1000))


def test_stratified_holdout_of_identical_rows(spark):
    df = spark.createDataFrame([("a",)] * 40 + [("b",)] * 10, "y string")
    train, held = S.stratified_holdout(df, "y", ["y"], 0.2)
    assert Counter(r["y"] for r in held.collect()) == {"a": 8, "b": 2} and train.count() == 40


def test_samples_from_many_classes(spark):
    df = spark.range(45_000).select("id", (F.col("id") % 15_000).alias("y"))
    wanted = sampling.class_counts(df, "y").select("group", F.lit(2).alias("wanted"))
    out = sampling.mark_sample(df, F.col("y"), wanted, 1, ["id"])
    assert out.count() == 45_000
    assert out.where(sampling.CHOSEN).groupBy("y").count().where("count <> 2").isEmpty()
    down = O.Undersample("y", key_cols=["id"]).transform(df.where("id < 40000"))
    assert down.groupBy("y").count().select("count").distinct().collect()[0][0] == 2


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5_000).select("id", (F.col("id") % 7).alias("y"))
    a, b = (O.Undersample("y", key_cols=["id"]).transform(d) for d in (df, df.repartition(5)))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_repeat_rows_spreads_large_numbers(spark):
    df = spark.createDataFrame([("a", 25), ("b", 0), ("c", 3), ("d", None)], "k string, n int")
    out = sampling.repeat_rows(df, F.col("n"), "i", rows_at_once=10)
    assert sorted((r["k"], r["i"]) for r in out.collect()) == [("a", i) for i in range(1, 26)] + [("c", i) for i in range(1, 4)]


@pytest.mark.parametrize("how", ["left", "inner", "right", "outer"])
def test_joins_split_hot_keys_on_either_side(spark, monkeypatch, how):
    monkeypatch.setattr(joins.settings, "BROADCAST_BYTES", 0)
    left = spark.createDataFrame([(i % 5 if i < 60 else 9, i) for i in range(200)] + [(None, 1)], "k int, a int")
    right = spark.createDataFrame([(j % 3 if j < 30 else 1, j) for j in range(80)] + [(None, 2), (77, 3)], "k int, b int")
    out = joins.wide_join(left, right, ["k"], how, limit=20)
    plain = left.alias("l").join(right.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), how).select(
        F.coalesce("l.k", "r.k").alias("k"), "a", "b")
    assert Counter(map(tuple, out.select("k", "a", "b").collect())) == Counter(map(tuple, plain.collect()))


def test_outer_join_keeps_missing_keys_apart(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "p"), (None, "q")], "k int, b string")
    out = O.JoinTable("key", b, "k", "outer").transform(a)
    assert sorted(map(str, ((r["a"], r["b"]) for r in out.collect()))) == sorted(map(str, [("x", None), ("y", None), (None, "p"), (None, "q")]))


def test_duplicates_without_an_order(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "z"), (None, "y")], "k int, v string")
    first = O.Deduplicate("k").transform(df)
    last = O.Deduplicate("k", keep="last").transform(df)
    assert {tuple(r) for r in first.collect()} == {(1, "a"), (2, "c"), (None, "y")}
    assert {tuple(r) for r in last.collect()} == {(1, "b"), (2, "c"), (None, "z")}


def test_many_ranks_by_one_sort(spark):
    df = spark.range(1, 20_001).select((F.col("id") % 1000).cast("double").alias("x"))
    grid = [i / 99 for i in range(100)]
    fast = quantiles.exact_quantiles(df, {"x": F.col("x")}, grid, small=10, bracket=100)["x"]
    exact = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in grid]))).first()[0]
    assert fast == pytest.approx(exact)


def test_loops_raise_when_they_run_out(spark):
    chain = spark.createDataFrame([(i, i + d) for i in range(30) for d in (0, 1)], "user_id int, item_id int")
    with pytest.raises(RuntimeError):
        O.FilterKCore(k=2, max_rounds=1).transform(chain.union(spark.createDataFrame([(99, 0)], "user_id int, item_id int")))
    with pytest.raises(ValueError):
        O.ReduceDimension(["a"], "kernel_pca")


def test_map_with_facts_sees_facts_of_the_whole_group(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    out = map_with_facts(df, ["g"], {"m": F.max("x")}, lambda pdf: pdf.assign(d=pdf["m"] - pdf["x"]), "g long, x double, m double, d double")
    assert all(r["d"] == (99.0, 97.0, 98.0)[r["g"]] - r["x"] for r in out.collect())


def test_vector_callable(spark):
    out = O.CreateFeature(["id"], "double", lambda x: x * 2, vectorized=True).transform(spark.range(5))
    assert [r["double"] for r in out.orderBy("id").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0]


def test_arff_header_of_the_first_file(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.arff").write_text("% note\n@relation r\n@attribute a numeric\n@attribute 'b c' {x,y}\n@data\n1,x\n?,y\n")
    from millrace.sources import readers

    out = readers.arff(spark, str(tmp_path))
    assert out.columns == ["a", "b c"] and out.count() == 4


def test_table_scope_deletes_its_tables(spark):
    import os

    from millrace.session import materialise, shared_folder, table_scope

    folder = shared_folder(spark).removeprefix("file:") + "/tables"
    kept = materialise(spark.range(3))
    before = set(os.listdir(folder))
    with table_scope(spark):
        inner = materialise(spark.range(5))
        assert inner.count() == 5 and set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before and kept.count() == 3


def test_whole_groups_arrive_in_order_and_in_batches(spark):
    """One group larger than a batch, missing keys, and a callable that stops reading early."""
    sizes = {"big": 2_500, "small": 7, None: 30}
    data = [(g, i, float(i % 10)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "g string, i long, x double").repartition(5)

    def running(batches):
        total, seen = 0.0, 0
        for batch in batches:
            seen += 1
            out = batch.assign(total=total + batch["x"].cumsum(), batch=seen)
            total = float(out["total"].iloc[-1])
            yield out

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    try:
        out = apply_groups(df, ["g"], ["i"], running, "g string, i long, x double, total double, batch int")
        got = {(r["g"], r["i"]): (r["total"], r["batch"]) for r in out.collect()}
        first = apply_groups(df, ["g"], [F.col("i").desc()], lambda parts: iter([next(iter(parts)).head(1)]), df.schema.simpleString()[7:-1])
        assert sorted((str(r["g"]), r["i"]) for r in first.collect()) == [("None", 29), ("big", 2_499), ("small", 6)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(data) and max(b for _, b in got.values()) > 4
    for g, n in sizes.items():
        total = 0.0
        for i in range(n):
            total += i % 10
            assert got[g, i][0] == total
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("order", [["a", "b"], [("a", "desc"), "b"], ["b", ("a", "desc")], ["s"], [("t", "desc"), "s", "a"]])
def test_cuts_at_a_position_are_filters(spark, order, monkeypatch):
    monkeypatch.setattr(ranks, "SPLITTERS", 3)
    monkeypatch.setattr(ranks, "FEW", 2)
    rng = random.Random(4)
    data = [(rng.choice([None, *range(6)]), rng.choice([None, float("nan"), 0.5, 1.5, -2.0]), rng.choice(["x", "y", "é", None]),
             datetime.datetime(2020, 1, 1 + rng.randrange(4)) if rng.random() < 0.9 else None, i) for i in range(300)]
    df = spark.createDataFrame(data, "a int, b double, s string, t timestamp, i int").repartition(4)
    names = [o if isinstance(o, str) else o[0] for o in order]
    keys = [F.col(o).asc_nulls_last() if isinstance(o, str) else F.col(o[0]).desc_nulls_last() for o in order]
    ranked = [r["i"] for r in df.orderBy(*keys).collect()]
    place = {r["i"]: str(tuple(r[n] for n in names)) for r in df.collect()}
    for position in (0, 1, 77, 150, 299, 300, 500):
        first, rest = (sorted(r["i"] for r in part.collect()) for part in ranks.cut_at(df, order, position))
        assert len(first) == min(position, 300) and sorted(first + rest) == list(range(300))
        # Apart from ties the rows are those of a full sort.
        assert sorted(place[i] for i in first) == sorted(place[i] for i in ranked[:position])


def test_positional_split_has_no_sort_of_the_table(spark):
    df = spark.range(2_000).select(F.col("id"), F.xxhash64("id").alias("h"), F.md5(F.col("id").cast("string")).alias("wide"))
    train, held = S.positional_tail(df, ["h", "id"])
    plan = train._jdf.queryExecution().executedPlan().toString() + held._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert train.count() == 1_600 and held.count() == 400
    assert train.agg(F.max("h")).first()[0] < held.agg(F.min("h")).first()[0]
