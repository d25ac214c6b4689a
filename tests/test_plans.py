"""Recipes, splits, dataset jobs, inputs, metrics, sources and streams."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace import operators as O, session, sources as S
from millrace.plans import datasets as D, inputs as I, metrics as M, splits
from millrace.plans.recipe import Recipe, RecipeError, apply_with_split
from millrace.streaming import panel as L


def spec(ops, sources=({"id": "s0", "table": "t"},), end="o1"):
    return {"dag": {"sources": list(sources), "ops": ops, "train": {"prev": [end]}}}


STEP = {"id": "o1", "op": "DropColumns", "prev": ["s0"], "params": {"cols": ["x"]}}


@pytest.mark.parametrize("bad", [
    {}, spec([]), spec([STEP, STEP]), spec([{**STEP, "prev": ["s9"]}]), spec([{**STEP, "prev": []}]),
    spec([STEP, {**STEP, "id": "o2"}]), spec([{**STEP, "prev": ["o1"]}]), spec([STEP], end="o7"),
    spec([STEP], sources=[{"id": "s0", "table": "t"}, {"id": "s1", "table": "u"}]), spec([STEP], sources=[]),
    {"dag": {"sources": [{"id": "s0", "table": "t"}], "ops": [STEP], "train": {"prev": ["o1", "s0"]}}},
    spec([{**STEP, "id": "train"}]),
])
def test_bad_recipes_are_rejected(bad):
    with pytest.raises(RecipeError):
        Recipe.from_spec(bad)


def test_recipe_runs_and_resolves_tables(spark, rows):
    t = spark.createDataFrame([(1, 2), (2, 3)], "k int, x int")
    u = spark.createDataFrame([(1, "a")], "k int, n string")
    ops = [{"id": "o1", "op": "JoinTable", "prev": ["s0"], "params": {"aux_df": "$u", "key_col": "k"}}]
    assert rows(Recipe.from_spec(spec(ops)).run({"t": t, "u": u})) == [(1, 2, "a"), (2, 3, None)]
    with pytest.raises(RecipeError):
        Recipe.from_spec(spec(ops)).run({"t": t})
    with pytest.raises(RecipeError):
        Recipe.from_spec(spec([{**STEP, "op": "Operator9"}])).run({"t": t})
    with pytest.raises(RecipeError):
        Recipe.from_spec(spec([{**STEP, "prev": ["s0", "s0"]}])).run({"t": t})


@pytest.fixture
def marked(spark):
    return spark.createDataFrame([(i, float(i), "train" if i < 8 else "std_test") for i in range(10)],
                                 "i int, x double, __split__ string")


@pytest.mark.parametrize("step", [
    lambda: O.HandleOutlier("x", threshold=0.1), lambda: O.FilterSample(query="x < 2"), lambda: O.Deduplicate("x", False),
    lambda: O.HandleError("x", "in_range", max_value=1), lambda: O.AugmentNoise("x"), lambda: O.HandleMV("x", action="delete")])
def test_train_only_steps_leave_held_out_rows(marked, rows, step):
    out = apply_with_split(step(), marked)
    assert rows(out.where("__split__ = 'std_test'"), "i", "x") == [(8, 8.0), (9, 9.0)]


def test_statistics_ignore_held_out_rows(marked, rows):
    changed = marked.withColumn("x", F.when(F.col("__split__") == "std_test", F.col("x") * 1000).otherwise(F.col("x")))
    for step in (lambda: O.ScaleFeature("x"), lambda: O.ClipOutlier("x"), lambda: O.DiscretizeFeature("x", strategy="quantile")):
        a, b = apply_with_split(step(), marked), apply_with_split(step(), changed)
        assert rows(a.where("__split__ = 'train'")) == rows(b.where("__split__ = 'train'"))


def test_stacking_runs_per_split(spark, marked):
    extra = spark.createDataFrame([(99, 0.0)], "i int, x double")
    out = apply_with_split(O.ConcatTable(extra), marked)
    assert out.where("i = 99").count() == 2


def test_stratified_parts(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    train, held = splits.stratified_holdout(df, "y", ["id"])
    assert train.count() == 82 and held.count() == 21 and train.join(held, "id").count() == 0
    assert {r.y: r.n for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 14, 1: 7}


def test_chronological_cut_and_missing_times(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(20)] + [(99, None)], "i int, t int")
    train, held, cut = splits.chronological_tail(df, "t")
    assert cut == 8 and train.count() == 16 and held.count() == 5


def test_holdout_negatives_are_distinct_and_unseen(spark):
    train = spark.createDataFrame([(1, i) for i in range(6)] + [(2, i) for i in range(10)], "user_id int, item_id int")
    held = spark.createDataFrame([(1, 7), (2, 3), (5, 0)], "user_id int, item_id int")
    out = splits.holdout_negatives(held, train, n=3)
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    assert 2 not in got and sorted(got[1]) == [6, 8, 9]
    assert len(set(got[5])) == 3 and 0 not in got[5]


def test_budget_keeps_classes(marked):
    df = marked.withColumn("y", F.col("i") % 2)
    out = splits.budget_sample(df, 4, "y", keys=["i"])
    assert out.where("__split__ = 'train'").count() == 4 and out.where("__split__ = 'std_test'").count() == 2


def test_latest_and_labels(spark, rows):
    df = spark.createDataFrame([(1, 5, "x"), (1, 9, "y"), (2, 1, "z")], "k int, t int, s string")
    assert rows(D.latest_per_key(df, "k", "t")) == [(1, 9, "y"), (2, 1, "z")]
    with pytest.raises(ValueError):
        D.binary_label(df, "t", mode="passthrough")


def test_windows_pad_and_block(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(7)], "e int, t int, v double")
    for limit in (3, 1000):
        out = I.sliding_windows(df, ["v"], 3, "e", ["t"], limit=limit).orderBy("t").collect()
        assert [[x[0] for x in r.window] for r in out][:3] == [[0, 0, 0], [0, 0, 1], [0, 1, 2]]


def test_metrics_by_definition(spark):
    rng = random.Random(8)
    data = [(rng.randrange(2), rng.randrange(10) / 10) for _ in range(200)]
    df = spark.createDataFrame(data, "y int, s double")
    row = M.binary_metrics(df, "y", "s").first()
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    pairs = [(p > n) + 0.5 * (p == n) for p in pos for n in neg]
    assert row.auc == pytest.approx(sum(pairs) / len(pairs))
    best = M.best_f1_threshold(df, "y", "s").first()

    def f1(t):
        hit = sum(y for y, s in data if s >= t)
        return 2 * hit / (sum(s >= t for _, s in data) + len(pos))
    want = max(sorted({s for _, s in data}), key=lambda t: (f1(t), -t))
    assert best.threshold == pytest.approx(want) and best.f1 == pytest.approx(f1(want))
    assert M.best_f1_threshold(df.where("y = 1"), "y", "s").first().threshold == 0.5
    assert M.positive_weight(df.where("y = 1"), "y").first().pos_weight is None


def test_arff_and_lists(spark, tmp_path, rows):
    (tmp_path / "a.arff").write_text("@relation r\n@attribute x numeric\n@ATTRIBUTE 'the class' {0,1}\n@data\n1.5,b'1'\n?,0\n\n% end\n")
    df = S.arff(spark, str(tmp_path / "a.arff"))
    assert df.columns == ["x", "the class"] and rows(df) == [(1.5, "1"), (None, "0")]
    one = spark.createDataFrame([("[1, 2]",), ("x",), (None,)], "s string")
    assert [r[0] for r in one.select(S.parse_list(F.col("s"))).collect()] == [[1, 2], [], []]


def test_streams_reject_steps_that_need_other_rows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stream = L.event_stream(spark, f"{sf}/events.parquet", e.schema, "ts")
    with pytest.raises(ValueError):
        L.apply_fitted(stream, [O.CreateLagFeature("value", 1, ["user_id"], "ts")])
    with pytest.raises(ValueError):
        L.apply_fitted(stream, [O.ScaleFeature("value")])


def test_closed_windows_in_append_mode(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    e.write.parquet(folder)
    out = L.hourly_stream(L.event_stream(spark, folder, e.schema, "ts"), "user_id", "ts", {"value": ["sum"]}, "n")
    query = out.writeStream.outputMode("append").format("memory").queryName("closed").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = D.hourly_panel(e, "user_id", "ts", {"value": ["sum"]}, "n")
    missing = batch.select("user_id", "_hour_ts", "n").exceptAll(spark.table("closed").select("user_id", "_hour_ts", "n"))
    assert missing.count() < 10 and missing.agg(F.min("_hour_ts")).first()[0] >= e.agg(F.max("ts")).first()[0] - \
        __import__("datetime").timedelta(hours=3)


def test_panel_batches_touch_their_days_and_state_ends(spark, tmp_path):
    """Arrivals in order, one that is late within the delay and one beyond it, and a batch that is run again."""
    start = datetime.datetime(2024, 1, 1)
    schema = "ts timestamp_ntz, user_id long, value double"

    def arrive(rows):
        spark.createDataFrame([(start + datetime.timedelta(hours=h), u, v) for h, u, v in rows], schema).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
        out = L.hourly_stream(L.event_stream(spark, str(tmp_path / "in"), schema, "ts"), "user_id", "ts", {"value": ["sum"]}, "n", "3 hours")
        query = L.write_panel(out, "user_id", str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True)
        query.awaitTermination()
        return query

    def panel():
        return {((r["_hour_ts"] - start).total_seconds() / 3600, r["user_id"]): (r["value_sum"], r["n"])
                for r in L.read_panel(spark, str(tmp_path / "out")).collect()}

    arrive([(h, u, 1.0) for h in range(0, 48) for u in (1, 2)])
    first = panel()
    assert len(first) == 96 and set(first.values()) == {(1.0, 1)}
    # Hour 46 is late within the delay, hour 3 is beyond it.
    query = arrive([(46.5, 1, 5.0), (48.2, 1, 2.0), (3, 1, 100.0), (100, 2, 1.0)])
    second = panel()
    assert second == {**first, (46, 1): (6.0, 2), (48, 1): (2.0, 1), (100, 2): (1.0, 1)}
    versions = sorted(os.listdir(tmp_path / "out"))
    days = {v: sorted(d for d in os.listdir(tmp_path / "out" / v) if d.startswith("_day")) for v in versions}
    assert days[versions[0]] == ["_day=2024-01-01", "_day=2024-01-02"]
    assert all("_day=2024-01-01" not in d for v, d in days.items() if v != versions[0])
    arrive([(101, 1, 1.0)])
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert held[-1] <= 6
    # The same batch again leaves the panel as it is.
    now = panel()
    again = max(int(v.split("=")[1]) for v in os.listdir(tmp_path / "out"))
    before = L.panel_versions(spark, str(tmp_path / "out"), again)
    assert before.count() <= len(now) and panel() == now


def test_ordered_steps_of_one_key_share_a_sort(spark, rows):
    data = [(i % 4 if i % 9 else None, i % 13, i, float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(data, "user_id int, timestamp int, item_id int, rating double").repartition(4)
    common = {"group_cols": ["user_id"], "time_col": "timestamp", "tie_cols": ["item_id"]}
    steps = [("CreateSequence", {"max_len": 3, "tie_cols": ["item_id"]}), ("CreateLagFeature", {"target_col": "rating", "lags": [1, 2], **common}),
             ("CreateRollingFeature", {"target_col": "rating", "windows": [4], "aggs": ["mean"], **common}),
             ("CreateLagFeature", {"target_col": "rating_lag_1", "lags": 1, **common})]
    ops = [{"id": f"o{i}", "op": op, "prev": [f"o{i - 1}" if i else "s0"], "params": p} for i, (op, p) in enumerate(steps)]
    shared = Recipe.from_spec(spec(ops[:3], end="o2"))
    out = shared.run({"t": df})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and sorted(shared.fitted) == ["o0", "o1", "o2"]
    # The last step reads what an earlier one made, so it follows on its own.
    got = Recipe.from_spec(spec(ops, end="o3")).run({"t": df}, tidy=True)
    want = df
    for op, p in steps:
        want = getattr(O, op)(**p).transform(want)
    assert rows(got, *want.columns) == rows(want)


def test_tidy_runs_keep_only_their_result(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    folder = session.shared_folder(spark) + "/tables"
    held = lambda: len(list(__import__("pathlib").Path(folder.removeprefix("file:")).glob("*")))
    df = spark.createDataFrame([(i % 5, i % 3, float(i)) for i in range(60)], "user_id int, item_id int, rating double")
    ops = [{"id": "o1", "op": "FilterKCore", "prev": ["s0"], "params": {"k": 2}},
           {"id": "o2", "op": "ScaleFeature", "prev": ["o1"], "params": {"cols": ["rating"]}}]
    before = held()
    out = Recipe.from_spec(spec(ops, end="o2")).run({"t": df}, tidy=True)
    assert out.count() == 60 and held() == before + 1


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_partition_count_does_not_change_results(spark, sf, rows):
    queries = entry.queries()
    for name in ("c11_duplicates_first", "f9_history", "p3_label_codes"):
        first = rows(queries[name](spark, sf))
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            assert rows(queries[name](spark, sf)) == first
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry_and_registry(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    out = entry.entry(spark)
    assert out.count() == 5310 and "item_id_seq" in out.columns


@pytest.mark.parametrize("name", ["j1_join_key", "c7_rule_errors", "p5_target_means", "f8_rolling", "b15_dense_ids",
                                  "h5_late_positives", "e6_adjacency", "recipe_transactions"])
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)

    def ordered(data):
        return sorted(data, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert ordered(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()) == ordered(rel.fetchall())
