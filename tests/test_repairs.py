"""Repairs of registered queries and of the steps that they share, on small tables that failed before."""

import numpy as np
from pyspark.sql import functions as F

import checks
from millrace import settings
from millrace.functions import neighbors


def embeddings(spark, path, vectors, labels):
    spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(vectors, labels))],
                          "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def query(name):
    return checks.collect("QUERIES")[name]


def test_classes_of_vectors_that_share_their_first_entry(spark, tmp_path):
    vectors = [[float(i // 2)] + [float((i * 7 + d) % 11) for d in range(63)] for i in range(40)]
    sf = embeddings(spark, tmp_path, vectors, [i % 10 for i in range(40)])
    out = query("p21_synthetic")(spark, sf)
    # Classes of 4, 4, 4 and 28 rows grow to 28 each.
    assert sorted(map(tuple, out.groupBy("y").count().collect())) == [(y, 28) for y in range(4)]


def test_mixes_stay_between_the_rows_they_mix(spark, tmp_path):
    rows = [(i, "view", 0.0 if i < 5 else 0.1, i % 2) for i in range(400)]
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double, user_id bigint").write.parquet(
        f"{tmp_path}/events.parquet")
    out = query("p23_mixed")(spark, str(tmp_path)).first()
    assert out["n"] == 400 and out["labels_ok"] and out["low_ok"]


def test_queries_travel_once_per_pool_of_leaves(spark, monkeypatch):
    """Without clusters a query meets most leaves; its vector must not be copied for each of them."""
    monkeypatch.setattr(settings, "NEIGHBOR_POOL_BYTES", 8 * 10 * 100)
    vectors = np.random.default_rng(1).normal(size=(300, 10))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, vec array<double>")
    tree, placed = neighbors.PivotTree.grow(points.withColumnRenamed("id", "did"), 8)
    pools = neighbors.Pools(placed, 8)
    located = tree.locate(points.withColumnRenamed("id", "qid"), "qid").withColumn("bound", F.lit(float("inf")))
    met, sent = tree.visits(located, 299).count(), tree.visits(located, 299, pools)
    assert met > 20 * 300 and sent.count() <= 300 * len(set(pools.first.values())) < met / 4
    assert sent.agg(F.sum(F.size("leaves"))).first()[0] == met
    got: dict = {}
    for r in neighbors.nearest(points, points, 3, True, 8).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbor"], r["distance"]))
    for i in range(300):
        d = np.sqrt(neighbors.squared_distances(vectors[i:i + 1], vectors))[0]
        d[i] = np.inf
        assert got[i] == [(j, d[j]) for j in np.lexsort((np.arange(300), d))[:3].tolist()]


def calls(spark, df, key):
    """The rows, and an accumulator of how many rows were made since; ``key`` is a whole-number column."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        made.add(1)
        return x
    return df.withColumn(key, counted.asNondeterministic()(F.col(key))), made


def test_splits_by_time_make_their_table_once(spark):
    from millrace.plans import splits

    df = spark.range(400).select(F.col("id").alias("t"), (F.col("id") % 7).alias("user_id"), (F.col("id") % 5).alias("item_id"),
                                 (F.col("id") % 2).alias("rating"))
    rows, made = calls(spark, df, "t")
    train, held = splits.recent_positives(rows, ["t"], "rating")
    assert train.count() == 320 and held.count() == 40 and made.value == 400
    rows, made = calls(spark, df.withColumn("__split__", F.when(F.col("t") >= 300, "std_test").otherwise("train")), "t")
    out = splits.budget_sample_recent(rows, 40, [("t", "desc")], "user_id", "rating", keys=["t"])
    assert out.where("__split__ = 'train'").count() == 40 and made.value == 400


def test_slots_are_not_sent_through_the_driver(spark):
    from millrace import operators as O

    df = spark.range(3_000).select("id", F.when(F.col("id") < 20, 1).otherwise(0).alias("y"))
    out = O.Oversample("y", key_cols=["id"]).transform(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and out.where("y = 1").count() == 2_980


def test_small_groups_share_their_batches(spark):
    from millrace.functions.grouped import apply_groups

    def total(batches):
        parts = list(batches)
        yield parts[0].head(1).assign(n=sum(map(len, parts)), ordered=all(p["v"].is_monotonic_increasing for p in parts))[["k", "n", "ordered"]]

    df = spark.range(2_500).select(F.when(F.col("id") % 500 != 3, F.col("id") % 500).alias("k"), (-F.col("id")).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = apply_groups(df, ["k"], ["v"], total, "k bigint, n bigint, ordered boolean")
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert len(rows) == 500 and all(r["n"] == 5 and r["ordered"] for r in rows) and sum(r["k"] is None for r in rows) == 1


def test_term_counts_sort_no_text(spark, monkeypatch):
    from millrace import operators as O

    def refuse(*_):
        raise AssertionError("texts are sorted")

    df = spark.createDataFrame([("bb aa bb",), ("aa bb",), (None,)], "t string")
    monkeypatch.setattr(F, "array_sort", refuse)
    out = O.ExtractTextFeature("t", "bow", 2, (1, 2)).transform(df)
    assert sorted(tuple(r[1:]) for r in out.collect()) == [(0, 0), (1, 1), (1, 2)]


def test_negatives_make_their_table_once(spark):
    from millrace import operators as O

    df = spark.range(400).select("id", (F.col("id") % 7).alias("user_id"), (F.col("id") % 50).alias("item_id"),
                                 (F.col("id") % 3 % 2).cast("int").alias("rating"), (F.col("id") % 50 + 1000).alias("item_size"))
    df = df.where("(item_id + user_id) % 4 > 0")
    n, positive = df.count(), df.where("rating = 1").count()
    rows, made = calls(spark, df, "id")
    out = O.SampleNegative(n_negatives=2, key_cols=["id"], order_cols=["id"]).transform(rows)
    assert out.count() == n + 2 * positive and out.where("item_size <> item_id + 1000 or item_size is null").isEmpty()
    assert made.value == n


def test_landmark_features_stay_in_their_tasks(spark, monkeypatch):
    from millrace import operators as O
    from millrace.operators import reduction

    summed, products = [], reduction.cross_products
    monkeypatch.setattr(reduction, "cross_products", lambda df, names, *a, **kw: summed.append(len(names)) or products(df, names, *a, **kw))
    df = spark.range(500).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 23).cast("double").alias("b"))
    out = np.array([tuple(r)[2:] for r in O.ReduceDimension(["a", "b"], "kernel_pca", 2, landmarks=32).transform(df).collect()])
    assert summed == [2] and np.abs(out.mean(axis=0)).max() < 1e-9 and abs((out[:, 0] * out[:, 1]).mean()) < 1e-9


def test_few_columns_are_summed_without_python(spark, monkeypatch):
    from millrace.functions import moments

    x = np.random.default_rng(3).normal(size=(200, 3)).round(3)
    df = spark.createDataFrame([(*map(float, r), int(i % 2)) for i, r in enumerate(x)], "a double, b double, c double, y int")
    monkeypatch.setattr(type(df), "mapInPandas", None)
    n, sums, cross = moments.cross_products(df, ["a", "b", "c"], [0.5, 0.0, 0.0])
    moved = x - [0.5, 0.0, 0.0]
    assert n == 200 and np.allclose(sums, moved.sum(axis=0)) and np.allclose(cross, moved.T @ moved)
    assert np.allclose(moments.cross_products(df, ["a", "b", "c"], by="y")[1][2], x[1::2].T @ x[1::2])


def test_fits_hold_bounded_tasks(spark, monkeypatch):
    from millrace import operators as O
    from millrace.operators import selection
    from millrace.plans import metrics

    monkeypatch.setattr(settings, "FIT_TASK_ROWS", 100)
    df = spark.range(0, 450, 1, 1).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                         (F.col("id") % 50 > 30).cast("int").alias("y"))
    largest = []

    def watched(kind):
        class Watched(kind):
            def fit(self, data, *args):
                largest.append(data.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
                return super().fit(data, *args)
        return Watched
    monkeypatch.setattr(selection, "RandomForestClassifier", watched(selection.RandomForestClassifier))
    monkeypatch.setattr(metrics, "GBTClassifier", watched(metrics.GBTClassifier))
    assert O.SelectFeature("y", "model", k=1, estimator="forest").transform(df).columns == ["y", "a"]
    marked = df.withColumn("__split__", F.when(F.col("b") == 3, "std_test").otherwise("train"))
    assert metrics.fit_and_score(marked, "y", rounds=2, depth=2).first()["auc"] > 0.9
    assert len(largest) == 2 and max(largest) <= 110


def test_rounds_move_ranks_and_sums_only(spark, monkeypatch):
    from millrace.operators import graph

    edges = spark.createDataFrame([(i, (i * 7 + k) % 40 + 100) for i in range(40) for k in range(5)], "a bigint, b bigint")
    plans, rounds = [], graph._one_round

    def watched(*args):
        out = rounds(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(graph, "_one_round", watched)
    got = {r["node"]: r["pagerank"] for r in graph.pagerank(edges, False, 3).collect()}
    links = [(r["a"], r["b"]) for r in edges.collect()]
    links += [(b, a) for a, b in links]
    size = {a: sum(x == a for x, _ in links) for a, _ in links}
    p = dict.fromkeys(size, 1 / 80)
    for _ in range(3):
        q = dict.fromkeys(size, 0.15 / 80)
        for a, b in links:
            q[b] += 0.85 * p[a] / size[a]
        p = q
    assert got.keys() == p.keys() and all(abs(got[k] - p[k]) < 1e-12 for k in p)
    # The links are read from memory as lists per source.
    assert len(plans) == 3 and all("InMemoryTableScan [src" in x and "explode(dsts" in x for x in plans)


def test_document_frequencies_sort_no_text(spark, monkeypatch):
    from millrace import operators as O

    def refuse(*_):
        raise AssertionError("texts are sorted")

    df = spark.createDataFrame([("bb aa bb cc",), ("aa bb",), (None,)], "t string")
    monkeypatch.setattr(F, "array_sort", refuse)
    step = O.ExtractTextFeature("t", "tfidf", 2).fit(df)
    assert step.terms["t"] == ["aa", "bb"] and np.allclose(step.idf["t"], np.log(4 / 3) + 1)
    assert O.ExtractTextFeature("t", "tfidf", 2).fit(df.where("t is null")).idf["t"] == []


def test_core_filter_counts_no_rows_again(spark, monkeypatch):
    from millrace import operators as O
    from millrace.functions import joins

    def refuse(*_):
        raise AssertionError("rows of keys are counted again")

    monkeypatch.setattr(settings, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "hot_keys", refuse)
    df = spark.createDataFrame([(u, i) for u in range(4) for i in range(4)] + [(9, 0), (0, 9)], "user_id int, item_id int")
    assert O.FilterKCore(k=4).transform(df).count() == 16
    assert O.FilterKCore(item_col=None, k=5).transform(df).count() == 5


def test_pairs_are_dealt_out_and_made_once(spark, monkeypatch):
    from millrace.functions import joins
    from millrace.plans import inputs

    def refuse(*_):
        raise AssertionError("rows of keys are counted again")

    monkeypatch.setattr(settings, "PAIR_TASK_ROWS", 50, raising=False)
    monkeypatch.setattr(settings, "BROADCAST_BYTES", 0)
    edges = spark.createDataFrame([(i % 20, i * 7 % 30) for i in range(200)] + [(3, 3), (3, 3)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(40)], "n int")
    monkeypatch.setattr(joins, "hot_keys", refuse)
    got = {(r["src"], r["dst"]): r["weight"] for r in inputs.normalised_adjacency(edges, "a", "b", nodes, "n").collect()}
    pairs = {(r["a"], r["b"]) for r in edges.collect()}
    full = sorted(pairs | {(b, a) for a, b in pairs}) + [(i, i) for i in range(40)]
    size = {i: sum(a == i for a, _ in full) for i in range(40)}
    wanted: dict = {}
    for a, b in full:
        wanted[a, b] = wanted.get((a, b), 0) + 1 / np.sqrt(size[a] * size[b])
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-12 for k in wanted)
    dealt = inputs.both_directions(edges, "a", "b").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 150 and dealt.count() > 2
