"""Operators on small hand-made tables: the documented example or the rule, and edge cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace import operators as O, settings
from millrace.functions.fuzzy import common_subsequence, indel_ratio


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def column(df, *names):
    out = [tuple(r[n] for n in names) for r in df.collect()]
    return [v[0] for v in out] if len(names) == 1 else out


# --- integration

def test_join_by_key_compares_text_and_coalesces(spark, rows):
    main = frame(spark, "id string, x int", ("1", None), ("2", 5), (None, 7))
    aux = frame(spark, "id int, x int, y string", (1, 10, "a"), (2, 20, "b"), (2, 30, "c"), (None, 1, "z"))
    out = O.JoinTable(aux_df=aux, key_col="id").transform(main)
    assert rows(out) == [("1", 10, "a"), ("2", 5, "b"), ("2", 5, "c"), (None, 7, None)]


def test_join_without_key_is_unchanged(spark):
    main = frame(spark, "id int", (1,))
    assert O.JoinTable(aux_df=main, key_col="no").transform(main) is main


def test_join_statistics_caps_kinds_separately_and_skips_missing_keys(spark, rows):
    main = frame(spark, "k int", (1,), (None,), (3,))
    aux = frame(spark, "k int, a double, b int, s string, t boolean", (1, 2.0, 1, "x", True), (1, None, 2, "x", False),
                (None, 9.0, 9, "q", True))
    out = O.JoinTable("agg", aux, "k", prefix="p", agg_funcs=["mean", "count"], max_cols=1).transform(main)
    assert out.columns == ["k", "p_a_mean", "p_a_count", "p_s_nunique"]
    assert rows(out) == [(1, 2.0, 1, 1), (3, None, None, None), (None, None, None, None)]


def test_join_users_and_items_matches_missing_keys(spark, rows):
    i = frame(spark, "user_id int, item_id int, n string", (1, 5, "a"), (None, 6, "b"))
    u = frame(spark, "user_id int, n string", (1, "u1"), (None, "u0"))
    p = frame(spark, "item_id int, brand string", (5, "B"))
    out = O.JoinTable("rec", user_df=u, item_df=p).transform(i)
    assert out.columns == ["user_id", "item_id", "n_x", "n_y", "brand"]
    assert rows(out) == [(1, 5, "a", "u1", "B"), (None, 6, "b", "u0", None)]


def test_concat(spark, rows):
    a, b = frame(spark, "a int, b int", (1, 2), (1, 2)), frame(spark, "b int, c int", (2, 3))
    assert rows(O.ConcatTable([b]).transform(a)) == [(1, 2, None), (1, 2, None), (None, 2, 3)]
    assert rows(O.ConcatTable(b, fill_missing=False, dedup=True).transform(a)) == [(2,)]
    wide = O.ConcatTable(b.select("c"), axis="horizontal", order_cols=[["a", "b"], ["c"]]).transform(a)
    assert rows(wide) == [(1, 2, 3), (1, 2, None)]
    with pytest.raises(ValueError):
        O.ConcatTable(b, axis="horizontal", order_cols=[["a"], ["b"]]).transform(a)


def test_align_schema(spark, rows):
    out = O.AlignSchema({"uid": "id", "no": "x"}, {"amount": "float"}, ["flag"], 0).transform(
        frame(spark, "uid int, amount string", (1, "2.5"), (2, "x")))
    assert rows(out) == [(1, 2.5, 0), (2, None, 0)]


def test_cast_and_parse(spark, rows):
    df = frame(spark, "i string, b string, d string", ("1.0", "true", "2024-01-02"), ("1.5", "maybe", "2024-13-01"))
    out = O.CastType({"i": "int", "b": "bool", "d": "datetime"}).transform(df)
    assert rows(out) == [(1, True, dt.datetime(2024, 1, 2)), (None, None, None)]
    assert column(O.ParseNumber("i").transform(df), "i") == [1.0, 1.5]


def test_parse_dates(spark, rows):
    df = frame(spark, "d int", (750231,), (490102,), (505112,), (0,), (None,))
    out = O.ParseDate("d", mode="int_yymmdd", out_features=["year", "month"]).transform(df)
    assert column(out, "d_year", "d_month") == [(None, None), (2049, 1), (None, None), (None, None), (None, None)]
    birth = O.ParseDate("d", mode="berka_birth").transform(frame(spark, "d int", (505112,), (400101,)))
    assert column(birth, "d_year", "d_month", "d_gender") == [(1950, 1, "F"), (1940, 1, "M")]
    text = O.ParseDate("s", formats=["%d/%m/%Y"]).transform(frame(spark, "s string", ("31/12/2020",), ("nope",)))
    assert text.columns == ["s"] and column(text, "s") == [dt.datetime(2020, 12, 31), None]


def test_sort_puts_missing_last_both_ways(spark):
    df = frame(spark, "x int", (1,), (None,), (3,))
    assert column(O.SortRows("x").transform(df), "x") == [1, 3, None]
    assert column(O.SortRows("x", False).transform(df), "x") == [3, 1, None]


def test_split_column(spark):
    df = frame(spark, "n string", ("a.b.c",), ("a",), (None,))
    assert column(O.SplitColumn("n", ["p", "q"], sep=".").transform(df), "p", "q") == [("a", "b"), ("a", None), (None, None)]
    assert O.SplitColumn("n", sep=".").transform(df).columns == ["n", "n_0", "n_1", "n_2"]
    assert column(O.SplitColumn("n", ["p"], sep="[.]", regex=True).transform(df), "p") == ["a", "a", None]


# --- cleaning

def test_fill_by_kind(spark, rows):
    df = frame(spark, "age double, city string, n int", (20.0, "", 1), (math.nan, "LA", None), (40.0, "LA", 4))
    out = O.HandleMV(method="median", na_values=[""], cols=["age", "city", "n"]).transform(df)
    assert rows(out) == [(20.0, "LA", 1.0), (30.0, "LA", 2.5), (40.0, "LA", 4.0)]
    assert rows(O.HandleMV(method="constant").transform(df))[0][0] == 0.0


def test_fill_of_all_missing_column_is_zero_text(spark):
    df = frame(spark, "s string", (None,), (None,))
    assert column(O.HandleMV(method="mode").transform(df), "s") == ["0", "0"]


def test_delete_and_mark(spark, rows):
    df = frame(spark, "a int, b string", (1, "x"), (None, "y"), (-1, None))
    assert rows(O.HandleMV(action="delete", cols="a", na_values=[-1]).transform(df)) == [(1, "x")]
    assert rows(O.HandleMV(action="mark", na_values=[-1, "x"]).transform(df)) == [(1, None), (None, "y"), (None, None)]


def test_fit_uses_first_table_only(spark):
    step = O.HandleMV(method="mean", cols="a").fit(frame(spark, "a double", (1.0,), (3.0,)))
    assert column(step.transform(frame(spark, "a double", (None,), (100.0,))), "a") == [2.0, 100.0]


def test_outliers(spark):
    df = frame(spark, "x double", (1.0,), (2.0,), (100.0,), (None,))
    assert O.HandleOutlier("x", threshold=1.5).transform(df).count() == 4
    assert column(O.HandleOutlier("x", "zscore", 1.0, "repair", "set_missing", "f").transform(df), "x", "f") == [
        (1.0, 0), (2.0, 0), (None, 1), (None, 0)]
    flat = frame(spark, "x double", (5.0,), (5.0,), (5.0,), (9.0,))
    assert O.HandleOutlier("x").transform(flat).count() == 4  # quartiles touch: bounds are min and max


def test_rule_order_and_missing_values(spark, rows):
    df = frame(spark, "x string, c string", ("5", "a"), ("bad", "b"), (None, "c"), ("-3", None))
    assert rows(O.HandleError("x", "numeric").transform(df)) == [("-3", None), ("5", "a"), (None, "c")]
    assert rows(O.HandleError("x", "positive").transform(df)) == [("5", "a")]
    assert rows(O.HandleError("x", min_value=0).transform(df)) == [("5", "a"), (None, "c")]
    assert rows(O.HandleError("c", "not_in", allowed_values=["a", "c"]).transform(df), "c") == [("a",), ("c",)]
    both = O.HandleError(rules=[{"col": "x", "rule": "numeric"}, {"col": "x", "rule": "numeric", "action": "repair"}])
    assert both.transform(df).count() == 3


def test_non_iid_and_groups(spark):
    df = frame(spark, "x double", (1.0,), (1.1,), (50.0,))
    assert column(O.HandleNonIID(threshold=0.9).transform(df), "sample_weight") == [1.0, 1.0, 0.2]
    assert O.HandleNonIID(feature_cols=[], action="delete").transform(df).count() == 0
    assert O.HandleNonIID().transform(df.where("x < 0")).count() == 0
    g = frame(spark, "g string, p double", ("a", 0.9), ("b", 0.5), (None, 0.5))
    assert sorted(column(O.ReweightUPG("g", pred_probs="p").transform(g), "sample_weight")) == [1.0, 1.0, 2.0]
    assert set(column(O.ReweightUPG("g").transform(g.where("g is not null")), "sample_weight")) == {2.0}


def test_labels(spark):
    df = frame(spark, "label int, p1 double", (0, 0.95), (1, 0.9), (None, 0.99), (1, 0.5))
    assert column(O.CorrectLabel("label", "p1").transform(df), "label", "label_corrected") == [
        (1, 1), (1, 0), (None, 0), (1, 0)]
    assert column(O.CorrectLabel("label", ["p1"]).transform(df), "label") == [0, 0, None, 1]
    assert column(O.CorrectLabel("label").transform(df), "label_corrected") == [0] * 4


def test_duplicates(spark, rows):
    df = frame(spark, "id int, n string, t int", (1, "a", 2), (1, "b", 1), (None, "c", 1), (None, "d", 2), (3, "e", 1))
    assert rows(O.Deduplicate("id", "first", ["t"]).transform(df), "n") == [("b",), ("c",), ("e",)]
    assert rows(O.Deduplicate("id", "last", ["t"]).transform(df), "n") == [("a",), ("d",), ("e",)]
    assert rows(O.Deduplicate("id", False).transform(df), "n") == [("e",)]
    # Without an order, all columns order the rows.
    assert rows(O.Deduplicate("id", "first").transform(df), "n") == [("a",), ("c",), ("e",)]


def test_similarity_matches_definition():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ["".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(2)]
        assert common_subsequence(a, b) == slow(a, b)
    assert indel_ratio("", "") == 100.0 and indel_ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)


def test_typos(spark):
    df = frame(spark, "c string", ("NYC",), ("Bostn",), ("zzz",), (None,))
    out = O.CorrectTypo("c", {"NYC": "New York"}, ["Boston", "Austin"], 85).transform(df)
    assert sorted(column(out, "c"), key=str) == ["Boston", "New York", None, "zzz"]


def test_custom_clean(spark):
    df = frame(spark, "age int, note string", (-1, "a1"), (200, None), (None, "b22"))
    out = O.CustomClean(rules=[{"col": "age", "lt": 0}, {"col": "age", "gt": 120, "replace_with": 120},
                               {"col": "age", "ne": 120, "replace_with": 7}]).transform(df)
    assert column(out, "age") == [7, 120, 7]
    assert column(O.CustomClean("replace_text", "note", pattern=r"\d+", replacement="#").transform(df), "note") == ["a#", None, "b#"]


# --- preprocessing

def test_one_hot_aligns_to_training(spark):
    step = O.OneHotEncode("c").fit(frame(spark, "c string", ("b",), ("a",), (None,)))
    out = step.transform(frame(spark, "c string, x int", ("z", 1), ("a", 2), (None, 3)))
    assert out.columns == ["x", "c_a", "c_b"] and column(out, "c_a", "c_b") == [(0, 0), (1, 0), (0, 0)]


def test_codes(spark):
    df = frame(spark, "c string, t int", ("NY", 1), ("LA", 2), ("NY", 3), ("SF", 4), (None, 5))
    assert column(O.LabelEncode(order_cols=["t"]).transform(df), "c") == [0, 1, 0, 2, -1]
    assert column(O.LabelEncode().transform(df), "c") == [1, 0, 1, 2, -1]
    assert column(O.OrdinalEncode("c", ["SF", "NY"]).transform(df), "c") == [1, -1, 1, 0, -1]


def test_codes_as_joined_table_equal_literal_map(spark, monkeypatch, rows):
    df = frame(spark, "c string, t int", *[(f"v{i % 90}", i) for i in range(300)], (None, 300))
    want = rows(O.LabelEncode(order_cols=["t"]).transform(df))
    monkeypatch.setattr(settings, "MAX_LITERAL_ENTRIES", 5)
    assert rows(O.LabelEncode(order_cols=["t"]).transform(df)) == want


def test_hash_codes(spark):
    df = frame(spark, "u string", ("user_42",), (None,))
    assert column(O.HashEncode("u", 8).transform(df), "h_u") == [6, 0]


def test_target_and_frequency(spark):
    df = frame(spark, "c string, y int", ("a", 1), ("a", 0), ("b", 1))
    assert column(O.TargetEncode("c", "y").transform(df), "c_y") == pytest.approx([5 / 9, 5 / 9, 5 / 6])
    step = O.FrequencyEncode("c").fit(df)
    assert column(step.transform(frame(spark, "c string", ("a",), ("z",), (None,))), "c_freq") == [2, 0, 0]


def test_scaling(spark):
    df = frame(spark, "x double", (1.0,), (2.0,), (3.0,), (None,))
    assert column(O.ScaleFeature("x").transform(df), "x") == [-1.0, 0.0, 1.0, None]
    assert column(O.ScaleFeature("x", "robust").transform(df), "x") == [-1.0, 0.0, 1.0, None]
    one = frame(spark, "x double", (4.0,), (4.0,))
    assert column(O.ScaleFeature("x", "minmax").transform(one), "x") == [0.0, 0.0]
    assert column(O.ScaleFeature("x").transform(one), "x") == [0.0, 0.0]
    assert O.ScaleFeature().transform(df) is df


def test_power(spark):
    df = frame(spark, "x double", (-1.0,), (-2.0,), (math.e - 1,))
    out = column(O.TransformPower("x", "log").transform(df), "x")
    assert out[0] == -math.inf and out[1] is None and out[2] == pytest.approx(1.0)
    assert column(O.TransformPower("x", "sqrt").transform(df), "x")[:2] == [0.0, 0.0]
    q = O.TransformPower("x", "quantile", output_distribution="normal").transform(
        frame(spark, "x double", *[(float(i),) for i in range(101)]))
    values = column(q, "x")
    assert values[50] == pytest.approx(0.0, abs=1e-9) and values[0] < -5 and values[75] == pytest.approx(0.67449, abs=1e-4)


def test_bins(spark):
    df = frame(spark, "x double", (0.0,), (10.0,), (15.0,), (None,))
    assert column(O.DiscretizeFeature(boundaries={"x": [10, 20]}).transform(df), "x") == [0, 1, 1, -1]
    clusters = frame(spark, "x double", *[(v,) for v in (1.0, 1.1, 0.9, 8.0, 8.2, 20.0, 20.5)])
    assert column(O.DiscretizeFeature("x", n_bins=3, strategy="kmeans").transform(clusters), "x") == [0, 0, 0, 1, 1, 2, 2]


def test_core_filter(spark, rows):
    df = frame(spark, "user_id int, item_id int", (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (None, 1))
    assert rows(O.FilterKCore(k=2).transform(df)) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert O.FilterKCore(k=3).transform(df).count() == 0
    assert O.FilterKCore(k=1).transform(df) is df


@pytest.mark.parametrize("limit", [3, 10_000])
def test_negatives_are_unseen_and_uniform(spark, monkeypatch, limit):
    monkeypatch.setattr(settings, "MAX_GROUP_ROWS", limit)
    data = [(1, i, 1) for i in range(0, 16, 2)] + [(2, i, 1) for i in range(1, 20)] + [(3, i, 1) for i in range(20)] + [(4, 0, 0)]
    df = frame(spark, "user_id int, item_id int, rating int", *data)
    out = O.SampleNegative(n_negatives=50).transform(df)
    drawn = [r for r in out.collect() if r.rating == 0 and not (r.user_id == 4)]
    assert {r.user_id for r in drawn} == {1, 2}  # user 3 has every item
    assert len(drawn) == 50 * (8 + 19)
    assert {r.item_id for r in drawn if r.user_id == 2} == {0}
    free = set(range(20)) - set(range(0, 16, 2))
    got = [r.item_id for r in drawn if r.user_id == 1]
    assert set(got) == free and max(got.count(i) for i in free) < 2.2 * len(got) / len(free)
    with pytest.raises(ValueError):
        O.SampleNegative(positive_label=5).transform(df)


def test_balancing(spark):
    df = frame(spark, "x double, y int", *[(float(i), int(i < 4)) for i in range(20)])
    assert sorted(column(O.Undersample("y").transform(df), "y")) == [0] * 4 + [1] * 4
    up = O.Oversample("y").transform(df)
    assert sorted(column(up, "y")) == [0] * 16 + [1] * 16
    assert {r.x for r in up.collect() if r.y == 1} <= {0.0, 1.0, 2.0, 3.0}
    made = O.Oversample("y", "smote", 2).transform(df)
    assert made.count() == 32 and made.where("y = 1 and not x between 0 and 3").count() == 0


def test_tomek_and_edited(spark):
    df = frame(spark, "x double, y int", (0.0, 0), (1.0, 0), (5.0, 0), (5.1, 1), (9.0, 1), (0.5, 0))
    assert sorted(column(O.Undersample("y", "tomek", key_cols=["x"]).transform(df), "x")) == [0.0, 0.5, 1.0, 5.1, 9.0]
    assert sorted(column(O.Undersample("y", "enn", 1, key_cols=["x"]).transform(df), "x")) == [0.0, 0.5, 1.0, 5.1, 9.0]


def test_augmentation(spark):
    df = frame(spark, "x double, y int, s string", (1.0, 0, "a"), (3.0, 1, "b"))
    mixed = O.AugmentMixup("y", n_samples=40).transform(df)
    new = [r for r in mixed.collect() if r.s is None]
    assert len(new) == 40 and all(abs(r.x - (1 + 2 * r.y)) < 1e-9 for r in new)
    assert O.AugmentMixup("y").transform(df.limit(1)).count() == 1
    noisy = O.AugmentNoise("x", n_copies=3).transform(df)
    assert noisy.count() == 8


# --- features

def test_row_features(spark):
    df = frame(spark, "a int, b int", (1, 2), (4, None), (None, None))

    def made(method, **kw):
        return column(O.CreateFeature(["a", "b"], "o", method, kw).transform(df), "o")
    assert made("mean") == [1.5, 4.0, None] and made("sum") == [3.0, 4.0, 0.0] and made("product") == [2.0, 4.0, 1.0]
    assert made("median") == [1.5, 4.0, None] and made("std")[1:] == [None, None]
    assert made("ratio") == [0.5, None, None] and made("concat", sep="/") == ["1/2", "4/nan", "nan/nan"]
    with pytest.raises(ValueError):
        O.CreateFeature("a", "o", "nope")


def test_polynomial_and_cross(spark):
    df = frame(spark, "a int, b double", (2, 3.0), (None, 1.0))
    out = O.CreatePolynomialFeature(["a", "b"]).transform(df)
    assert out.columns == ["a", "b", "poly_ap2", "poly_a_b", "poly_bp2"] and tuple(out.collect()[0])[2:] == (4.0, 6.0, 9.0)
    assert column(O.CrossFeature(["a", "b"]).transform(df), "a_b") == ["2_3.0", "_1.0"]


def test_group_features_leave_missing_groups_empty(spark, rows):
    df = frame(spark, "g string, v int", ("a", 1), ("a", 3), (None, 5))
    out = O.AggregateGroupFeature("g", agg_funcs=["mean", "count"]).transform(df)
    assert rows(out) == [("a", 1, 2.0, 2), ("a", 3, 2.0, 2), (None, 5, None, None)]


def test_calendar(spark):
    df = frame(spark, "t string", ("2024-02-29 13:00:00",), ("bad",))
    out = O.ExtractDateTimeFeature("t", ["dayofweek", "is_weekend", "hour", "dayofyear"]).transform(df)
    assert [tuple(r)[1:] for r in out.collect()] == [(3, 0, 60, 13), (None, 0, None, None)]


def test_lag_and_rolling(spark):
    df = frame(spark, "u int, t int, v int", (1, 1, 10), (1, 2, 20), (1, 3, 30), (None, 1, 5), (None, 2, 6))
    out = O.CreateRollingFeature("v", 2, ["mean", "median"], ["u"], "t").transform(
        O.CreateLagFeature("v", 1, ["u"], "t").transform(df)).orderBy(F.col("u").desc(), "t")
    assert [tuple(r)[3:] for r in out.collect()] == [(None, None, None), (10, 10.0, 10.0), (20, 15.0, 15.0),
                                                     (None, None, None), (None, None, None)]


@pytest.mark.parametrize("limit", [2, 10_000])
def test_history_follows_the_plain_definition(spark, limit):
    rng = random.Random(4)
    data = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(9), rng.randrange(12),
             rng.choice(["train", "train", "std_test"])) for i in range(90)]
    df = frame(spark, "i int, user_id int, item_id int, timestamp int, __split__ string", *data)
    got = {r.i: r.item_id_seq for r in O.CreateSequence(max_len=3, tie_cols=["i"], limit=limit).transform(df).collect()}
    past: dict = {}
    for i, u, item, t, split in sorted(data, key=lambda r: (r[1], r[3], r[4] == "std_test", r[0])):
        assert got[i] == past.get(u, [])[-3:]
        if split == "train":
            past.setdefault(u, []).append(item)
    plain = {r.i: r.item_id_seq for r in O.CreateSequence(max_len=2, tie_cols=["i"], limit=limit)
             .transform(df.drop("__split__")).collect()}
    past = {}
    for i, u, item, t, _ in sorted(data, key=lambda r: (r[1], r[3], r[0])):
        assert plain[i] == past.get(u, [])[-2:]
        past.setdefault(u, []).append(item)


def test_truncate(spark):
    df = frame(spark, "s array<int>", ([1, 2, 3],), ([],), (None,))
    assert column(O.TruncateSequence("s", 2).transform(df), "s") == [[2, 3], [], None]
    assert column(O.TruncateSequence("s", 2, "first").transform(df), "s") == [[1, 2], [], None]


def test_selection(spark):
    rng = random.Random(6)
    data = [(i % 2, float(i % 2) * 5 + rng.random(), rng.random(), 1.0, "s") for i in range(60)]
    df = frame(spark, "y int, good double, noise double, flat double, s string", *data)
    assert O.SelectFeature("y").transform(df).columns == ["y", "good", "noise", "s"]
    for kw in ({"method": "univariate"}, {"method": "model"}, {"method": "model", "estimator": "linear"}):
        assert O.SelectFeature("y", k=1, **kw).transform(df).columns == ["y", "s", "good"]
    assert O.SelectFeature("y", "rfe", n_features_to_select=1, estimator="linear").transform(df).columns == ["y", "s", "good"]


def test_projections(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) @ np.array([[3, 1, 0], [0, 1, 0.2], [0, 0, 0.1]])
    y = (x[:, 0] > 0).astype(int)
    df = frame(spark, "a double, b double, c double, y int", *[(*map(float, r), int(k)) for r, k in zip(x, y)])
    out = np.array([tuple(r)[4:] for r in O.ReduceDimension(["a", "b", "c"], "pca", 2).transform(df).collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(out), np.abs(u[:, :2] * s[:2]))
    out = np.array([tuple(r)[4:] for r in O.ReduceDimension(["a", "b", "c"], "svd", 2).transform(df).collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(out), np.abs(u[:, :2] * s[:2]))
    lda = np.array([r.lda_0 for r in O.ReduceDimension(["a", "b", "c"], "lda", target_col="y").transform(df).collect()])
    within = sum((lda[y == k].var() * (y == k).sum()) for k in (0, 1)) / (40 - 2)
    assert within == pytest.approx(1.0) and abs(lda[y == 0].mean() - lda[y == 1].mean()) > 1
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 3)
    j = np.eye(40) - 1 / 40
    top = np.linalg.eigvalsh(j @ k @ j)[::-1][:2]
    out = np.array([tuple(r)[4:] for r in O.ReduceDimension(["a", "b", "c"], "kernel_pca", 2, landmarks=256).transform(df).collect()])
    assert np.allclose((out ** 2).sum(0), top)


def test_text(spark):
    df = frame(spark, "r string", ("good good day",), ("bad day, x",), (None,))
    out = O.ExtractTextFeature("r", "bow", 2).transform(df)
    assert out.columns == ["r", "r_bow_day", "r_bow_good"] and [tuple(r)[1:] for r in out.collect()] == [(1, 2), (1, 0), (0, 0)]
    pairs = O.ExtractTextFeature("r", "bow", 10, (2, 2)).transform(df)
    assert set(pairs.columns[1:]) == {"r_bow_bad day", "r_bow_good day", "r_bow_good good"}
    norm = [sum(v * v for v in tuple(r)[1:]) for r in O.ExtractTextFeature("r").transform(df).collect()]
    assert norm == pytest.approx([1.0, 1.0, 0.0])
    vec = [sum(v * v for v in tuple(r)[1:]) for r in O.ExtractTextEmbedding("r", dim=4).transform(df).collect()]
    assert vec == pytest.approx([1.0, 1.0, 0.0])


def test_graph(spark):
    df = frame(spark, "src string, dst string", ("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("d", None))
    out = O.ExtractGraphFeature().transform(df)
    assert sorted(column(out, "src", "graph_src_degree")) == [("a", 1), ("b", 2), ("b", 2), ("c", 3), ("d", 0)]
    rank = {r.src: r.graph_src_pagerank for r in out.collect()}
    # Fixed point of the undirected walk on a-b, b-c and the loop c-c, in closed form.
    import numpy as np
    walk = np.array([[0, 1, 0], [0.5, 0, 0.5], [0, 0.5, 0.5]])
    want = np.linalg.solve(np.eye(3) - 0.85 * walk.T, np.full(3, 0.05))
    assert [rank["a"], rank["b"], rank["c"]] == pytest.approx(list(want), abs=1e-5) and rank["d"] == 0.0


def test_callables_must_return_tables(spark):
    df = frame(spark, "a int", (1,))
    with pytest.raises(TypeError):
        O.CustomFE(lambda d: 5).transform(df)
    assert O.CustomTransform().transform(df) is df


@pytest.mark.parametrize("step", [
    lambda: O.HandleMV(cols="x"), lambda: O.HandleOutlier("x"), lambda: O.ScaleFeature("x"), lambda: O.ClipOutlier("x"),
    lambda: O.DiscretizeFeature("x", strategy="quantile"), lambda: O.FrequencyEncode("c"), lambda: O.LabelEncode(),
    lambda: O.TargetEncode("c", "x"), lambda: O.OneHotEncode("c"), lambda: O.AggregateGroupFeature("c"),
    lambda: O.CreateLagFeature("x", 1, ["c"], "x"), lambda: O.Undersample("c"), lambda: O.Oversample("c"),
    lambda: O.HandleNonIID(), lambda: O.FilterKCore("c", "x", 2), lambda: O.ExtractTextFeature("c"),
    lambda: O.ReduceDimension(["x"], n_components=1), lambda: O.SelectFeature(), lambda: O.AugmentMixup("x"),
])
def test_empty_and_missing_tables(spark, step):
    schema = "c string, x double"
    assert step().transform(spark.createDataFrame([], schema)).count() == 0
    step().transform(frame(spark, schema, (None, None), (None, math.nan))).collect()
