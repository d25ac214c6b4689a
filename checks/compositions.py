"""Recipes of the shapes the shipped tasks use, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import datasets as D
from millrace.plans.recipe import Recipe

from .common import INTERACTION_KEY, INTERACTION_KEY_SQL, LKEY, interactions, r, rounded, table, with_split
from .preprocessing import k_core_sql


def recipe(sources, *steps):
    """A spec from (operator, inputs, params) triples; steps are named o1, o2, ..."""
    return {"dag": {"sources": [{"id": f"s{i}", "table": t} for i, t in enumerate(sources)],
                    "ops": [{"id": f"o{i + 1}", "op": op, "prev": prev, "params": params}
                            for i, (op, prev, params) in enumerate(steps)],
                    "train": {"prev": [f"o{len(steps)}"]}}}


def interaction_features(spark, sf):
    """Enrichment, column drop, gap filter, core filter, history, lag and rolling features."""
    spec = recipe(
        ["interaction", "user", "item"],
        ("JoinTable", ["s0", "s2", "s1"], {"method": "rec"}),
        ("DropColumns", ["o1"], {"cols": ["item_name", "user_name"]}),
        ("FilterSample", ["o2"], {"subset": ["user_id", "item_id", "rating"]}),
        ("FilterKCore", ["o3"], {"k": 22}),
        ("CreateSequence", ["o4"], {"max_len": 20, "tie_cols": INTERACTION_KEY}),
        ("CreateLagFeature", ["o5"], {"target_col": "rating", "lags": [1], "group_cols": ["user_id"],
                                      "time_col": "timestamp", "tie_cols": INTERACTION_KEY}),
        ("CreateRollingFeature", ["o6"], {"target_col": "rating", "windows": [5], "aggs": ["mean"], "group_cols": ["user_id"],
                                          "time_col": "timestamp", "tie_cols": INTERACTION_KEY}))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"),
                                                F.col("c_mktsegment").alias("user_segment"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"),
                                            F.col("p_brand").alias("item_brand"))
    out = Recipe.from_spec(spec, "rec").run({"interaction": interactions(spark, sf), "user": users, "item": items})
    return rounded(out.withColumn("item_id_seq", F.array_join(out.item_id_seq.cast("array<string>"), ",")))


def relational_features(spark, sf):
    """A main table with statistics of two auxiliary tables, filled, encoded and scaled on training rows."""
    spec = recipe(
        ["main", "history", "nations"],
        ("JoinTable", ["s0", "s1"], {"method": "agg", "key_col": "id", "prefix": "hist", "agg_funcs": ["mean", "max"]}),
        ("JoinTable", ["o1", "s2"], {"key_col": "nation"}),
        ("HandleMV", ["o2"], {"method": "median", "cols": ["hist_price_mean", "hist_price_max"]}),
        ("OneHotEncode", ["o3"], {"cols": ["segment"]}),
        ("ScaleFeature", ["o4"], {"cols": ["balance"]}))
    main = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_custkey") % 5 == 0, "std_test").otherwise("train").alias("__split__"))
    # Later orders belong to no customer of the main table, so some customers have no history.
    history = table(spark, sf, "orders").select(
        (F.col("o_custkey") + F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), 0).otherwise(20_000_000)).alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    out = Recipe.from_spec(spec).run({"main": main, "history": history, "nations": nations})
    return rounded(out, 4)


def hourly_features(spark, sf):
    """An hourly panel with calendar, lag and rolling features; gaps become 0."""
    spec = recipe(
        ["panel"],
        ("ExtractDateTimeFeature", ["s0"], {"cols": "_hour_ts", "features": ["hour", "day_of_week", "is_weekend"]}),
        ("CreateLagFeature", ["o1"], {"target_col": "n", "lags": [1, 2], "group_cols": ["user_id"], "time_col": "_hour_idx"}),
        ("CreateRollingFeature", ["o2"], {"target_col": "n", "windows": [3], "aggs": ["mean", "max"], "group_cols": ["user_id"],
                                          "time_col": "_hour_idx"}),
        ("HandleMV", ["o3"], {"method": "constant", "fill_value": 0,
                              "cols": ["n_lag_1", "n_lag_2", "n_roll_mean_3", "n_roll_max_3"]}),
        ("DropColumns", ["o4"], {"cols": ["_hour_ts"]}))
    panel = D.hourly_panel(table(spark, sf, "events"), "user_id", "ts", {"value": ["mean"]}, "n")
    return rounded(Recipe.from_spec(spec).run({"panel": panel}), 4)


def transaction_features(spark, sf):
    """Side join, rule repair, clipping, frequency, hash and target encoding with a held-out tail."""
    spec = recipe(
        ["lines", "orders"],
        ("JoinTable", ["s0", "s1"], {"key_col": "o_orderkey"}),
        ("HandleError", ["o1"], {"rules": [{"col": "l_quantity", "rule": "in_range", "min": 2, "max": 49, "action": "repair",
                                            "repair_method": "clip"}]}),
        ("ClipOutlier", ["o2"], {"cols": ["l_extendedprice"]}),
        ("FrequencyEncode", ["o3"], {"cols": ["l_suppkey"]}),
        ("HashEncode", ["o4"], {"cols": ["o_orderpriority"], "n_buckets": 8, "drop_original": True}),
        ("TargetEncode", ["o5"], {"cols": ["l_suppkey"], "target_col": "y"}))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
        (F.col("l_returnflag") == "R").cast("int").alias("y"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return rounded(Recipe.from_spec(spec).run({"lines": with_split(lines, "l_shipdate", "2000-01-01"), "orders": orders}), 4)


def monthly_history(spark, sf):
    """Wide readings turned long, then summarised per id."""
    c = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    long = D.wide_to_long(c, "l_partkey", {"amount": ["l_quantity", "l_extendedprice"], "rate": ["l_tax", "l_discount"]}, "step")
    spec = recipe(
        ["main", "monthly"],
        ("JoinTable", ["s0", "s1"], {"method": "agg", "key_col": "l_partkey", "prefix": "m", "agg_funcs": ["mean", "std"], "max_cols": 2}),
        ("CreateFeature", ["o1"], {"source_cols": ["m_amount_mean", "m_rate_mean"], "output_col": "per_rate", "method": "ratio"}))
    main = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return rounded(Recipe.from_spec(spec).run({"main": main, "monthly": long}), 4)


def catalogue_features(spark, sf):
    """Item table with several rows per item, gaps marked and filled, core filter, two histories."""
    spec = recipe(
        ["interaction", "item"],
        ("Deduplicate", ["s1"], {"subset": ["item_id"], "keep": "first"}),
        ("HandleMV", ["o1"], {"cols": ["item_brand"], "na_values": ["Brand#11"], "action": "mark"}),
        ("JoinTable", ["s0", "o2"], {"method": "rec", "how": "left"}),
        ("HandleMV", ["o3"], {"cols": ["item_brand"], "method": "constant", "fill_value": "none", "action": "impute"}),
        ("FilterKCore", ["o4"], {"k": 22}),
        ("CreateSequence", ["o5"], {"seq_col": "item_id_seq", "max_len": 20, "tie_cols": INTERACTION_KEY}),
        ("CreateSequence", ["o6"], {"item_col": "item_brand", "seq_col": "item_brand_seq", "max_len": 20, "tie_cols": INTERACTION_KEY}))
    part = table(spark, sf, "part")
    items = part.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("item_brand")).union(
        part.select("p_partkey", F.concat(F.lit("Brand#"), F.col("p_size").cast("string"))))
    out = Recipe.from_spec(spec, "rec").run({"interaction": interactions(spark, sf), "item": items})
    return rounded(out.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in ("item_id_seq", "item_brand_seq")}))


def card_transactions(spark, sf):
    """Calendar parts, log amount, rename, frequencies, hash buckets, sparse columns dropped, labels coded, medians."""
    spec = recipe(
        ["main"],
        ("ExtractDateTimeFeature", ["s0"], {"cols": ["l_shipdate"], "features": ["day_of_week", "month"], "drop_original": True}),
        ("TransformPower", ["o1"], {"cols": ["l_extendedprice"], "output_cols": ["amount_log"], "method": "log"}),
        ("RenameColumn", ["o2"], {"rename_map": {"l_extendedprice": "amount"}}),
        ("FrequencyEncode", ["o3"], {"cols": ["l_partkey", "l_suppkey", "flag"]}),
        ("HashEncode", ["o4"], {"cols": ["l_partkey"], "n_buckets": 4096}),
        ("CustomProcess", ["o5"], {"threshold": 0.9, "mode": "drop_high_null"}),
        ("DropColumns", ["o6"], {"cols": ["l_linenumber"]}),
        ("LabelEncode", ["o7"], {"order_cols": ["l_orderkey", "l_partkey", "l_suppkey", "amount"]}),
        ("HandleMV", ["o8"], {"method": "median"}))
    main = table(spark, sf, "lineitem").select(
        *LKEY, F.nullif("l_quantity", F.lit(1.0)).alias("quantity"), F.nullif("l_returnflag", F.lit("A")).alias("flag"), "l_linestatus",
        F.when(F.col("l_quantity") == 50, F.col("l_tax")).alias("rare"), "l_shipdate")
    return rounded(Recipe.from_spec(spec).run({"main": main}), 4)


def station_panel(spark, sf):
    """Row sums and differences, logs, scaled columns, lags and rolling statistics per station, station facts, codes, medians."""
    ordered = {"target_col": "value_mean", "group_cols": ["station"], "time_col": "_hour_idx"}
    spec = recipe(
        ["main", "station_meta"],
        ("CreateFeature", ["s0"], {"source_cols": ["value_sum", "n"], "output_col": "load", "method": "sum"}),
        ("CreateFeature", ["o1"], {"source_cols": ["value_max", "value_min"], "output_col": "spread", "method": "diff"}),
        ("TransformPower", ["o2"], {"cols": ["n"], "output_cols": ["n_log"], "method": "log"}),
        ("ScaleFeature", ["o3"], {"cols": ["value_mean"], "method": "minmax", "feature_range": [0.0, 1.0]}),
        ("CreateLagFeature", ["o4"], {"lags": [1, 3], **ordered}),
        ("CreateRollingFeature", ["o5"], {"windows": [3, 6], "aggs": ["mean", "std", "min", "max"], **ordered}),
        ("DropColumns", ["s1"], {"cols": ["status"]}),
        ("JoinTable", ["o6", "o7"], {"key_col": "station", "prefix": "STATION", "max_cols": 20, "method": "agg", "agg_funcs": ["mean", "max"]}),
        ("CustomProcess", ["o8"], {"threshold": 0.7, "mode": "drop_high_null"}),
        ("LabelEncode", ["o9"], {"cols": ["wd", "station"], "order_cols": ["_hour_idx", "station"]}),
        ("HandleMV", ["o10"], {"method": "median"}),
        ("DropColumns", ["o11"], {"cols": ["_hour_ts"]}))
    panel = D.hourly_panel(table(spark, sf, "events"), "user_id", "ts", {"value": ["mean", "sum", "min", "max"]}, "n")
    panel = panel.withColumn("station", F.concat(F.lit("s"), F.col("user_id"))).drop("user_id").withColumn(
        "wd", F.element_at(F.array(*map(F.lit, "NESW")), F.pmod(F.col("_hour_idx") / 3600, F.lit(4)).cast("int") + 1))
    meta = table(spark, sf, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") * 2).alias("station"), F.col("o_totalprice").alias("price"),
                                             F.col("o_orderstatus").alias("status"))
    return rounded(Recipe.from_spec(spec).run({"main": panel, "station_meta": meta}), 4)


QUERIES = {"recipe_card_transactions": card_transactions, "recipe_station_panel": station_panel,
           "recipe_catalogue": catalogue_features, "recipe_interactions": interaction_features, "recipe_relational": relational_features,
           "recipe_hourly": hourly_features, "recipe_transactions": transaction_features, "recipe_monthly": monthly_history}

_ORDER = f"timestamp, {INTERACTION_KEY_SQL}"

_HISTORY = """coalesce(array_to_string(list({}) OVER (PARTITION BY user_id ORDER BY {} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), ','), '')"""

_FILLED = [*(f"lag_{k}" for k in (1, 3)), *(f"roll_{a}_{n}" for n in (3, 6) for a in ("mean", "std", "min", "max"))]

SQL = {
    "recipe_card_transactions": f"""WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice AS amount, nullif(l_quantity, 1.0) AS q,
          nullif(l_returnflag, 'A') AS flag, l_linestatus, l_shipdate FROM lineitem),
        k AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, amount) AS i FROM a),
        f AS (SELECT flag, row_number() OVER (ORDER BY min(i)) - 1 AS code, count(*) AS n FROM k WHERE flag IS NOT NULL GROUP BY 1),
        t AS (SELECT l_linestatus AS st, row_number() OVER (ORDER BY min(i)) - 1 AS code FROM k GROUP BY 1)
        SELECT l_orderkey, l_partkey, l_suppkey, {r('amount', 4)} AS amount, {r('coalesce(q, (SELECT median(q) FROM a))', 4)} AS quantity,
          coalesce(f.code, -1) AS flag, t.code AS l_linestatus, CAST(isodow(l_shipdate) - 1 AS INTEGER) AS l_shipdate_day_of_week,
          CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_month, {r('ln(1 + amount)', 4)} AS amount_log,
          count(*) OVER (PARTITION BY l_partkey) AS l_partkey_freq, count(*) OVER (PARTITION BY l_suppkey) AS l_suppkey_freq,
          coalesce(f.n, 0) AS flag_freq, CAST(CAST('0x' || md5(CAST(l_partkey AS VARCHAR))[1:16] AS UBIGINT) % 4096 AS INTEGER) AS h_l_partkey
        FROM k LEFT JOIN f ON k.flag = f.flag JOIN t ON t.st = l_linestatus""",
    "recipe_station_panel": f"""WITH p AS (SELECT 's' || user_id AS s, date_trunc('hour', ts) AS h, avg(value) AS m, sum(value) AS z, min(value) AS lo,
          max(value) AS hi, count(*) AS n FROM events GROUP BY 1, 2),
        o AS (SELECT 's' || o_custkey * 2 AS s, avg(o_totalprice) AS pm, max(o_totalprice) AS px FROM orders GROUP BY 1),
        x AS (SELECT * REPLACE ((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) AS m), CAST(epoch(h) AS BIGINT) AS idx FROM p),
        y AS (SELECT x.*, pm, px, 'NESW'[CAST(idx // 3600 % 4 AS INTEGER) + 1] AS wd, lag(m, 1) OVER w AS lag_1, lag(m, 3) OVER w AS lag_3,
          {', '.join(f"{f}(m) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS roll_{a}_{k}" for k in (3, 6)
                     for a, f in (('mean', 'avg'), ('std', 'stddev_samp'), ('min', 'min'), ('max', 'max')))}
          FROM x LEFT JOIN o USING (s) WINDOW w AS (PARTITION BY s ORDER BY idx)),
        c AS (SELECT s, row_number() OVER (ORDER BY min(idx), s) - 1 AS code FROM y GROUP BY 1),
        d AS (SELECT wd, row_number() OVER (ORDER BY min(idx)) - 1 AS code FROM y GROUP BY 1)
        SELECT c.code AS station, d.code AS wd, idx AS _hour_idx, {r('m', 4)} AS value_mean, {r('z', 4)} AS value_sum, {r('lo', 4)} AS value_min,
          {r('hi', 4)} AS value_max, n, {r('z + n', 4)} AS load, {r('hi - lo', 4)} AS spread, {r('ln(1 + n)', 4)} AS n_log,
          {', '.join(f"{r(f'coalesce({f}, (SELECT median({f}) FROM y))', 4)} AS value_mean_{f}" for f in _FILLED)},
          {r('coalesce(pm, (SELECT median(pm) FROM y))', 4)} AS "STATION_price_mean", {r('coalesce(px, (SELECT median(px) FROM y))', 4)} AS "STATION_price_max"
        FROM y JOIN c ON c.s = y.s JOIN d ON d.wd = y.wd""",
    "recipe_catalogue": k_core_sql(22, 40).replace("SELECT * FROM r40", f""", b AS (SELECT p_partkey AS k, coalesce(nullif(
          least(p_brand, 'Brand#' || p_size), 'Brand#11'), 'none') AS item_brand FROM part)
        SELECT user_id, item_id, timestamp, rating, l_orderkey, l_linenumber, l_suppkey, {r('l_extendedprice')} AS l_extendedprice,
        item_brand, {_HISTORY.format('CAST(item_id AS VARCHAR)', _ORDER)} AS item_id_seq,
        {_HISTORY.format('item_brand', _ORDER)} AS item_brand_seq FROM r40 LEFT JOIN b ON item_id = k"""),
    "recipe_interactions": k_core_sql(22, 40).replace("SELECT * FROM r40", f"""SELECT user_id, item_id, timestamp, rating, l_orderkey,
        l_linenumber, l_suppkey, {r('l_extendedprice')} AS l_extendedprice, p_brand AS item_brand, c_mktsegment AS user_segment,
        coalesce(array_to_string(list(CAST(item_id AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY {_ORDER}
          ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), ','), '') AS item_id_seq,
        lag(rating) OVER (PARTITION BY user_id ORDER BY {_ORDER}) AS rating_lag_1,
        {r(f'avg(rating) OVER (PARTITION BY user_id ORDER BY {_ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)')} AS rating_roll_mean_5
        FROM r40 LEFT JOIN customer ON user_id = c_custkey LEFT JOIN part ON item_id = p_partkey"""),
    "recipe_relational": f"""WITH h AS (SELECT o_custkey + CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 0 ELSE 20000000 END AS k,
          avg(o_totalprice) AS a, max(o_totalprice) AS x, count(DISTINCT o_orderstatus) AS u FROM orders GROUP BY 1),
        m AS (SELECT c.*, n_regionkey, a, x, u, c_custkey % 5 = 0 AS late FROM customer c LEFT JOIN h ON k = c_custkey
          LEFT JOIN nation ON n_nationkey = c_nationkey),
        s AS (SELECT median(a) AS ma, median(x) AS mx, avg(c_acctbal) AS mb, stddev_samp(c_acctbal) AS sb FROM m WHERE NOT late)
        SELECT c_custkey AS id, c_nationkey AS nation, {r('(c_acctbal - mb) / sb', 4)} AS balance,
          CASE WHEN late THEN 'std_test' ELSE 'train' END AS __split__, {r('coalesce(a, ma)', 4)} AS hist_price_mean,
          {r('coalesce(x, mx)', 4)} AS hist_price_max, u AS hist_status_nunique, n_regionkey AS region,
          {', '.join(f"(c_mktsegment = '{g}')::INT AS segment_{g}" for g in
                     ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM m, s""",
    "recipe_hourly": f"""WITH p AS (SELECT user_id, date_trunc('hour', ts) AS h, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, {r('v', 4)} AS value_mean, n, CAST(epoch(h) AS BIGINT) AS _hour_idx, CAST(hour(h) AS INTEGER) AS _hour_ts_hour,
          CAST(isodow(h) - 1 AS INTEGER) AS _hour_ts_day_of_week, (isodow(h) >= 6)::INT AS _hour_ts_is_weekend,
          coalesce(lag(n, 1) OVER w, 0) AS n_lag_1, coalesce(lag(n, 2) OVER w, 0) AS n_lag_2,
          {r('coalesce(avg(n) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.0)', 4)} AS n_roll_mean_3,
          coalesce(max(n) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS n_roll_max_3
        FROM p WINDOW w AS (PARTITION BY user_id ORDER BY h)""",
    "recipe_transactions": f"""WITH a AS (SELECT l.*, o_orderpriority AS p, (l_returnflag = 'R')::INT AS y,
          l_shipdate >= TIMESTAMP '2000-01-01' AS late FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey),
        q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi, avg(y) AS m
          FROM a WHERE NOT late),
        s AS (SELECT l_suppkey AS k, count(*) AS f, (sum(y) + max(m)) / (count(*) + 1) AS e FROM a, q WHERE NOT late GROUP BY 1)
        SELECT l_orderkey AS o_orderkey, l_linenumber, l_suppkey, CASE WHEN late THEN l_quantity ELSE least(greatest(l_quantity, 2.0), 49.0)
          END AS l_quantity, {r('least(greatest(l_extendedprice, lo), hi)', 4)} AS l_extendedprice, l_shipdate, y,
          CASE WHEN late THEN 'std_test' ELSE 'train' END AS __split__, coalesce(f, 0) AS l_suppkey_freq,
          CAST(CAST('0x' || md5(p)[1:16] AS UBIGINT) % 8 AS INTEGER) AS h_o_orderpriority, {r('coalesce(e, m)', 4)} AS l_suppkey_y
        FROM a CROSS JOIN q LEFT JOIN s ON l_suppkey = k""",
    "recipe_monthly": f"""WITH l AS (SELECT l_partkey AS k, l_quantity AS a, l_tax AS t FROM lineitem UNION ALL
          SELECT l_partkey, l_extendedprice, l_discount FROM lineitem),
        g AS (SELECT k, avg(a) AS am, stddev_samp(a) AS sa, avg(t) AS tm, stddev_samp(t) AS st FROM l GROUP BY 1)
        SELECT p_partkey AS l_partkey, p_size, {r('am', 4)} AS m_amount_mean, {r('sa', 4)} AS m_amount_std, {r('tm', 4)} AS m_rate_mean,
          {r('st', 4)} AS m_rate_std, {r('am / nullif(tm, 0.0)', 4)} AS per_rate FROM part LEFT JOIN g ON k = p_partkey""",
}
