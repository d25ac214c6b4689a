"""Jobs that build datasets from raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import operators as O
from millrace.plans import datasets as D

from .common import INTERACTIONS_SQL, LKEY, LKEY_SQL, draw_sql, interactions, r, rounded, table


def panel(spark, sf):
    e = table(spark, sf, "events").select("ts", F.nullif("user_id", F.lit(3)).alias("user_id"), "value")
    return rounded(D.hourly_panel(e, "user_id", "ts", {"value": ["mean", "sum", "min"]}, "n"), 4)


def range_cleaning(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY, "l_quantity", F.nullif("l_tax", F.lit(0.0)).alias("tax"), "l_shipdate")
    return D.within(l, {"l_extendedprice": (2000, 50000), "tax": (0.01, 0.06)}, ("l_shipdate", "1996-01-01", "1999-12-31"),
                    {"l_quantity": (5, 45)})


def range_then_quartiles(spark, sf):
    return D.within_then_iqr(table(spark, sf, "events"), "value", 1, 300, 1.5, ("ts", "2024-01-03", "2024-01-20"))


def busiest(spark, sf):
    return D.busiest(table(spark, sf, "orders"), "o_custkey", 20)


def fixed_sample(spark, sf):
    """Exactly a tenth of the events, each an original row, and no row twice."""
    e = table(spark, sf, "events")
    got = D.row_sample(e, e.count() // 10, keys=["event_id"])
    return got


def trips(spark, sf):
    e = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias(" starttime "),
                                          F.expr("o_orderdate + make_interval(0, 0, 0, 0, 0, o_custkey % 90, 1.5)").alias("stoptime"))
    return rounded(D.normalise_trips(e, {"starttime": "started_at", "stoptime": "ended_at"}), 3)


def long_form(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:4], "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    return D.wide_to_long(l, LKEY[:4], {"amount": ["l_quantity", "l_extendedprice"], "rate": ["l_discount", "l_tax"]}, "step")


def summary(spark, sf):
    c = table(spark, sf, "customer").select(F.nullif("c_nationkey", F.lit(2)).alias("nation"), "c_acctbal")
    return rounded(D.group_summary(c, "nation", ["c_acctbal"], "n"), 4)


def latest(spark, sf):
    return D.latest_per_key(table(spark, sf, "orders"), "o_custkey", "o_orderdate", ["o_orderkey"])


def status_labels(spark, sf):
    o = table(spark, sf, "orders")
    return D.label_from_status(o, "o_orderstatus", {"F": 0, "O": 1}, "target", drop=["o_orderstatus", "o_totalprice"])


def threshold_labels(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("y"))
    return D.binary_label(e, "y", 20)


def checked_labels(spark, sf):
    return D.binary_label(table(spark, sf, "labels"), "toxic", mode="passthrough")


def composite_key(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"),
                                          F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"))
    return D.time_key(e, "y", "m", "d", "h")


def cohort_statistics(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.lit(1).alias("_join_key"))
    c = table(spark, sf, "customer").select(F.lit(1).alias("_join_key"), "c_acctbal", "c_mktsegment")
    return rounded(O.JoinTable("agg", c, "_join_key", prefix="all").transform(s), 4)


def node_labels(spark, sf):
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(
        F.col("p_size") < 10, "1").when(F.col("p_size") < 20, "odd").when(F.col("p_size") == 20, " 2.0 ").alias("class"))
    c = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey").cast("string")).alias("id"), F.element_at(F.array(F.lit("unknown"), F.lit("1"), F.lit("2")),
                                                                      (F.col("p_partkey") % 3).cast("int") + 1).alias("class"))
    return D.attach_classes(n, c, "id")


def dense_ids(spark, sf):
    i = interactions(spark, sf).select("user_id", "l_orderkey", "l_linenumber", F.col("item_id").alias("k"))
    # Every other customer gets a key that no interaction has.
    u = table(spark, sf, "customer").select(
        (F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(20_000_000)).alias("user_id"), F.array(F.col("c_custkey") + 1, F.lit(10_000_000).cast("bigint"),
                                                     F.lit(None).cast("bigint")).alias("friends"))
    out = D.dense_ids({"a": i, "u": u}, "user_id", ["friends"])
    flat = out["u"].select("user_id", F.array_join(F.col("friends").cast("array<string>"), ",").alias("friends"))
    seen = out["a"].groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").cast("bigint").alias("k"))
    return seen.join(flat, "user_id", "full")


def token_numbers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.nullif("source", F.lit("web")).alias("source"),
                                             F.split("lang", "").alias("letters"), (F.col("doc_id") * 1000).alias("wide"))
    for name in ("source", "letters", "wide"):
        d = D.token_ids({"d": d}, name)["d"]
    return d.withColumn("letters", F.array_join(F.col("letters").cast("array<string>"), ","))


def edges(spark, sf):
    e = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    n = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey")).otherwise(
        -F.col("p_partkey")).alias("p_partkey"), "p_retailprice")
    return D.edge_index(e, "l_partkey", "l_suppkey", n, "p_partkey", ["p_partkey"])


def masks(spark, sf):
    n = table(spark, sf, "part").select("p_partkey", "p_size", ((F.col("p_partkey") % 3) - 1).alias("class"), F.when(
        F.col("p_partkey") % 10 == 0, "std_test").otherwise("train").alias("__split__"))
    return D.time_step_masks(n, "p_size")


QUERIES = {
    "b1_hourly_panel": panel, "b2_range_cleaning": range_cleaning, "b3_range_then_quartiles": range_then_quartiles,
    "b4_busiest": busiest, "b5_fixed_sample": fixed_sample, "b6_trips": trips, "b7_long_form": long_form,
    "b8_group_summary": summary, "b9_latest": latest, "b10_status_labels": status_labels,
    "b11_threshold_labels": threshold_labels, "b11_checked_labels": checked_labels, "b12_composite_key": composite_key,
    "b13_cohort_statistics": cohort_statistics, "b14_node_labels": node_labels, "b15_dense_ids": dense_ids,
    "b16_token_numbers": token_numbers, "b17_edge_index": edges, "b18_time_masks": masks,
}

SQL = {
    "b1_hourly_panel": f"""SELECT nullif(user_id, 3) AS user_id, date_trunc('hour', ts) AS _hour_ts, {r('avg(value)', 4)} AS value_mean,
        {r('sum(value)', 4)} AS value_sum, {r('min(value)', 4)} AS value_min, count(*) AS n,
        CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS _hour_idx FROM events GROUP BY 1, 2""",
    "b2_range_cleaning": f"""SELECT {LKEY_SQL}, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS l_quantity,
        nullif(l_tax, 0.0) AS tax, l_shipdate FROM lineitem WHERE l_extendedprice BETWEEN 2000 AND 50000
        AND nullif(l_tax, 0.0) BETWEEN 0.01 AND 0.06 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""",
    "b3_range_then_quartiles": """WITH a AS (SELECT * FROM events WHERE value BETWEEN 1 AND 300),
        b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM a)
        SELECT a.* FROM a, b WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
        AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20'""",
    "b4_busiest": """SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1
        ORDER BY count(*) DESC, o_custkey LIMIT 20)""",
    "b5_fixed_sample": f"SELECT * FROM events ORDER BY {draw_sql('event_id')} LIMIT (SELECT count(*) // 10 FROM events)",
    "b6_trips": """SELECT o_orderkey, o_orderdate AS started_at, o_orderdate + to_minutes(CAST(o_custkey % 90 AS INTEGER))
        + INTERVAL 1500 MILLISECOND AS ended_at, CAST(o_custkey % 90 * 60 + 1.5 AS DOUBLE) AS trip_duration FROM orders""",
    "b7_long_form": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS amount, l_discount AS rate, 0::INTEGER AS step
        FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax, 1 FROM lineitem""",
    "b8_group_summary": f"""SELECT c_nationkey AS nation, {r('avg(c_acctbal)', 4)} AS c_acctbal_mean, count(*) AS n
        FROM customer WHERE c_nationkey <> 2 GROUP BY 1""",
    "b9_latest": """SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
        o_orderkey DESC) = 1""",
    "b10_status_labels": """SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, CAST(o_orderstatus = 'O' AS INTEGER) AS target
        FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "b11_threshold_labels": "SELECT event_id, CAST(event_type <> 'view' AND value >= 20 AS INTEGER) AS y FROM events",
    "b11_checked_labels": "SELECT * FROM labels",
    "b12_composite_key": """SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d,
        CAST(hour(ts) AS INTEGER) AS h, CAST(strftime(ts, '%Y%m%d%H') AS BIGINT) AS time_key FROM events""",
    "b13_cohort_statistics": f"""SELECT s_suppkey, 1::INTEGER AS _join_key, {r('m', 4)} AS all_c_acctbal_mean, {r('x', 4)} AS all_c_acctbal_max,
        {r('n', 4)} AS all_c_acctbal_min, u AS all_c_mktsegment_nunique FROM supplier, (SELECT avg(c_acctbal) AS m,
        max(c_acctbal) AS x, min(c_acctbal) AS n, count(DISTINCT c_mktsegment) AS u FROM customer)""",
    "b14_node_labels": """SELECT p_partkey AS id, CAST(CASE WHEN p_size < 10 THEN 1 WHEN p_size = 20 THEN 0
        WHEN p_partkey % 3 = 1 THEN 1 WHEN p_partkey % 3 = 2 THEN 0 ELSE -1 END AS BIGINT) AS class FROM part""",
    "b15_dense_ids": f"""WITH {INTERACTIONS_SQL}, u AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 20000000 END AS u, c_custkey + 1 AS f FROM customer),
        v AS (SELECT user_id AS v FROM interactions UNION SELECT u FROM u UNION SELECT f FROM u UNION SELECT 10000000),
        n AS (SELECT v, row_number() OVER (ORDER BY CAST(v AS VARCHAR)) AS no FROM v),
        a AS (SELECT no AS user_id, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS k FROM interactions JOIN n ON user_id = v GROUP BY 1),
        b AS (SELECT x.no AS user_id, y.no || ',' || z.no || ',0' AS friends FROM u JOIN n x ON u = x.v JOIN n y ON f = y.v
          JOIN n z ON z.v = 10000000)
        SELECT user_id, n, k, friends FROM a FULL JOIN b USING (user_id)""",
    "b16_token_numbers": """WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS no FROM (SELECT DISTINCT source
          FROM documents WHERE source <> 'web')),
        l AS (SELECT x, row_number() OVER (ORDER BY x) AS no FROM (SELECT DISTINCT unnest(string_split(lang, '')) AS x FROM documents)),
        w AS (SELECT doc_id, row_number() OVER (ORDER BY CAST(doc_id * 1000 AS VARCHAR)) AS no FROM documents)
        SELECT d.doc_id, coalesce(s.no, 0) AS source, a.no || ',' || b.no AS letters, w.no AS wide
        FROM documents d LEFT JOIN s ON d.source = s.source JOIN l a ON lang[1] = a.x JOIN l b ON lang[2] = b.x
        JOIN w ON d.doc_id = w.doc_id""",
    "b17_edge_index": """WITH k AS (SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_partkey ELSE -p_partkey END AS k FROM part),
        n AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS no FROM k),
        e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
        SELECT a.no AS src, b.no AS dst FROM e JOIN n a ON l_partkey = a.k JOIN n b ON l_suppkey = b.k""",
    "b18_time_masks": """WITH n AS (SELECT p_partkey, p_size, p_partkey % 3 - 1 AS class, p_partkey % 10 = 0 AS held,
          p_partkey % 3 <> 0 AS known FROM part)
        SELECT p_partkey, p_size, class, CASE WHEN held THEN 'std_test' ELSE 'train' END AS __split__,
          known AND p_size <= 34 AND NOT held AS train_mask, known AND p_size BETWEEN 35 AND 39 AND NOT held AS val_mask,
          known AND p_size >= 40 AND NOT held AS test_mask, held AND known AS std_test_mask FROM n""",
}
