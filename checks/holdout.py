"""Hold-out splits, split-aware operators, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import operators as O
from millrace.plans import profile as P, splits as S
from millrace.plans.recipe import apply_with_split

from .common import (INTERACTION_KEY, INTERACTION_KEY_SQL, INTERACTIONS_SQL, LKEY, LKEY_SQL, draw_sql, interactions, r,
                     rounded, table, with_split)


def marked(train, held):
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("held")))


def stratified(spark, sf):
    o = table(spark, sf, "orders")
    return marked(*S.stratified_holdout(o, "o_orderstatus", ["o_orderkey"])).select("o_orderkey", "o_orderstatus", "part")


def stratified_repeated(spark, sf):
    """Keys that repeat: every row is still in exactly one part."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return marked(*S.stratified_holdout(o, "o_orderstatus", ["o_custkey"], 0.23))


def chronological(spark, sf):
    train, held, _ = S.chronological_tail(table(spark, sf, "orders"), "o_orderdate")
    return marked(train, held).select("o_orderkey", "part")


def positional(spark, sf):
    train, held = S.positional_tail(table(spark, sf, "lineitem"), ["l_shipdate", *LKEY])
    return marked(train, held).select(*LKEY, "part")


def labelled_nodes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    c = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(F.lit("unknown"), F.lit("1"), F.lit("2")),
                                                                  (F.col("p_partkey") % 3).cast("int") + 1).alias("class"))
    train, held = S.node_holdout(p, c, "p_partkey", "class")
    return marked(train.withColumn("class", F.lit(None).cast("string")), held)


def late_positives(spark, sf):
    train, held = S.recent_positives(interactions(spark, sf), ["timestamp", *INTERACTION_KEY], "rating", min_train=25)
    return marked(train, held)


def late_negatives(spark, sf):
    """Two distinct unseen training items per held-out positive."""
    train, held = S.recent_positives(interactions(spark, sf), ["timestamp", *INTERACTION_KEY], "rating", min_train=25)
    out = S.holdout_negatives(held, train, n=2, keys=INTERACTION_KEY)
    known = train.select(F.col("user_id").alias("u"), F.col("item_id").alias("i")).distinct()
    clash = out.join(known, (F.col("user_id") == F.col("u")) & (F.col("item_id") == F.col("i")), "left_semi").count()
    return out.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("clashes", F.lit(clash).cast("bigint"))


def full_negatives(spark, sf):
    """Columns of drawn rows; every (user, item) pair stands for a drawn one."""
    i = interactions(spark, sf).withColumns({"user_group": F.col("user_id") % 5, "item_size": F.col("item_id") % 7})
    pairs = table(spark, sf, "lineitem").select((F.col("l_suppkey") + 0).alias("user_id"), F.col("l_partkey").alias("item_id")).distinct()
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("bigint").alias("user_group"))
    return S.materialise_negatives(pairs, i, i, "rating", users=users)


def attached(spark, sf):
    o = table(spark, sf, "orders")
    train = o.where("o_orderkey % 5 <> 0").drop("o_orderpriority")
    held = o.where("o_orderkey % 5 = 0").drop("o_orderstatus")
    return S.attach_holdout(train, held)


def split_aware(spark, sf):
    """Scaling learned on training rows, a group statistic over all rows, a train-only filter."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice")
    o = with_split(o, "o_orderdate", "2000-01-01")
    o = apply_with_split(O.AggregateGroupFeature("o_custkey", ["o_totalprice"], ["count"]), o)
    o = apply_with_split(O.ScaleFeature("o_totalprice", "minmax"), o)
    o = apply_with_split(O.FilterSample(query="o_totalprice > 0.5"), o)
    return rounded(o)


def split_aware_rec(spark, sf):
    """Interaction tables: a statistic across rows is taken within each split."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_totalprice")
    o = with_split(o, "o_orderdate", "2000-01-01")
    return rounded(apply_with_split(O.AggregateGroupFeature("o_custkey", ["o_totalprice"], ["count", "max"]), o, "rec"))


def known_only(spark, sf):
    i = with_split(interactions(spark, sf), "timestamp", "2000-01-01")
    late = F.col("__split__") == "std_test"
    i = i.withColumn("user_id", F.when(~late & (F.col("user_id") % 9 == 0), -F.col("user_id")).otherwise(F.col("user_id")))
    i = i.withColumn("rating", F.when(late & (F.col("user_id") % 3 == 1), 0).otherwise(F.col("rating")))
    return S.keep_known(i, "user_id", "item_id", "rating")


def separated(spark, sf):
    o = with_split(table(spark, sf, "orders"), "o_orderdate", "2000-01-01")
    parts = S.split_tables(o)
    return parts["train"].withColumn("part", F.lit("train")).unionByName(
        parts["std_test"].withColumn("part", F.lit("std_test"))).select("o_orderkey", "part")


def budget(spark, sf):
    o = with_split(table(spark, sf, "orders"), "o_orderdate", "2000-01-01")
    n = o.count() // 20
    return S.budget_sample(o, n, "o_orderstatus", keys=["o_orderkey"]).select("o_orderkey", "o_orderstatus", "__split__")


def budget_recent(spark, sf):
    i = with_split(interactions(spark, sf), "timestamp", "2000-01-01")
    n = i.count() // 10
    order = [(c, "desc") for c in ["timestamp", *INTERACTION_KEY]]
    return S.budget_sample_recent(i, n, order, "user_id", "rating", keys=INTERACTION_KEY)


def table_facts(spark, sf):
    o = table(spark, sf, "orders").select("*", F.nullif("o_orderstatus", F.lit("P")).alias("st"))
    return rounded(P.table_summary(o))


def target_facts(spark, sf):
    return P.target_distribution(table(spark, sf, "labels"), "quality")


def statistics(spark, sf):
    l = table(spark, sf, "lineitem").select("*", (F.col("l_quantity") - 25).alias("y"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return rounded(P.dataset_statistics(l, "y", n_aux=2, time_col="l_shipdate"), 5)


def observed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("st"))
    schema, _ = P.observation(o, ["o_orderkey"])
    return rounded(schema)


def observed_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return P.observation(o, ["o_totalprice", "o_orderkey"])[1]


QUERIES = {
    "h1_stratified": stratified, "h1_stratified_repeated_keys": stratified_repeated, "h2_chronological": chronological, "h3_positional": positional,
    "h4_labelled_nodes": labelled_nodes, "h5_late_positives": late_positives, "h6_late_negatives": late_negatives,
    "h7_full_negatives": full_negatives, "h8_attached": attached, "h9_split_aware": split_aware,
    "h9_split_aware_rec": split_aware_rec, "h10_known_only": known_only, "h11_separated": separated,
    "h12_budget": budget, "h12_budget_recent": budget_recent, "r1_table_facts": table_facts,
    "r1_target_facts": target_facts, "r2_statistics": statistics, "r3_observed": observed, "r3_observed_rows": observed_rows,
}

_LATE = f"""WITH {INTERACTIONS_SQL},
  p AS (SELECT *, row_number() OVER (ORDER BY timestamp, {INTERACTION_KEY_SQL}) - 1 AS pos, count(*) OVER () AS n FROM interactions),
  t AS (SELECT * EXCLUDE (pos, n) FROM p WHERE pos < CAST(floor(n * 0.8) AS BIGINT)),
  h AS (SELECT * EXCLUDE (pos, n) FROM p WHERE pos >= CAST(floor(n * 0.8) AS BIGINT) AND rating = 1
    AND user_id IN (SELECT user_id FROM t GROUP BY 1 HAVING count(*) >= 25) AND item_id IN (SELECT item_id FROM t))"""


def stratified_sql(key, fraction, columns):
    return f"""WITH c AS (SELECT o_orderstatus, count(*) AS k, sum(count(*)) OVER () AS n FROM orders GROUP BY 1),
        e AS (SELECT *, k * (n - ceil(n * {fraction})) / n AS x FROM c),
        f AS (SELECT *, floor(x) + CAST(row_number() OVER (ORDER BY floor(x) - x, o_orderstatus)
          <= (n - ceil(n * {fraction})) - sum(floor(x)) OVER () AS INTEGER) AS t FROM e)
        SELECT {columns}, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw_sql(key)}, {key}, o_orderkey) <= k - t
          THEN 'held' ELSE 'train' END AS part FROM orders JOIN f USING (o_orderstatus)"""


SQL = {
    "h1_stratified": stratified_sql("o_orderkey", 0.2, "o_orderkey, o_orderstatus"),
    "h1_stratified_repeated_keys": stratified_sql("o_custkey", 0.23, "o_orderkey, o_custkey, o_orderstatus"),
    "h2_chronological": """WITH u AS (SELECT o_orderdate AS d, row_number() OVER (ORDER BY o_orderdate) - 1 AS i, count(*) OVER () AS n
          FROM (SELECT DISTINCT o_orderdate FROM orders)), c AS (SELECT d FROM u WHERE i = CAST(floor(n * 0.8) AS BIGINT))
        SELECT o_orderkey, CASE WHEN o_orderdate < (SELECT d FROM c) THEN 'train' ELSE 'held' END AS part FROM orders""",
    "h3_positional": f"""SELECT {LKEY_SQL}, CASE WHEN row_number() OVER (ORDER BY l_shipdate, {LKEY_SQL}) - 1 <
        CAST(floor(count(*) OVER () * 0.8) AS BIGINT) THEN 'train' ELSE 'held' END AS part FROM lineitem""",
    "h4_labelled_nodes": f"""WITH c AS (SELECT p_partkey, p_size, CAST(p_partkey % 3 AS VARCHAR) AS class FROM part),
          h AS (SELECT *, 'held' AS part FROM c WHERE class <> '0' QUALIFY row_number() OVER (ORDER BY {draw_sql('p_partkey')}) <=
            (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM c WHERE class <> '0'))
        SELECT * FROM h UNION ALL SELECT p_partkey, p_size, NULL, 'train' FROM c WHERE p_partkey NOT IN (SELECT p_partkey FROM h)""",
    "h5_late_positives": f"{_LATE} SELECT *, 'train' AS part FROM t UNION ALL SELECT *, 'held' FROM h",
    "h6_late_negatives": f"{_LATE} SELECT user_id, 2 * count(*) AS n, 0::BIGINT AS clashes FROM h GROUP BY 1",
    "h7_full_negatives": """SELECT DISTINCT l_suppkey AS user_id, l_partkey AS item_id, NULL::TIMESTAMP AS timestamp, 0::INTEGER AS rating,
        0::BIGINT AS l_orderkey, 0::INTEGER AS l_linenumber, 0::BIGINT AS l_suppkey, 0.0::DOUBLE AS l_extendedprice,
        CAST(c_nationkey AS BIGINT) AS user_group, NULL::BIGINT AS item_size FROM lineitem LEFT JOIN customer ON l_suppkey = c_custkey""",
    "h8_attached": """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice,
        o_orderdate, CASE WHEN o_orderkey % 5 = 0 THEN 'std_test' ELSE 'train' END AS __split__,
        CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders""",
    "h9_split_aware": f"""WITH o AS (SELECT o_orderkey, o_orderdate, o_custkey, o_totalprice, CASE WHEN o_orderdate >=
          TIMESTAMP '2000-01-01' THEN 'std_test' ELSE 'train' END AS __split__, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
        m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM o WHERE __split__ = 'train'),
        s AS (SELECT o.*, (o_totalprice - lo) / (hi - lo) AS v FROM o, m)
        SELECT o_orderkey, o_orderdate, o_custkey, {r('v')} AS o_totalprice, __split__, c AS o_totalprice_count
        FROM s WHERE __split__ = 'std_test' OR v > 0.5""",
    "h9_split_aware_rec": f"""WITH o AS (SELECT o_orderkey, o_orderdate, o_custkey, o_totalprice, CASE WHEN o_orderdate >=
          TIMESTAMP '2000-01-01' THEN 'std_test' ELSE 'train' END AS __split__ FROM orders)
        SELECT o_orderkey, o_orderdate, o_custkey, {r('o_totalprice')} AS o_totalprice, __split__, count(*) OVER w AS o_totalprice_count,
          {r('max(o_totalprice) OVER w')} AS o_totalprice_max FROM o WINDOW w AS (PARTITION BY o_custkey, __split__)""",
    "h10_known_only": f"""WITH {INTERACTIONS_SQL}, i AS (SELECT * REPLACE (CASE WHEN user_id % 9 = 0 AND timestamp <
          TIMESTAMP '2000-01-01' THEN -user_id ELSE user_id END AS user_id), CASE WHEN timestamp >= TIMESTAMP '2000-01-01'
          THEN 'std_test' ELSE 'train' END AS __split__ FROM interactions),
        j AS (SELECT * REPLACE (CASE WHEN __split__ = 'std_test' AND user_id % 3 = 1 THEN 0 ELSE rating END AS rating) FROM i),
        t AS (SELECT * FROM j WHERE __split__ = 'train'), h AS (SELECT * FROM j WHERE __split__ = 'std_test'
          AND user_id IN (SELECT user_id FROM t) AND item_id IN (SELECT item_id FROM t))
        SELECT * FROM t UNION ALL SELECT * FROM h WHERE user_id IN (SELECT user_id FROM h WHERE rating = 1)""",
    "h11_separated": """SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'std_test' ELSE 'train' END AS part
        FROM orders""",
    "h12_budget": f"""WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'std_test'
          ELSE 'train' END AS __split__, {draw_sql('o_orderkey')} AS d FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY __split__, CASE WHEN __split__ = 'train' THEN '' ELSE o_orderstatus END ORDER BY d) AS i,
          (SELECT count(*) // 20 FROM orders) AS n FROM o)
        SELECT o_orderkey, o_orderstatus, __split__ FROM r WHERE i <= CASE WHEN __split__ = 'train' THEN n ELSE (n // 2) // 3 END""",
    "h12_budget_recent": f"""WITH {INTERACTIONS_SQL}, b AS (SELECT count(*) // 10 AS n FROM interactions),
        t AS (SELECT * FROM interactions WHERE timestamp < TIMESTAMP '2000-01-01'
          ORDER BY timestamp DESC, {', '.join(c + ' DESC' for c in INTERACTION_KEY)} LIMIT (SELECT n FROM b)),
        h AS (SELECT *, {draw_sql(INTERACTION_KEY_SQL)} AS d FROM interactions WHERE timestamp >= TIMESTAMP '2000-01-01'),
        p AS (SELECT user_id FROM h WHERE rating = 1 QUALIFY row_number() OVER (ORDER BY d) <= greatest(1, (SELECT n // 101 FROM b))),
        u AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY d) AS i, count(*) OVER () AS c,
          count(*) FILTER (rating = 1) OVER () AS k FROM h WHERE user_id IN (SELECT user_id FROM p)),
        s AS (SELECT * EXCLUDE (d, i, c, k) FROM u, b WHERE c <= b.n OR rating = 1 OR i <= greatest(0, b.n - k))
        SELECT *, 'train' AS __split__ FROM t
        UNION ALL SELECT * EXCLUDE (n), 'std_test' FROM s WHERE (SELECT count(*) FROM h) > (SELECT n FROM b)
        UNION ALL SELECT * EXCLUDE (d), 'std_test' FROM h WHERE (SELECT count(*) FROM h) <= (SELECT n FROM b)""",
    "r1_table_facts": f"""SELECT count(*) AS n_rows, 7::BIGINT AS n_columns, 3::BIGINT AS n_numeric, 3::BIGINT AS n_text,
        1::BIGINT AS n_other, {r("avg(CAST(o_orderstatus = 'P' AS INTEGER)) / 7")} AS null_ratio FROM orders""",
    "r1_target_facts": "SELECT CAST(quality AS VARCHAR) AS value, count(*) AS n_rows FROM labels GROUP BY 1",
    "r2_statistics": f"""SELECT 1.0::DOUBLE AS is_tabular, 0.0::DOUBLE AS is_rec, {r('ln(11)', 5)} AS log_numeric,
        {r('ln(3)', 5)} AS log_categorical, 0.0::DOUBLE AS log_list, 0.0::DOUBLE AS log_text, {r('log10(count(*))', 5)} AS log10_rows,
        {r('log10(13)', 5)} AS log10_columns, {r('avg((l_tax = 0)::INT) / 13', 5)} AS null_ratio, 0.0::DOUBLE AS has_user,
        0.0::DOUBLE AS has_item, 1.0::DOUBLE AS has_aux, {r('avg(l_quantity - 25)', 5)} AS target_mean,
        {r('stddev_samp(l_quantity - 25)', 5)} AS target_std, {r('avg((l_quantity > 25)::INT)', 5)} AS positive_share,
        1.0::DOUBLE AS has_target, 1.0::DOUBLE AS has_time, 0.0::DOUBLE AS has_id FROM lineitem""",
    "r3_observed": f"""SELECT 'o_orderkey' AS "column", 'bigint' AS type, 0.0::DOUBLE AS null_ratio UNION ALL
        SELECT 'o_custkey', 'bigint', 0.0 UNION ALL
        SELECT 'st', 'string', {r("avg((o_orderstatus = 'P')::INT)")} FROM orders""",
    "r3_observed_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5",
}
