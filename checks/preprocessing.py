"""Encoders, scalers, bins, filters and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import operators as O
from millrace.operators import numeric as N

from .common import (INTERACTION_KEY, INTERACTION_KEY_SQL, INTERACTIONS_SQL, LKEY, LKEY_SQL, draw_sql, interactions, r,
                     rounded, table, with_split)


def one_hot(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("st"), "o_orderpriority")
    return O.OneHotEncode(["st", "o_orderpriority"], max_cardinality=4).transform(o)


def one_hot_held_out(spark, sf):
    """Categories from training rows only; held-out rows align to them."""
    from millrace.plans.recipe import apply_with_split
    o = with_split(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderdate", "2000-01-01")
    o = o.withColumn("o_orderpriority", F.when(F.col("__split__") == "std_test", F.concat("o_orderpriority", F.lit("x")))
                     .otherwise(F.col("o_orderpriority")))
    return apply_with_split(O.OneHotEncode("o_orderpriority"), o)


def ordinal(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return O.OrdinalEncode(["o_orderpriority", "o_orderstatus"], {"o_orderpriority": ["5-LOW", "3-MEDIUM", "1-URGENT"]},
                           order_cols=["o_orderkey"]).transform(o)


def label_codes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("st"), "o_orderpriority")
    return O.LabelEncode(order_cols=["o_orderkey"]).transform(o)


def label_codes_many(spark, sf):
    """As many codes as customers: a joined table, not a literal map."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return O.LabelEncode(["c_name"], ["c_acctbal", "c_custkey"]).transform(c)


def hash_codes(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_name")
    return O.HashEncode(["seg", "c_name", "c_custkey"], n_buckets=97).transform(c)


def target_means(spark, sf):
    from millrace.plans.recipe import apply_with_split
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                          (F.col("o_totalprice") / 1000).alias("y"))
    o = with_split(o, "o_orderdate", "1999-01-01")
    return rounded(apply_with_split(O.TargetEncode(["o_custkey", "o_orderstatus"], "y", 2.0), o))


def frequencies(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY, F.nullif("l_returnflag", F.lit("A")).alias("flag"))
    return O.FrequencyEncode(["l_partkey", "flag"]).transform(l)


def scaled(method, **kw):
    def run(spark, sf):
        l = table(spark, sf, "lineitem").select(*LKEY[:4], F.nullif("l_quantity", F.lit(1.0)).alias("q_a"),
                                                (F.col("l_extendedprice") - 5000).alias("q_b"))
        return rounded(O.ScaleFeature(method=method, pattern="q_", **kw).transform(l))
    return run


def logarithm(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") - F.lit(0.5)).alias("value"))
    return rounded(O.TransformPower("value", "log", offset=0.0, output_cols="lv").transform(e))


def square_root(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") - 50).alias("value"))
    return rounded(O.TransformPower("value", "sqrt", offset=1.0).transform(e))


def quantile_shape(shape):
    def run(spark, sf):
        e = table(spark, sf, "events").select("event_id", F.round("value", 0).alias("value"))
        return rounded(O.TransformPower("value", "quantile", output_distribution=shape).transform(e), 4)
    return run


def bins(strategy, **kw):
    def run(spark, sf):
        e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
        return O.DiscretizeFeature("value", strategy=strategy, **kw).transform(e)
    return run


def clipped(spark, sf):
    from millrace.plans.recipe import apply_with_split
    e = table(spark, sf, "events").select("event_id", "ts", F.nullif("value", F.lit(1.0)).alias("value"))
    return rounded(apply_with_split(O.ClipOutlier("value", 0.05, 0.9), with_split(e, "ts", "2024-01-20")))


def filtered(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY, "l_quantity", F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return O.FilterSample(subset=["flag"]).transform(O.FilterSample(query="l_quantity > 30 AND l_linenumber <> 2").transform(l))


def negatives(spark, sf):
    """Checks of the sample: size, labels, zeroed numbers, and no drawn item that the user has."""
    i = interactions(spark, sf).select(*INTERACTION_KEY, "user_id", "timestamp", "rating")
    i = i.withColumns({"clicks": F.col("rating") + 5, "item_size": F.col("item_id") % 7})
    out = O.SampleNegative(n_negatives=2, key_cols=INTERACTION_KEY, order_cols=INTERACTION_KEY).transform(i)
    drawn = out.where("clicks = 0")
    known = i.select(F.col("user_id").alias("u"), F.col("item_id").alias("i"))
    clash = drawn.join(known, (F.col("user_id") == F.col("u")) & (F.col("item_id") == F.col("i")), "left_semi")
    return out.agg(F.count("*").alias("n"), F.count(F.when(F.col("clicks") == 0, 1)).alias("n_drawn"),
                   F.sum(F.when(F.col("clicks") == 0, F.col("rating"))).alias("drawn_ratings"),
                   F.count(F.when(F.col("item_size") != F.col("item_id") % 7, 1)).alias("wrong_features")) \
        .withColumn("clashes", F.lit(clash.count()).cast("bigint"))


def k_core(spark, sf):
    """k follows the average activity, so several rounds remove rows at every scale."""
    i = interactions(spark, sf)
    return O.FilterKCore(k=22).transform(i)


def k_core_users(spark, sf):
    return O.FilterKCore(item_col=None, k=45).transform(interactions(spark, sf))


def balanced_down(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("y", (F.col("l_quantity") > 40).cast("int"))
    return O.Undersample("y", key_cols=LKEY).transform(l).select(*LKEY, "y")


def balanced_up(spark, sf):
    """Every row of the balanced table, over many classes."""
    l = table(spark, sf, "lineitem").select(*LKEY, F.floor(F.col("l_quantity") / 4).cast("int").alias("y"))
    return O.Oversample("y", key_cols=LKEY).transform(l)


def mixed(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value", (F.col("user_id") % 2).alias("y"))
    out = O.AugmentMixup("y", cols=["value"], key_cols=["event_id"]).transform(e)
    new = out.where("event_id IS NULL")
    facts = e.agg(F.avg("value").alias("mean"), F.min("value").alias("least")).first()
    return new.agg(F.count("*").alias("n"), F.count("event_type").alias("n_types"),
                   F.min(F.col("y").between(0, 1)).alias("labels_ok"), (F.min("value") >= facts["least"]).alias("low_ok"),
                   (F.abs(F.avg("value") / F.lit(facts["mean"]) - 1) < 0.1).alias("mean_ok"))


def noise_free_copies(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return O.AugmentNoise("value", noise_scale=0.0, n_copies=2).transform(e)


def noisy_copies(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    out = O.AugmentNoise("value", noise_type="jitter", noise_scale=0.5, key_cols=["event_id"]).transform(e)
    std = e.agg(F.stddev_samp("value")).first()[0]
    spread = out.groupBy("event_id").agg((F.max("value") - F.min("value")).alias("d"), F.count("*").alias("n"))
    return spread.agg(F.sum("n").alias("n"), (F.max("d") <= std * 0.5).alias("bounded"),
                      (F.avg("d") > std * 0.1).alias("moved"))


def null_columns_dropped(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("rare"),
                                          F.when(F.col("event_type") != "view", F.col("value")).alias("common"))
    return O.CustomProcess(mode="drop_high_null", threshold=0.5).transform(e)


def custom_process(spark, sf):
    return O.CustomProcess(lambda d: d.where("r_regionkey > 1")).transform(table(spark, sf, "region"))


QUERIES = {
    "p1_one_hot": one_hot, "p1_one_hot_held_out": one_hot_held_out, "p2_ordinal": ordinal,
    "p3_label_codes": label_codes, "p3_label_codes_many": label_codes_many, "p4_hash_codes": hash_codes,
    "p5_target_means": target_means, "p6_frequencies": frequencies,
    "p7_scaled_standard": scaled("standard"), "p7_scaled_minmax": scaled("minmax", feature_range=(-1, 1)),
    "p7_scaled_maxabs": scaled("maxabs"), "p7_scaled_robust": scaled("robust"), "p8_scaled_unit_rows": scaled("l2"),
    "p9_logarithm": logarithm, "p9_square_root": square_root,
    "p10_quantile_uniform": quantile_shape("uniform"), "p10_quantile_normal": quantile_shape("normal"),
    "p11_bins_manual": bins("manual", boundaries={"value": [5, 20, 80.5]}),
    "p11_bins_uniform": bins("uniform", n_bins=6), "p11_bins_quantile": bins("quantile", n_bins=7),
    "p12_bins_clustered": bins("kmeans", n_bins=4), "p13_clipped": clipped, "p14_filtered": filtered,
    "p15_negatives": negatives, "p16_k_core": k_core, "p16_k_core_users": k_core_users,
    "p17_balanced_down": balanced_down, "p20_balanced_up": balanced_up, "p23_mixed": mixed,
    "p24_copies_without_noise": noise_free_copies, "p24_copies_with_noise": noisy_copies,
    "p25_null_columns_dropped": null_columns_dropped, "p26_custom_callable": custom_process,
}

_SCALE_ROWS = """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_quantity, 1.0) AS q_a,
  l_extendedprice - 5000 AS q_b FROM lineitem)"""


def scale_sql(params, expr):
    def one(c):
        return f"{r(expr.replace('{c}', c))} AS {c}"
    stats = ", ".join(p.replace("{c}", c) for c in ("q_a", "q_b") for p in params)
    return f"{_SCALE_ROWS}, m AS (SELECT {stats} FROM a) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " \
           f"{one('q_a')}, {one('q_b')} FROM a, m"


def one_hot_columns(source, values, name):
    return ", ".join(f"""CAST(coalesce({source} = '{v}', false) AS INTEGER) AS "{name}_{v}" """ for v in values)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def horner(values, x):
    out = repr(values[0])
    for v in values[1:]:
        out = f"({out} * {x} + {v!r})"
    return out


def normal_sql(p):
    """Inverse normal distribution of a column, by the operator's rational approximation."""
    q, far = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    inner = f"{q} * {horner(N.INNER_TOP, f'({q} * {q})')} / {horner(N.INNER_BOTTOM, f'({q} * {q})')}"
    outer = f"{horner(N.OUTER_TOP, far)} / {horner(N.OUTER_BOTTOM, far)}"
    return f"CASE WHEN {p} < {N.OUTER_BELOW} THEN {outer} WHEN {p} > 1 - {N.OUTER_BELOW} THEN -({outer}) ELSE {inner} END"


def quantile_sql(made="u"):
    """Place values on a grid of 1000 quantiles, averaging the lower and upper position of equal values."""
    return f"""WITH e AS (SELECT event_id, round(value, 0) AS v FROM events),
      g AS (SELECT i, i / 999.0 AS ref, q[i + 1] AS q FROM (SELECT quantile_cont(v, {[i / 999 for i in range(1000)]}) AS q
        FROM e), range(1000) t(i)),
      lo AS (SELECT d.v, max(g.i) AS a FROM (SELECT DISTINCT v FROM e) d JOIN g ON g.q <= d.v GROUP BY 1),
      hi AS (SELECT d.v, min(g.i) AS b FROM (SELECT DISTINCT v FROM e) d JOIN g ON g.q >= d.v GROUP BY 1),
      p AS (SELECT lo.v, a, b, ga.q AS qa, gb.q AS qb FROM lo JOIN hi ON lo.v = hi.v JOIN g ga ON ga.i = a
        JOIN g gb ON gb.i = b),
      x AS (SELECT (SELECT min(v) FROM e) AS mn, (SELECT max(v) FROM e) AS mx),
      s AS (SELECT v, CASE WHEN v = mn THEN 0.0 WHEN v = mx THEN 1.0 WHEN qa = qb THEN (a + b) / 2.0 / 999
        ELSE (a + (v - qa) / (qb - qa) * (b - a)) / 999 END AS u FROM p, x)
      SELECT event_id, {r(made, 4)} AS value FROM e JOIN
        (SELECT v, u, CAST(least(greatest(u, 1e-7), 1 - 1e-7) AS DOUBLE) AS p FROM s) USING (v)"""


SQL = {
    "p1_one_hot": f"""SELECT o_orderkey, o_orderpriority, {one_hot_columns("nullif(o_orderstatus, 'P')", ['F', 'O'], 'st')}
        FROM orders""",
    "p1_one_hot_held_out": f"""WITH a AS (SELECT o_orderkey, o_orderdate, o_orderdate >= TIMESTAMP '2000-01-01' AS late,
          o_orderpriority AS p FROM orders) SELECT o_orderkey, o_orderdate, CASE WHEN late THEN 'std_test' ELSE 'train' END
          AS __split__, {one_hot_columns("CASE WHEN NOT late THEN p END", PRIORITIES, 'o_orderpriority')} FROM a""",
    "p2_ordinal": """WITH f AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code
          FROM orders GROUP BY 1)
        SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2
          ELSE -1 END AS BIGINT) AS o_orderpriority, code AS o_orderstatus FROM orders JOIN f ON o_orderstatus = s""",
    "p3_label_codes": """WITH a AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st, o_orderpriority AS p FROM orders),
        f AS (SELECT st, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM a WHERE st IS NOT NULL GROUP BY 1),
        g AS (SELECT p, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM a GROUP BY 1)
        SELECT o_orderkey, coalesce(f.code, -1) AS st, g.code AS o_orderpriority
        FROM a LEFT JOIN f ON a.st = f.st LEFT JOIN g ON a.p = g.p""",
    "p3_label_codes_many": """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS c_name, c_acctbal
        FROM customer""",
    "p4_hash_codes": """WITH a AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_name FROM customer)
        SELECT *, CAST(coalesce(CAST('0x' || md5(seg)[1:16] AS UBIGINT) % 97, 0) AS INTEGER) AS h_seg,
          CAST(CAST('0x' || md5(c_name)[1:16] AS UBIGINT) % 97 AS INTEGER) AS h_c_name,
          CAST(CAST('0x' || md5(CAST(c_custkey AS VARCHAR))[1:16] AS UBIGINT) % 97 AS INTEGER) AS h_c_custkey FROM a""",
    "p5_target_means": f"""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice / 1000 AS y,
          CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'std_test' ELSE 'train' END AS __split__ FROM orders),
        t AS (SELECT * FROM a WHERE __split__ = 'train'), g AS (SELECT avg(y) AS m FROM t),
        c AS (SELECT o_custkey AS k, (sum(y) + 2 * max(m)) / (count(*) + 2) AS e FROM t, g GROUP BY 1),
        s AS (SELECT o_orderstatus AS k, (sum(y) + 2 * max(m)) / (count(*) + 2) AS e FROM t, g GROUP BY 1)
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, {r('y')} AS y, __split__,
          {r('coalesce(c.e, m)')} AS o_custkey_y, {r('coalesce(s.e, m)')} AS o_orderstatus_y
        FROM a CROSS JOIN g LEFT JOIN c ON o_custkey = c.k LEFT JOIN s ON o_orderstatus = s.k""",
    "p6_frequencies": f"""WITH a AS (SELECT {LKEY_SQL}, nullif(l_returnflag, 'A') AS flag FROM lineitem)
        SELECT *, count(*) OVER (PARTITION BY l_partkey) AS l_partkey_freq,
          CASE WHEN flag IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY flag) END AS flag_freq FROM a""",
    "p7_scaled_standard": scale_sql(["avg({c}) AS m_{c}", "stddev_samp({c}) AS s_{c}"], "({c} - m_{c}) / s_{c}"),
    "p7_scaled_minmax": scale_sql(["min({c}) AS m_{c}", "max({c}) AS s_{c}"], "({c} - m_{c}) / (s_{c} - m_{c}) * 2 - 1"),
    "p7_scaled_maxabs": scale_sql(["max(abs({c})) AS m_{c}"], "{c} / m_{c}"),
    "p7_scaled_robust": scale_sql(["median({c}) AS m_{c}", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}"],
                                  "({c} - m_{c}) / s_{c}"),
    "p8_scaled_unit_rows": f"""{_SCALE_ROWS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        {r("coalesce(q_a, 0.0) / n")} AS q_a, {r("coalesce(q_b, 0.0) / n")} AS q_b
        FROM (SELECT *, coalesce(nullif(sqrt(coalesce(q_a, 0.0) ** 2 + q_b ** 2), 0.0), 1.0) AS n FROM a)""",
    "p9_logarithm": f"""SELECT event_id, {r('value - 0.5')} AS value, CASE WHEN value - CAST(0.5 AS DOUBLE) = 0
        THEN CAST('-inf' AS DOUBLE) WHEN value > 0.5 THEN {r('ln(value - 0.5)')} END AS lv FROM events""",
    "p9_square_root": f"SELECT event_id, {r('sqrt(greatest(value - 49, 0.0))')} AS value FROM events",
    "p10_quantile_uniform": quantile_sql(), "p10_quantile_normal": quantile_sql(normal_sql("p")),
    "p11_bins_manual": """SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST((value >= 5)::INT + (value >= 20)::INT
        + (value >= 80.5)::INT AS BIGINT) ELSE -1 END AS value FROM events""",
    "p11_bins_uniform": """WITH a AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM events),
        m AS (SELECT min(v) AS lo, max(v) AS hi FROM a) SELECT event_id, CASE WHEN v IS NULL THEN -1
        ELSE least(CAST(floor((v - lo) / (hi - lo) * 6) AS BIGINT), 5) END AS value FROM a, m""",
    "p11_bins_quantile": """WITH a AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM events),
        m AS (SELECT quantile_cont(v, [1/7, 2/7, 3/7, 4/7, 5/7, 6/7]) AS q FROM a)
        SELECT event_id, CASE WHEN v IS NULL THEN -1 ELSE CAST(len(list_filter(q, lambda x: v >= x)) AS BIGINT) END AS value
        FROM a, m""",
    "p12_bins_clustered": """WITH RECURSIVE a AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM events),
        w AS (SELECT v, count(*) AS c FROM a WHERE v IS NOT NULL GROUP BY v),
        m AS (SELECT min(v) AS lo, max(v) AS hi, 1e-4 * (sum(c * v * v) / sum(c) - pow(sum(c * v) / sum(c), 2)) AS tol FROM w),
        k AS (SELECT 0 AS i, list_transform(range(4), lambda x: lo + (hi - lo) * (x + 0.5) / 4) AS z, false AS done FROM m
          UNION ALL
          SELECT i + 1, nz, list_sum(list_transform(range(1, 5), lambda j: pow(nz[j] - z[j], 2))) <= tol
          FROM (SELECT i, z, (SELECT list(x ORDER BY g) FROM (SELECT g, sum(v * c) / sum(c) AS x FROM (SELECT v, c, len(list_filter(
            [(z[1] + z[2]) / 2, (z[2] + z[3]) / 2, (z[3] + z[4]) / 2], lambda e: v > e)) AS g FROM w) GROUP BY g)) AS nz
            FROM k WHERE i < 300 AND NOT done), m),
        z AS (SELECT z FROM k ORDER BY i DESC LIMIT 1)
        SELECT event_id, CASE WHEN v IS NULL THEN -1 ELSE CAST((v >= (z[1] + z[2]) / 2)::INT + (v >= (z[2] + z[3]) / 2)::INT
          + (v >= (z[3] + z[4]) / 2)::INT AS BIGINT) END AS value FROM a, z""",
    "p13_clipped": f"""WITH a AS (SELECT event_id, ts, nullif(value, 1.0) AS v, CASE WHEN ts >= TIMESTAMP '2024-01-20'
          THEN 'std_test' ELSE 'train' END AS __split__ FROM events),
        m AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.9) AS hi FROM a WHERE __split__ = 'train')
        SELECT event_id, ts, CASE WHEN v IS NOT NULL THEN {r('least(greatest(v, lo), hi)')} END AS value, __split__ FROM a, m""",
    "p14_filtered": f"""SELECT {LKEY_SQL}, l_quantity, l_returnflag AS flag FROM lineitem
        WHERE l_quantity > 30 AND l_linenumber <> 2 AND l_returnflag <> 'N'""",
    "p15_negatives": f"""WITH {INTERACTIONS_SQL} SELECT count(*) + 2 * sum(rating)::BIGINT AS n, 2 * sum(rating)::BIGINT AS n_drawn,
        CAST(0 AS BIGINT) AS drawn_ratings, CAST(0 AS BIGINT) AS wrong_features, CAST(0 AS BIGINT) AS clashes FROM interactions""",
    "p16_k_core_users": f"""WITH {INTERACTIONS_SQL} SELECT * FROM interactions
        QUALIFY count(*) OVER (PARTITION BY user_id) >= 45""",
    "p17_balanced_down": f"""SELECT {LKEY_SQL}, CAST(l_quantity > 40 AS INTEGER) AS y FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_quantity > 40 ORDER BY {draw_sql(LKEY_SQL)}, {LKEY_SQL}) <=
          (SELECT min(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity > 40))""",
    # Slots 0 .. most - 1 of a class take the row whose number the MD5 of (seed, class, slot) names.
    "p20_balanced_up": f"""WITH a AS (SELECT {LKEY_SQL}, CAST(floor(l_quantity / 4) AS INTEGER) AS y FROM lineitem),
        c AS (SELECT y, count(*) AS n, max(count(*)) OVER () AS most FROM a GROUP BY y),
        p AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {LKEY_SQL}) - 1 AS i FROM a),
        s AS (SELECT y, CAST('0x' || substr(md5('42|' || y || '|' || k), 1, 15) AS BIGINT) % n AS i
          FROM (SELECT y, n, unnest(range(0, most)) AS k FROM c WHERE n < most))
        SELECT {LKEY_SQL}, y FROM a WHERE y IN (SELECT y FROM c WHERE n = most)
        UNION ALL SELECT {LKEY_SQL}, p.y FROM s JOIN p ON s.y = p.y AND s.i = p.i""",
    "p23_mixed": """SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_types, true AS labels_ok, true AS low_ok, true AS mean_ok
        FROM events""",
    "p24_copies_without_noise": """WITH a AS (SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN value END AS value
          FROM events), b AS (SELECT event_id, event_type, coalesce(value, 0.0) AS value FROM a)
        SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM b""",
    "p24_copies_with_noise": "SELECT 2 * count(*) AS n, true AS bounded, true AS moved FROM events",
    "p25_null_columns_dropped": """SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS common FROM events""",
    "p26_custom_callable": "SELECT * FROM region WHERE r_regionkey > 1",
}


def k_core_sql(k, rounds):
    steps = [f"""r{i} AS (SELECT * FROM r{i - 1} QUALIFY count(*) OVER (PARTITION BY user_id) >= {k}
      AND count(*) OVER (PARTITION BY item_id) >= {k})""" for i in range(1, rounds + 1)]
    return f"WITH {INTERACTIONS_SQL}, r0 AS (SELECT * FROM interactions), {', '.join(steps)} SELECT * FROM r{rounds}"


SQL["p16_k_core"] = k_core_sql(22, 40)
