"""Model inputs, metrics, the downstream model, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import operators as O
from millrace.plans import inputs as I, metrics as M
from millrace.streaming import panel as L

from .common import LKEY, LKEY_SQL, interactions, r, rounded, scratch, table, with_split


def vocabularies(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id"), "lang", F.sequence(F.lit(0), F.col("n_chars") % 9).alias("seq"),
                                             F.split("source", "").alias("letters"))
    return I.vocabulary_sizes(d, ["doc_id", "lang", "seq", "letters"])


def padded(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.sequence(
        F.lit(1).cast("bigint"), F.col("n_chars") % 9 + 1)).alias("seq"))
    out = I.pad_sequence(d, "seq", 4)
    return out.select("doc_id", F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"), "seq_length")


def clamped(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.nullif("user_id", F.lit(4)) - 5).alias("id"),
                                          F.array(F.col("user_id"), F.lit(-1).cast("bigint"), F.lit(None).cast("bigint")).alias("ids"))
    out = I.clamp_ids(I.clamp_ids(e, "id", 20), "ids", 10)
    return out.select("event_id", "id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def windows(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = I.sliding_windows(e, ["value"], 4, "user_id", ["ts", "event_id"])
    return out.select("event_id", F.array_join(F.transform("window", lambda x: F.format_string("%.2f", x[0])), ",").alias("window"))


def warm_windows(spark, sf):
    """Late events, warmed up with each user's training tail."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    late = e.where("ts >= TIMESTAMP_NTZ '2024-01-25'")
    early = e.where("ts < TIMESTAMP_NTZ '2024-01-25'")
    out = I.sliding_windows(late, ["value"], 3, "user_id", ["ts", "event_id"], prefix_rows=early)
    return out.select("event_id", F.array_join(F.transform("window", lambda x: F.format_string("%.2f", x[0])), ",").alias("window"))


def most_variable(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:4], "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return I.keep_most_variable(l, 2, keep=LKEY)


def adjacency(spark, sf):
    e = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    n = table(spark, sf, "part").select("p_partkey")
    return rounded(I.normalised_adjacency(e, "l_partkey", "l_suppkey", n, "p_partkey"))


def neighbour_features(spark, sf):
    e = table(spark, sf, "lineitem").select(F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey")).alias("l_partkey"), "l_suppkey")
    n = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(I.neighbour_means(e, "l_partkey", "l_suppkey", n, "p_partkey", ["p_size", "p_retailprice"]), 4)


def predictions(spark, sf):
    """Scores with many ties against a flag."""
    return table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                                               F.round(F.col("l_quantity") / 51 * 0.7 + F.col("l_tax") * 3, 2).alias("s"))


PREDICTIONS_SQL = "p AS (SELECT (l_returnflag = 'R')::INT AS y, round(l_quantity / 51 * 0.7 + l_tax * 3, 2) AS s FROM lineitem)"


def binary(spark, sf):
    return rounded(M.binary_metrics(predictions(spark, sf), "y", "s"))


def regression(spark, sf):
    l = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("p"))
    return rounded(M.regression_metrics(l, "l_extendedprice", "p"), 3)


def threshold(spark, sf):
    return rounded(M.best_f1_threshold(predictions(spark, sf), "y", "s"))


def class_weight(spark, sf):
    return rounded(M.positive_weight(predictions(spark, sf), "y"))


def trees(spark, sf):
    """Boosted trees on training rows, scored on later rows."""
    l = with_split(table(spark, sf, "lineitem"), "l_shipdate", "2000-01-01")
    l = l.withColumn("y", (F.col("l_quantity") - F.col("l_tax") * 200 > 20).cast("int"))
    out = M.fit_and_score(l, "y", drop=LKEY, rounds=3, depth=3)
    return out.select("split", (F.col("auc") > 0.8).alias("auc_ok"), (F.col("logloss") < 0.69).alias("logloss_ok"))


def streamed_panel(spark, sf):
    """Three arrivals of events, each merged into the days it touches."""
    e = table(spark, sf, "events")
    folder, target, state = scratch(spark, "events"), scratch(spark, "panel"), scratch(spark, "stream")
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    third = (ends["b"] - ends["a"]) / 3
    cuts = [F.lit(ends["a"] + third).cast("timestamp_ntz"), F.lit(ends["a"] + 2 * third).cast("timestamp_ntz")]
    for part in (F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]):
        e.where(part).write.mode("append").parquet(folder)
        out = L.hourly_stream(L.event_stream(spark, folder, e.schema, "ts"), "user_id", "ts", {"value": ["sum", "max"]}, "n")
        L.write_panel(out, "user_id", target, state, availableNow=True).awaitTermination()
    return rounded(L.read_panel(spark, target), 4)


def streamed_steps(spark, sf):
    """Steps fitted on a table, applied to the same rows as a stream into files."""
    e = table(spark, sf, "events")
    folder, target = scratch(spark, "events"), scratch(spark, "scored")
    e.write.parquet(folder)
    steps = [O.ScaleFeature("value", "minmax").fit(e), O.OneHotEncode("event_type").fit(e),
             O.HashEncode("user_id", 16).fit(e)]
    stream = L.apply_fitted(L.event_stream(spark, folder, e.schema, "ts").drop("ts", "props"), steps)
    query = stream.writeStream.format("parquet").option("path", target) \
        .option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.schema(stream.schema).parquet(target))


QUERIES = {
    "e1_vocabularies": vocabularies, "e2_padded": padded, "e3_clamped": clamped, "e4_windows": windows,
    "e4_warm_windows": warm_windows, "e5_most_variable": most_variable, "e6_adjacency": adjacency,
    "e7_neighbour_features": neighbour_features, "e8_binary_metrics": binary, "e9_regression_metrics": regression,
    "e10_threshold": threshold, "e11_class_weight": class_weight, "e12_trees": trees,
    "st1_streamed_panel": streamed_panel, "st2_streamed_steps": streamed_steps,
}

SQL = {
    "e1_vocabularies": """SELECT 'doc_id' AS "column", max(doc_id) + 1 AS size FROM documents UNION ALL
        SELECT 'lang', count(DISTINCT lang) + 1 FROM documents UNION ALL SELECT 'seq', max(n_chars % 9) + 1 FROM documents UNION ALL
        SELECT 'letters', count(DISTINCT x) + 1 FROM (SELECT unnest(string_split(source, '')) AS x FROM documents)""",
    "e2_padded": """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars % 9 + 1 ELSE 0 END AS k FROM documents),
        b AS (SELECT doc_id, least(k, 4) AS n, list_concat(range(greatest(k - 3, 1), k + 1), [0, 0, 0, 0]) AS x FROM a)
        SELECT doc_id, array_to_string(x[1:4], ',') AS seq, CAST(n AS INTEGER) AS seq_length FROM b""",
    "e3_clamped": """SELECT event_id, CASE WHEN user_id <> 4 AND user_id - 5 BETWEEN 0 AND 19 THEN user_id - 5 ELSE 0 END AS id,
        CASE WHEN user_id < 10 THEN user_id ELSE 0 END || ',0,0' AS ids FROM events""",
    "e4_windows": """WITH w AS (SELECT event_id, list(printf('%.2f', value)) OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x FROM events)
        SELECT event_id, array_to_string(list_concat([x[1] for i in range(4 - len(x))], x), ',') AS "window" FROM w""",
    "e4_warm_windows": """WITH w AS (SELECT event_id, ts, list(printf('%.2f', value)) OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM events)
        SELECT event_id, array_to_string(list_concat([x[1] for i in range(3 - len(x))], x), ',') AS "window" FROM w
        WHERE ts >= TIMESTAMP '2024-01-25'""",
    "e5_most_variable": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag FROM lineitem",
    "e6_adjacency": f"""WITH d AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
        e AS (SELECT a AS src, b AS dst FROM d UNION SELECT b, a FROM d),
        f AS (SELECT * FROM e UNION ALL SELECT p_partkey, p_partkey FROM part),
        g AS (SELECT src AS n, count(*) AS k FROM f GROUP BY 1)
        SELECT src, dst, {r('sum(1 / sqrt(x.k * y.k))')} AS weight FROM f JOIN g x ON src = x.n JOIN g y ON dst = y.n GROUP BY 1, 2""",
    "e7_neighbour_features": f"""WITH d AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey % 4 <> 0),
        e AS (SELECT a AS src, b AS dst FROM d UNION SELECT b, a FROM d),
        m AS (SELECT src, avg(p_size) AS s, avg(p_retailprice) AS p FROM e JOIN part ON dst = p_partkey GROUP BY 1)
        SELECT p_partkey, {r('coalesce(s, 0.0)', 4)} AS p_size_neighbours, {r('coalesce(p, 0.0)', 4)} AS p_retailprice_neighbours
        FROM part LEFT JOIN m ON p_partkey = src""",
    "e8_binary_metrics": f"""WITH {PREDICTIONS_SQL}, k AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2
          AS rk FROM p), q AS (SELECT *, least(greatest(s, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS c,
          (s >= 0.5)::INT AS h FROM k)
        SELECT {r('(sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))')} AS auc,
          {r('avg(-(y * ln(c) + (1 - y) * ln(1 - c)))')} AS logloss, {r('avg((h = y)::INT)')} AS accuracy,
          {r('2 * sum(h * y) / (sum(h) + sum(y))')} AS f1 FROM q""",
    "e9_regression_metrics": f"""WITH a AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)
        SELECT {r('avg((y - p) ** 2)', 3)} AS mse, {r('sqrt(avg((y - p) ** 2))', 3)} AS rmse, {r('avg(abs(y - p))', 3)} AS mae,
          {r('1 - avg((y - p) ** 2) / var_pop(y)', 3)} AS r2 FROM a""",
    "e10_threshold": f"""WITH {PREDICTIONS_SQL}, g AS (SELECT s, sum(y) AS p, count(*) AS c FROM p GROUP BY 1),
        u AS (SELECT s, sum(p) OVER w AS up, sum(c) OVER w AS uc, sum(p) OVER () AS tp FROM g WINDOW w AS (ORDER BY s DESC)),
        f AS (SELECT s, 2 * up / (uc + tp) AS f1 FROM u)
        SELECT {r('s')} AS threshold, {r('f1')} AS f1 FROM f ORDER BY f.f1 DESC, s LIMIT 1""",
    "e11_class_weight": f"WITH {PREDICTIONS_SQL} SELECT {r('least(count(*) FILTER (y = 0) / count(*) FILTER (y = 1), 100)')} AS pos_weight FROM p",
    "e12_trees": "SELECT 'std_test' AS split, true AS auc_ok, true AS logloss_ok",
    "st1_streamed_panel": f"""SELECT user_id, date_trunc('hour', ts) AS _hour_ts, {r('sum(value)', 4)} AS value_sum,
        {r('max(value)', 4)} AS value_max, count(*) AS n, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS _hour_idx
        FROM events GROUP BY 1, 2""",
    "st2_streamed_steps": f"""WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
        SELECT event_id, user_id, {r('(value - lo) / (hi - lo)')} AS value, {', '.join(f"(event_type = '{t}')::INT AS event_type_{t}"
        for t in ('click', 'error', 'purchase', 'signup', 'view'))},
        CAST(CAST('0x' || md5(CAST(user_id AS VARCHAR))[1:16] AS UBIGINT) % 16 AS INTEGER) AS h_user_id FROM events, m""",
}
