"""Row, group, calendar, ordered, sequence, selection, text and graph features."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from millrace import operators as O
from millrace.functions.grouped import apply_groups, map_with_facts

from .common import (INTERACTION_KEY, INTERACTION_KEY_SQL, INTERACTIONS_SQL, LKEY, LKEY_SQL, interactions, r,
                     rounded, table, with_split)


def row_feature(method, cols=("a", "b", "c"), **kw):
    def run(spark, sf):
        l = table(spark, sf, "lineitem").select(
            *LKEY[:4], F.nullif("l_quantity", F.lit(1.0)).alias("a"), (F.col("l_discount") * 100).alias("b"),
            F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("c"))
        return rounded(O.CreateFeature(list(cols), "out", method, kw).transform(l), 5)
    return run


def joined_text(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("st"), "o_custkey")
    o = O.CreateFeature(["st", "o_custkey"], "both", "concat", {"sep": "-"}).transform(o)
    return O.CreateFeature("st", "copy", "identity").transform(o)


def frame_callable(spark, sf):
    def share(df, cols, scale=1):
        return F.col(cols[0]) / F.col(cols[1]) * scale
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return rounded(O.CreateFeature(["p_retailprice", "p_size"], "unit", share, {"scale": 2}).transform(p))


def row_callable(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    p = O.CreateFeature(["p_size"], "half", lambda x: x / 2).transform(p)
    return rounded(O.CreateFeature(["p_retailprice", "p_size"], "unit",
                                   lambda row: row["p_retailprice"] - row["p_size"]).transform(p))


CENTRED = "c_custkey bigint, c_nationkey int, c_acctbal double, gap double"


def per_group_pandas(spark, sf):
    """A pandas callable that sees its group's mean, for groups of any size."""
    def centred(pdf):
        return pdf.assign(gap=pdf["c_acctbal"] - pdf["mean"]).drop(columns="mean")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(map_with_facts(c, ["c_nationkey"], {"mean": F.avg("c_acctbal")}, centred, CENTRED))


STEPPED = "o_custkey bigint, o_orderkey bigint, balance double, streak int, orders int"


def whole_group_pandas(spark, sf):
    """A callable over each customer's whole ordered history: a balance that never falls below 0, and the orders since."""
    def replay(batches):
        held, balance, streak = [], 0.0, 0
        for batch in batches:
            rows = []
            for amount in batch["amount"]:
                balance = max(0.0, balance + amount)
                streak = streak + 1 if balance else 0
                rows.append((balance, streak))
            held.append(batch[["o_custkey", "o_orderkey"]].assign(
                balance=[b for b, _ in rows], streak=[s for _, s in rows]))
        orders = sum(map(len, held))
        for part in held:
            yield part.assign(orders=orders)
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(
        F.col("o_orderstatus") == "F", -F.floor("o_totalprice")).otherwise(F.floor("o_totalprice")).cast("double").alias("amount"))
    return apply_groups(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], replay, STEPPED)


def custom_callable(spark, sf):
    """A frame callable: the same as plain columns."""
    def centred(df):
        return df.withColumn("gap", F.col("c_acctbal") - F.avg("c_acctbal").over(Window.partitionBy("c_nationkey")))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rounded(O.CustomFE(centred).transform(c))


def vector_callable(spark, sf):
    """A callable on pandas columns."""
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    p = O.CreateFeature(["p_size"], "half", lambda x: x / 2, vectorized=True).transform(p)
    return rounded(O.CreateFeature(["p_retailprice", "p_size"], "unit", lambda a, b: a - b, vectorized=True).transform(p))


def polynomial(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:4], F.nullif("l_quantity", F.lit(1.0)).alias("q"), "l_discount", "l_tax")
    return rounded(O.CreatePolynomialFeature(["q", "l_discount", "l_tax"], 3).transform(l))


def polynomial_interactions(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:4], "l_quantity", "l_discount", "l_tax")
    return rounded(O.CreatePolynomialFeature(["l_quantity", "l_discount", "l_tax"], 3, True).transform(l))


def crossed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("st"), "o_orderpriority")
    return O.CrossFeature(["st", "o_orderpriority"], separator="|").transform(o)


def group_statistics(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(5)).alias("cust"), "o_orderstatus",
                                          F.nullif("o_totalprice", F.col("o_totalprice") * 0).alias("price"))
    return rounded(O.AggregateGroupFeature(["cust", "o_orderstatus"], ["price"]).transform(o), 4)


def group_median(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return rounded(O.AggregateGroupFeature("event_type", ["value"], ["median", "min", "nunique"]).transform(e), 4)


def calendar(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("ts")).alias("t"))
    features = ["year", "month", "day", "dayofweek", "quarter", "is_weekend", "dayofyear", "hour", "days_since_epoch"]
    return O.ExtractDateTimeFeature("t", features).transform(e)


def calendar_from_seconds(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return O.ExtractDateTimeFeature("s", ["hour_of_day", "day_of_week", "day"], drop_original=True).transform(e)


def lags(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value", F.nullif("user_id", F.lit(3)).alias("user_id"))
    return O.CreateLagFeature("value", [1, 3], ["user_id"], "ts", ["event_id"]).transform(e)


def lags_ungrouped(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    return O.CreateLagFeature("value", [2], time_col="ts", tie_cols=["event_id"]).transform(e)


def rolling(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return rounded(O.CreateRollingFeature("value", [3, 10], ["mean", "std", "min", "max", "sum", "median"], ["user_id"],
                                          "ts", ["event_id"]).transform(e), 4)


def history(spark, sf):
    i = interactions(spark, sf).select("user_id", "item_id", "timestamp", *[c for c in INTERACTION_KEY if c != "item_id"])
    out = O.CreateSequence(max_len=5, tie_cols=INTERACTION_KEY).transform(i)
    return out.withColumn("item_id_seq", F.array_join(out.item_id_seq.cast("array<string>"), ","))


def history_with_split(spark, sf):
    i = interactions(spark, sf).select("user_id", "item_id", "timestamp", *[c for c in INTERACTION_KEY if c != "item_id"])
    i = with_split(i, "timestamp", "2000-06-01")
    # A few held-out rows inside the training period, to see that they leave no trace.
    i = i.withColumn("__split__", F.when(F.col("l_orderkey") % 10 == 0, "std_test").otherwise(F.col("__split__")))
    out = O.CreateSequence(max_len=4, tie_cols=INTERACTION_KEY).transform(i)
    return out.withColumn("item_id_seq", F.array_join(out.item_id_seq.cast("array<string>"), ","))


def truncated(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", F.split("source", "").alias("a"), F.split("source", "").alias("b"))
    out = O.TruncateSequence("b", 3, "first").transform(O.TruncateSequence("a", 3).transform(c))
    return out.select("doc_id", F.array_join("a", "").alias("a"), F.array_join("b", "").alias("b"))


def low_variance_dropped(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount", "l_quantity", "l_returnflag",
                                            F.lit(3).alias("fixed"))
    return O.SelectFeature(threshold=0.0007, exclude_cols=["l_orderkey"]).transform(l)


def univariate(score):
    def run(spark, sf):
        l = table(spark, sf, "lineitem")
        y = (F.col("l_quantity") > 30).cast("int") if score != "f_regression" else F.col("l_discount") * 10 + F.col("l_linenumber")
        l = l.select(y.alias("y"), F.nullif("l_quantity", F.lit(1.0)).alias("q"), "l_extendedprice", "l_discount", "l_tax",
                     "l_linenumber")
        step = O.SelectFeature("y", "univariate", k=2, score_func=score).fit(l)
        return rounded(spark.createDataFrame([(n, float(v), n in step.keep) for n, v in step.scores.items()],
                                             "feature string, score double, kept boolean"), 3)
    return run


def best_two(score):
    """The table with the two columns of highest score."""
    def run(spark, sf):
        l = table(spark, sf, "lineitem")
        y = (F.col("l_quantity") > 30).cast("int") if score != "f_regression" else F.col("l_discount") * 10 + F.col("l_linenumber")
        l = l.select(y.alias("y"), F.nullif("l_quantity", F.lit(1.0)).alias("q"), "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
        return rounded(O.SelectFeature("y", "univariate", k=2, score_func=score).transform(l), 4)
    return run


def chosen_by_model(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_quantity") > 30).cast("int").alias("y"), "l_quantity", "l_tax",
                                            "l_discount", "l_linenumber")
    return O.SelectFeature("y", "model", k=1, estimator="forest").transform(l)


def eliminated(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_quantity") * 3 - F.col("l_tax") * 50).alias("y"), "l_quantity", "l_tax",
                                            "l_discount", "l_linenumber")
    return rounded(O.SelectFeature("y", "rfe", n_features_to_select=2, estimator="linear").transform(l), 3)


def components(method, **kw):
    def run(spark, sf):
        l = table(spark, sf, "lineitem").select(*LKEY[:4], "l_quantity", (F.col("l_discount") * 100).alias("d"),
                                                (F.col("l_tax") * 100).alias("t"), F.col("l_returnflag").alias("y"))
        return rounded(O.ReduceDimension(["l_quantity", "d", "t"], method, 2, **kw).transform(l), 3)
    return run


def kernel_linear(spark, sf):
    """With the linear kernel and landmarks that span the columns: the principal components, up to their signs."""
    out = components("kernel_pca", kernel="linear", landmarks=64)(spark, sf)
    return out.withColumns({n: F.abs(n) for n in ("kernel_pca_0", "kernel_pca_1")})


def two_classes(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:4], "l_quantity", (F.col("l_discount") * 100).alias("d"),
                                            (F.col("l_tax") * 100).alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(O.ReduceDimension(["l_quantity", "d", "t"], "lda", 2, target_col="y").transform(l), 3)


WIDTH = 64


def pca_variances(spark, sf):
    """All components of the embeddings: uncorrelated, and their variances add up to those of the columns."""
    e = table(spark, sf, "embeddings")
    wide = e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(WIDTH)])
    out = O.ReduceDimension([f"x{i}" for i in range(WIDTH)], "pca", WIDTH).transform(wide)
    total = sum([F.var_samp(f"pca_{i}") for i in range(WIDTH)], F.lit(0.0))
    return rounded(out.agg(total.alias("total"), F.abs(F.corr("pca_0", "pca_1")).alias("corr"),
                           (F.var_samp("pca_0") >= F.var_samp(f"pca_{WIDTH - 1}")).alias("ordered")), 5)


def term_counts(method, ngrams=(1, 1)):
    def run(spark, sf):
        d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 0, F.col("text")).alias("text"))
        out = O.ExtractTextFeature("text", method, max_features=12, ngram_range=ngrams).transform(d).drop("text")
        names = [n for n in out.columns if n != "doc_id"]
        long = out.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n.split("_", 2)[2]).alias("term"), F.col(f"`{n}`")
                          .cast("double").alias("value")) for n in names])).alias("c")).select("doc_id", "c.*")
        return rounded(long, 5)
    return run


def token_vectors(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = O.ExtractTextEmbedding("text", dim=8).transform(d).drop("text")
    return rounded(out, 5)


def edge_degrees(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:2], F.col("l_partkey").alias("src"), F.nullif("l_suppkey", F.lit(4)).alias("dst"))
    return O.ExtractGraphFeature(features=["degree"]).transform(l)


def edge_degrees_directed(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:2], F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return O.ExtractGraphFeature(features=["degree"], directed=True).transform(l)


def ranks(spark, sf):
    from millrace.operators.graph import pagerank, simple_edges
    l = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_suppkey") + 1_000_000).alias("l_suppkey"))
    out = pagerank(simple_edges(l, "l_partkey", "l_suppkey", directed=True), directed=True, rounds=3)
    return rounded(out.withColumn("pagerank", F.col("pagerank") * 1e4), 6)


def ranks_converged(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:2], F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"))
    return O.ExtractGraphFeature(features=["pagerank"]).transform(l)


QUERIES = {
    **{f"f1_row_{m}": row_feature(m) for m in ("mean", "sum", "std", "min", "max", "median", "product")},
    "f1_row_diff": row_feature("diff"), "f1_row_ratio": row_feature("ratio"),
    "f1_row_inc_ratio": row_feature("inc_ratio", offset=2), "f1_row_text": joined_text,
    "f2_frame_callable": frame_callable, "f2_row_callable": row_callable, "ud2_vector_callable": vector_callable, "ud3_per_group_pandas": per_group_pandas, "ud3_whole_group_pandas": whole_group_pandas,
    "f3_polynomial": polynomial, "f3_polynomial_interactions": polynomial_interactions, "f4_crossed": crossed,
    "f5_group_statistics": group_statistics, "f5_group_median": group_median, "f6_calendar": calendar,
    "f6_calendar_from_seconds": calendar_from_seconds, "f7_lags": lags, "f7_lags_ungrouped": lags_ungrouped,
    "f8_rolling": rolling, "f9_history": history, "f9_history_with_split": history_with_split,
    "f10_truncated": truncated, "f11_low_variance_dropped": low_variance_dropped,
    "f12_anova": univariate("f_classif"), "f12_regression": univariate("f_regression"), "f12_chi2": univariate("chi2"),
    "f12_anova_applied": best_two("f_classif"), "f12_regression_applied": best_two("f_regression"), "f12_chi2_applied": best_two("chi2"),
    "f13_chosen_by_model": chosen_by_model, "f14_eliminated": eliminated,
    "f15_principal": components("pca"), "f15_singular": components("svd"), "f15_principal_variances": pca_variances,
    "f16_discriminant": components("lda", target_col="y"), "f17_kernel": components("kernel_pca", landmarks=64),
    "f16_discriminant_two_classes": two_classes, "f17_kernel_linear": kernel_linear,
    "f18_term_counts": term_counts("bow"), "f18_tfidf": term_counts("tfidf"),
    "f18_bigram_counts": term_counts("bow", (1, 2)), "f19_token_vectors": token_vectors,
    "f20_degrees": edge_degrees, "f20_degrees_directed": edge_degrees_directed, "f21_ranks": ranks,
    "f21_ranks_converged": ranks_converged, "f22_custom_callable": custom_callable,
}

_ROW = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_quantity, 1.0) AS a, l_discount * 100 AS b,
  CASE WHEN l_linenumber <> 2 THEN l_tax END AS c FROM lineitem), v AS (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL) AS xs
  FROM t)"""


def row_sql(expr):
    return f"""{_ROW} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('a', 5)} AS a, {r('b', 5)} AS b,
      {r('c', 5)} AS c, {r(expr, 5)} AS out FROM v"""


def words_sql(max_n):
    big = """ UNION ALL SELECT doc_id, toks[i] || ' ' || toks[i + 1] AS term FROM toks, range(1, len(toks)) g(i)""" \
        if max_n == 2 else ""
    return f"""d AS (SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN lower(text) ELSE '' END AS t FROM documents),
      toks AS (SELECT doc_id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks FROM d),
      w AS (SELECT doc_id, unnest(toks) AS term FROM toks{big}),
      top AS (SELECT term FROM w GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 12),
      n AS (SELECT doc_id, term, count(*) AS k FROM w JOIN top USING (term) GROUP BY 1, 2)"""


def counts_sql(max_n):
    return f"""WITH {words_sql(max_n)} SELECT d.doc_id, top.term, CAST(coalesce(k, 0) AS DOUBLE) AS value
      FROM d CROSS JOIN top LEFT JOIN n ON n.doc_id = d.doc_id AND n.term = top.term"""


def poly_sql(cols, names, interactions_only):
    from itertools import combinations, combinations_with_replacement
    make = combinations if interactions_only else combinations_with_replacement
    out = []
    for deg in (2, 3):
        for p in make(range(3), deg):
            label = "_".join(names[i] if p.count(i) == 1 else f"{names[i]}p{p.count(i)}" for i in sorted(set(p)))
            out.append(f"{r(' * '.join(cols[i] for i in p))} AS poly_{label}")
    return ", ".join(out)


def ranks_sql(rounds):
    steps = ["r0 AS (SELECT node, links, 1.0 / cnt AS p FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS (SELECT n.node, n.links, 0.15 / cnt + 0.85 * (SELECT coalesce(sum(p), 0) FROM r{i - 1}
          WHERE links IS NULL) / cnt + 0.85 * coalesce(f, 0) AS p FROM n LEFT JOIN (SELECT b AS node, sum(p / links) AS f
          FROM e JOIN r{i - 1} ON a = node GROUP BY 1) x ON n.node = x.node)""")
    return f"""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem),
      nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e),
      n AS (SELECT node, links, count(*) OVER () AS cnt FROM nodes LEFT JOIN (SELECT a, count(*) AS links FROM e GROUP BY 1)
        ON a = node), {', '.join(steps)} SELECT node, {r('p * 1e4', 6)} AS pagerank FROM r{rounds}"""


_SEQ = "CAST(item_id AS VARCHAR)"
_ORDER = f"timestamp, {INTERACTION_KEY_SQL}"

SQL = {
    "f1_row_mean": row_sql("list_sum(xs) / nullif(len(xs), 0)"), "f1_row_sum": row_sql("coalesce(list_sum(xs), 0.0)"),
    "f1_row_std": row_sql("CASE WHEN len(xs) > 1 THEN list_aggregate(xs, 'stddev_samp') END"),
    "f1_row_min": row_sql("list_min(xs)"), "f1_row_max": row_sql("list_max(xs)"),
    "f1_row_median": row_sql("list_aggregate(xs, 'median')"),
    "f1_row_product": row_sql("coalesce(a, 1.0) * b * coalesce(c, 1.0)"), "f1_row_diff": row_sql("a - b"),
    "f1_row_ratio": row_sql("a / nullif(b, 0.0)"), "f1_row_inc_ratio": row_sql("a / (2 + b)"),
    "f1_row_text": """SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st, o_custkey, coalesce(nullif(o_orderstatus, 'F'), 'nan')
        || '-' || o_custkey AS both, nullif(o_orderstatus, 'F') AS copy FROM orders""",
    "f2_frame_callable": f"SELECT p_partkey, {r('p_retailprice')} AS p_retailprice, p_size, {r('p_retailprice / p_size * 2')} AS unit FROM part",
    "f2_row_callable": f"""SELECT p_partkey, {r('p_retailprice')} AS p_retailprice, p_size, {r('p_size / 2')} AS half,
        {r('p_retailprice - p_size')} AS unit FROM part""",
    # A balance floored at 0 is the running sum less its smallest value so far, or 0.
    "ud3_whole_group_pandas": """WITH a AS (SELECT *, sum(CASE WHEN o_orderstatus = 'F' THEN -floor(o_totalprice) ELSE floor(o_totalprice) END)
          OVER w AS s, row_number() OVER w AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
        b AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY o_custkey ORDER BY i)) AS bal FROM a),
        c AS (SELECT *, max(CASE WHEN bal = 0 THEN i ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY i) AS z FROM b)
        SELECT o_custkey, o_orderkey, CAST(bal AS DOUBLE) AS balance, CAST(i - z AS INTEGER) AS streak,
          CAST(count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS orders FROM c""",
    "ud3_per_group_pandas": f"""SELECT c_custkey, c_nationkey, {r('c_acctbal')} AS c_acctbal,
        {r('c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey)')} AS gap FROM customer""",
    "f3_polynomial": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('nullif(l_quantity, 1.0)')} AS q,
        {r('l_discount')} AS l_discount, {r('l_tax')} AS l_tax, {poly_sql(["coalesce(nullif(l_quantity, 1.0), 0.0)", 'l_discount', 'l_tax'],
        ['q', 'l_discount', 'l_tax'], False)} FROM lineitem""",
    "f3_polynomial_interactions": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('l_quantity')} AS l_quantity,
        {r('l_discount')} AS l_discount, {r('l_tax')} AS l_tax, {poly_sql(['l_quantity', 'l_discount', 'l_tax'],
        ['l_quantity', 'l_discount', 'l_tax'], True)} FROM lineitem""",
    "f4_crossed": """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS st, o_orderpriority,
        coalesce(nullif(o_orderstatus, 'P'), '') || '|' || o_orderpriority AS "st|o_orderpriority" FROM orders""",
    "f5_group_statistics": f"""WITH a AS (SELECT o_orderkey, nullif(o_custkey, 5) AS cust, o_orderstatus, o_totalprice AS price
          FROM orders) SELECT o_orderkey, cust, o_orderstatus, {r('price', 4)} AS price,
        CASE WHEN cust IS NOT NULL THEN {r('avg(price) OVER w', 4)} END AS price_mean,
        CASE WHEN cust IS NOT NULL THEN {r('sum(price) OVER w', 4)} END AS price_sum,
        CASE WHEN cust IS NOT NULL THEN count(price) OVER w END AS price_count,
        CASE WHEN cust IS NOT NULL THEN {r('stddev_samp(price) OVER w', 4)} END AS price_std
        FROM a WINDOW w AS (PARTITION BY cust, o_orderstatus)""",
    "f5_group_median": f"""SELECT event_id, event_type, {r('value', 4)} AS value, m AS value_median, n AS value_min, u AS value_nunique
        FROM events JOIN (SELECT event_type, {r('median(value)', 4)} AS m, {r('min(value)', 4)} AS n,
          count(DISTINCT value) AS u FROM events GROUP BY 1) USING (event_type)""",
    "f6_calendar": """WITH a AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN ts END AS t FROM events)
        SELECT event_id, t, CAST(year(t) AS INTEGER) AS t_year, CAST(month(t) AS INTEGER) AS t_month,
          CAST(day(t) AS INTEGER) AS t_day, CAST(isodow(t) - 1 AS INTEGER) AS t_dayofweek,
          CAST(quarter(t) AS INTEGER) AS t_quarter, CAST(coalesce(isodow(t) >= 6, false) AS INTEGER) AS t_is_weekend,
          CAST(dayofyear(t) AS INTEGER) AS t_dayofyear, CAST(hour(t) AS INTEGER) AS t_hour,
          CAST(date_diff('day', DATE '1970-01-01', CAST(t AS DATE)) AS INTEGER) AS t_days_since_epoch FROM a""",
    "f6_calendar_from_seconds": """SELECT event_id, CAST(hour(ts) AS INTEGER) AS s_hour_of_day,
        CAST(isodow(ts) - 1 AS INTEGER) AS s_day_of_week, CAST(day(ts) AS INTEGER) AS s_day FROM events""",
    "f7_lags": """WITH a AS (SELECT event_id, ts, value, nullif(user_id, 3) AS user_id FROM events)
        SELECT *, CASE WHEN user_id IS NOT NULL THEN lag(value, 1) OVER w END AS value_lag_1,
          CASE WHEN user_id IS NOT NULL THEN lag(value, 3) OVER w END AS value_lag_3
        FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "f7_lags_ungrouped": "SELECT event_id, ts, value, lag(value, 2) OVER (ORDER BY ts, event_id) AS value_lag_2 FROM events",
    "f8_rolling": "WITH a AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM events) SELECT event_id, ts, user_id, "
        + r("v", 4) + " AS value, " + ", ".join(
            f"{r(f'{fn}(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)', 4)} AS value_roll_{a}_{n}"
            for n in (3, 10) for a, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"),
                                           ("sum", "sum"), ("median", "median"))) + " FROM a",
    "f9_history": f"""WITH {INTERACTIONS_SQL} SELECT user_id, item_id, timestamp, l_orderkey, l_linenumber, l_suppkey, l_extendedprice,
        coalesce(array_to_string(list({_SEQ}) OVER (PARTITION BY user_id ORDER BY {_ORDER} ROWS BETWEEN 5 PRECEDING
          AND 1 PRECEDING), ','), '') AS item_id_seq FROM interactions""",
    "f9_history_with_split": f"""WITH {INTERACTIONS_SQL}, a AS (SELECT *, CASE WHEN l_orderkey % 10 = 0 OR timestamp >=
          TIMESTAMP '2000-06-01' THEN 'std_test' ELSE 'train' END AS __split__ FROM interactions),
        b AS (SELECT *, list({_SEQ}) FILTER (__split__ = 'train') OVER (PARTITION BY user_id
          ORDER BY timestamp, (__split__ = 'std_test')::INT, {INTERACTION_KEY_SQL}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM a)
        SELECT user_id, item_id, timestamp, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, __split__,
          coalesce(array_to_string(h[greatest(len(h) - 3, 1):], ','), '') AS item_id_seq FROM b""",
    "f10_truncated": "SELECT doc_id, right(source, 3) AS a, left(source, 3) AS b FROM documents",
    "f11_low_variance_dropped": """SELECT l_orderkey, l_linenumber, l_discount, l_quantity, l_returnflag FROM lineitem""",
    "f12_anova": f"""WITH a AS (SELECT (l_quantity > 30)::INT AS y, coalesce(nullif(l_quantity, 1.0), 0.0) AS q, l_extendedprice,
          l_discount, l_tax, l_linenumber FROM lineitem),
        u AS (UNPIVOT (SELECT y, q, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM a)
          ON q, l_extendedprice, l_discount, l_tax, l_linenumber INTO NAME feature VALUE x),
        g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM u GROUP BY 1, 2),
        t AS (SELECT feature, sum(n) AS n, sum(n * m) / sum(n) AS m FROM g GROUP BY 1),
        s AS (SELECT g.feature, sum(g.n * (g.m - t.m) ** 2) / (sum(g.n * g.v) / (max(t.n) - 2)) AS score
          FROM g JOIN t USING (feature) GROUP BY 1)
        SELECT feature, {r('score', 3)} AS score, rank() OVER (ORDER BY score DESC) <= 2 AS kept FROM s""",
    "f12_regression": f"""WITH a AS (SELECT l_discount * 10 + l_linenumber AS y, coalesce(nullif(l_quantity, 1.0), 0.0) AS q, l_extendedprice,
          l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem),
        u AS (UNPIVOT a ON q, l_extendedprice, l_discount, l_tax, l_linenumber INTO NAME feature VALUE x),
        s AS (SELECT feature, corr(x, y) ** 2 / (1 - corr(x, y) ** 2) * (count(*) - 2) AS score FROM u GROUP BY 1)
        SELECT feature, {r('score', 3)} AS score, rank() OVER (ORDER BY score DESC) <= 2 AS kept FROM s""",
    "f12_chi2": f"""WITH a AS (SELECT (l_quantity > 30)::INT AS y, coalesce(nullif(l_quantity, 1.0), 0.0) AS q, l_extendedprice,
          l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem),
        u AS (UNPIVOT a ON q, l_extendedprice, l_discount, l_tax, l_linenumber INTO NAME feature VALUE x),
        g AS (SELECT feature, y, count(*) AS n, sum(greatest(x, 0.0)) AS o FROM u GROUP BY 1, 2),
        t AS (SELECT feature, sum(n) AS n, sum(o) AS o FROM g GROUP BY 1),
        s AS (SELECT feature, sum((g.o - g.n / t.n * t.o) ** 2 / (g.n / t.n * t.o)) AS score FROM g JOIN t USING (feature)
          GROUP BY 1)
        SELECT feature, {r('score', 3)} AS score, rank() OVER (ORDER BY score DESC) <= 2 AS kept FROM s""",
    "f12_anova_applied": "SELECT (l_quantity > 30)::INT AS y, nullif(l_quantity, 1.0) AS q, l_tax FROM lineitem",
    "f12_regression_applied": f"SELECT {r('l_discount * 10 + l_linenumber', 4)} AS y, l_discount, l_linenumber FROM lineitem",
    "f12_chi2_applied": f"SELECT (l_quantity > 30)::INT AS y, nullif(l_quantity, 1.0) AS q, {r('l_extendedprice', 4)} AS l_extendedprice FROM lineitem",
    "f13_chosen_by_model": "SELECT (l_quantity > 30)::INT AS y, l_quantity FROM lineitem",
    "f14_eliminated": f"""SELECT {r('l_quantity * 3 - l_tax * 50', 3)} AS y, {r('l_quantity', 3)} AS l_quantity,
        {r('l_tax', 3)} AS l_tax FROM lineitem""",
    "f15_principal_variances": "SELECT " + r(" + ".join(f"var_samp(CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(WIDTH)), 5)
        + " AS total, 0.0::DOUBLE AS corr, true AS ordered FROM embeddings",
    "f18_term_counts": counts_sql(1), "f18_bigram_counts": counts_sql(2),
    "f18_tfidf": f"""WITH {words_sql(1)}, f AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf
          FROM n GROUP BY 1), m AS (SELECT doc_id, term, k * idf AS x FROM n JOIN f USING (term)),
        z AS (SELECT doc_id, sqrt(sum(x * x)) AS z FROM m GROUP BY 1)
        SELECT d.doc_id, top.term, {r('coalesce(x / z, 0.0)', 5)} AS value FROM d CROSS JOIN top
        LEFT JOIN m ON m.doc_id = d.doc_id AND m.term = top.term LEFT JOIN z ON z.doc_id = d.doc_id""",
    "f19_token_vectors": f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s\\p{{Z}}\\x1c-\\x1f\\x85]+')) AS t
          FROM documents), b AS (SELECT doc_id, CAST('0x' || md5(t)[1:16] AS UBIGINT) % 8 AS b FROM w),
        c AS (SELECT doc_id, {', '.join(f'count(*) FILTER (b = {i}) AS c{i}' for i in range(8))} FROM b GROUP BY 1),
        z AS (SELECT *, sqrt({' + '.join(f'c{i} * c{i}' for i in range(8))}) AS z FROM c)
        SELECT doc_id, {', '.join(f"{r(f'coalesce(c{i} / z, 0.0)', 5)} AS text_emb_{i}" for i in range(8))}
        FROM documents LEFT JOIN z USING (doc_id)""",
    "f20_degrees": """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey AS src, nullif(l_suppkey, 4) AS dst FROM lineitem),
        e AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM a WHERE dst IS NOT NULL),
        g AS (SELECT n, count(*) AS k FROM (SELECT x AS n FROM e UNION ALL SELECT y FROM e) GROUP BY 1)
        SELECT a.*, coalesce(s.k, 0) AS graph_src_degree, coalesce(d.k, 0) AS graph_dst_degree
        FROM a LEFT JOIN g s ON src = s.n LEFT JOIN g d ON dst = d.n""",
    "f20_degrees_directed": """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey AS src, l_suppkey AS dst FROM lineitem),
        e AS (SELECT DISTINCT src AS x, dst AS y FROM a),
        g AS (SELECT n, count(*) AS k FROM (SELECT x AS n FROM e UNION ALL SELECT y FROM e) GROUP BY 1)
        SELECT a.*, coalesce(s.k, 0) AS graph_src_degree, coalesce(d.k, 0) AS graph_dst_degree
        FROM a LEFT JOIN g s ON src = s.n LEFT JOIN g d ON dst = d.n""",
    "f21_ranks": ranks_sql(3),
}
SQL["f22_custom_callable"] = SQL["ud3_per_group_pandas"]
SQL["ud2_vector_callable"] = SQL["f2_row_callable"]


def projection_sql(prefix, centred, shown="{}"):
    """First two principal (or singular) directions of three columns by power iteration and deflation."""
    mean = "avg" if centred else "0.0 * avg"
    pairs = [("q", "q"), ("q", "d"), ("q", "t"), ("d", "d"), ("d", "t"), ("t", "t")]

    def step(name, source):
        return f"""{name} AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 0.5::DOUBLE AS b, 0.25::DOUBLE AS c UNION ALL
          SELECT i + 1, x / n, y / n, z / n FROM (SELECT i, qq * a + qd * b + qt * c AS x, qd * a + dd * b + dt * c AS y,
            qt * a + dt * b + tt * c AS z, sqrt(x * x + y * y + z * z) AS n FROM {name}, {source} WHERE i < 400)),
        {name}v AS (SELECT a * s AS a, b * s AS b, c * s AS c FROM (SELECT *, CASE WHEN abs(a) >= greatest(abs(b), abs(c))
          THEN sign(a) WHEN abs(b) >= abs(c) THEN sign(b) ELSE sign(c) END AS s FROM {name} WHERE i = 400))"""
    letters = {"q": "a", "d": "b", "t": "c"}
    return f"""WITH RECURSIVE d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_discount * 100 AS d,
        l_tax * 100 AS t, l_returnflag AS y FROM lineitem),
      m AS (SELECT {', '.join(f'{mean}({c}) AS m{c}' for c in 'qdt')} FROM d),
      g AS (SELECT {', '.join(f'sum(({x} - m{x}) * ({y} - m{y})) AS {x}{y}' for x, y in pairs)} FROM d, m),
      {step('p', 'g')},
      e AS (SELECT a * (qq * a + qd * b + qt * c) + b * (qd * a + dd * b + dt * c) + c * (qt * a + dt * b + tt * c) AS e FROM pv, g),
      h AS (SELECT {', '.join(f'{x}{y} - e * {letters[x]} * {letters[y]} AS {x}{y}' for x, y in pairs)} FROM g, e, pv),
      {step('s', 'h')}
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('q', 3)} AS l_quantity, {r('d', 3)} AS d, {r('t', 3)} AS t, y,
        {shown.format(r('(q - mq) * pv.a + (d - md) * pv.b + (t - mt) * pv.c', 3))} AS {prefix}_0,
        {shown.format(r('(q - mq) * sv.a + (d - md) * sv.b + (t - mt) * sv.c', 3))} AS {prefix}_1 FROM d, m, pv, sv"""


SQL["f15_principal"] = projection_sql("pca", True)
SQL["f15_singular"] = projection_sql("svd", False)
SQL["f17_kernel_linear"] = projection_sql("kernel_pca", True, "abs({})")
# Two classes in closed form: the inverse of the pooled covariance times the difference of means, at unit within-class spread.
SQL["f16_discriminant_two_classes"] = f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q,
    l_discount * 100 AS d, l_tax * 100 AS t, (l_returnflag = 'R')::INT AS y FROM lineitem),
  c AS (SELECT y, avg(q) AS q, avg(d) AS d, avg(t) AS t FROM x GROUP BY y),
  o AS (SELECT avg(q) AS q, avg(d) AS d, avg(t) AS t FROM x),
  w AS (SELECT {', '.join(f'sum((x.{a} - c.{a}) * (x.{b} - c.{b})) / (count(*) - 2) AS {a}{b}' for a, b in
                          [('q', 'q'), ('q', 'd'), ('q', 't'), ('d', 'd'), ('d', 't'), ('t', 't')])} FROM x JOIN c USING (y)),
  g AS (SELECT u.q - v.q AS gq, u.d - v.d AS gd, u.t - v.t AS gt FROM c u, c v WHERE u.y = 1 AND v.y = 0),
  k AS (SELECT (dd * tt - dt * dt) * gq + (qt * dt - qd * tt) * gd + (qd * dt - qt * dd) * gt AS a,
    (qt * dt - qd * tt) * gq + (qq * tt - qt * qt) * gd + (qd * qt - qq * dt) * gt AS b,
    (qd * dt - qt * dd) * gq + (qd * qt - qq * dt) * gd + (qq * dd - qd * qd) * gt AS c,
    qq * (dd * tt - dt * dt) - qd * (qd * tt - dt * qt) + qt * (qd * dt - dd * qt) AS det, gq, gd, gt FROM w, g),
  n AS (SELECT a, b, c, sqrt((a * gq + b * gd + c * gt) * det) * CASE WHEN abs(a) >= greatest(abs(b), abs(c)) THEN sign(a)
    WHEN abs(b) >= abs(c) THEN sign(b) ELSE sign(c) END AS s FROM k)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('x.q', 3)} AS l_quantity, {r('x.d', 3)} AS d, {r('x.t', 3)} AS t, y,
    {r('((x.q - o.q) * a + (x.d - o.d) * b + (x.t - o.t) * c) / s', 3)} AS lda_0 FROM x, o, n"""
