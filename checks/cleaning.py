"""Gaps, outliers, rule violations, duplicates, labels, typos and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import operators as O

from .common import GAPPY_SQL, LKEY, LKEY_SQL, gappy, r, rounded, table, with_split


def delete_gaps(spark, sf):
    return O.HandleMV(["qty", "flag"], action="delete").transform(gappy(spark, sf))


def mark_sentinels(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY, "l_quantity", "l_returnflag")
    return O.HandleMV(action="mark", na_values=[1.0, "N", 7]).transform(l)


def fill(method, **kw):
    def run(spark, sf):
        return rounded(O.HandleMV(method=method, **kw).transform(gappy(spark, sf)))
    return run


def fill_knn(spark, sf):
    """Suppliers with a missing balance, filled from suppliers of similar key and nation."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nat"), F.when(
        F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("bal"), (F.col("s_suppkey") * 1.0).alias("pos"))
    return rounded(O.HandleMV(["nat", "bal", "pos"], method="knn", n_neighbors=3).transform(s), 4)


def fill_iterative(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:4], "l_quantity", F.when(
        F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price"), "l_discount")
    return rounded(O.HandleMV(["l_quantity", "price", "l_discount"], method="iterative", max_iter=3).transform(l), 3)


def outliers_deleted(spark, sf):
    return O.HandleOutlier(["value"], threshold=1.5).transform(table(spark, sf, "events"))


def outliers_clipped(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", "user_id")
    return rounded(O.HandleOutlier(["value", "user_id"], method="zscore", threshold=2.0, action="repair",
                                   flag_col="odd").transform(e), 4)


def outliers_cleared(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return O.HandleOutlier("value", threshold=1.0, action="repair", repair_method="set_missing").transform(e)


def rule_errors(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", "value", F.when(
        F.col("event_type") == "view", "n/a").otherwise(F.col("user_id").cast("string")).alias("uid"))
    return O.HandleError(rules=[
        {"col": "uid", "rule": "numeric", "action": "repair"},
        {"col": "value", "rule": "in_range", "min": 1, "max": 100, "action": "repair", "repair_method": "clip"},
        {"col": "uid", "rule": "positive"},
        {"col": "ts", "min": "2024-01-05", "max": "2024-01-25"},
        {"col": "event_type", "rule": "not_in", "allowed_values": ["click", "view", "error"]},
    ]).transform(e)


def non_iid(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:4], F.nullif("l_quantity", F.lit(1.0)).alias("q"), "l_extendedprice",
                                            (F.col("l_discount") * 10).alias("p"))
    return O.HandleNonIID(["q", "l_extendedprice"], pred_probs="p", threshold=0.9).transform(l)


def non_iid_deleted(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY[:4], "l_quantity", "l_extendedprice")
    return O.HandleNonIID(["l_quantity", "l_extendedprice"], action="delete").transform(l)


def weighted_groups(spark, sf):
    d = labelled(spark, sf)
    return O.ReweightUPG("source", pred_probs="p", label_col="quality", threshold=0.6).transform(d)


def weighted_bins(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", "user_id", (F.col("event_id") % 100 / 100).alias("p"))
    return O.ReweightUPG(feature_cols=["value", "user_id"], pred_probs="p", threshold=0.8, n_bins=4).transform(e)


def labelled(spark, sf):
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(y, "doc_id").select("doc_id", "source", "lang", "quality", "toxic",
                                      (F.col("n_chars") % 100 / 100).alias("p"))


LABELLED_SQL = """labelled AS (SELECT doc_id, source, lang, quality, toxic, n_chars % 100 / 100 AS p
  FROM documents JOIN labels USING (doc_id))"""


def flipped_labels(spark, sf):
    return rounded(O.CorrectLabel("quality", "p", confidence_threshold=0.8).transform(labelled(spark, sf)))


def flagged_labels(spark, sf):
    d = labelled(spark, sf).withColumns({"a": F.col("p") / 2, "b": F.lit(0.3), "c": 1 - F.col("p")}) \
        .select("doc_id", "toxic", "a", "b", "c")
    return rounded(O.CorrectLabel("toxic", ["a", "b", "c"], "flag", 0.4).transform(d))


def duplicates_first(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY, "l_quantity")
    return O.Deduplicate(["l_partkey", "l_suppkey"], "first", LKEY).transform(l)


def duplicates_last(spark, sf):
    l = table(spark, sf, "lineitem").select(*LKEY, F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return O.Deduplicate(["flag", "l_linenumber"], "last", LKEY).transform(l)


def duplicates_none(spark, sf):
    return O.Deduplicate(["o_custkey", "o_orderdate"], False).transform(table(spark, sf, "orders"))


def duplicates_rows(spark, sf):
    return O.Deduplicate().transform(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"))


def typos_mapped(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return O.CorrectTypo(["lang", "source"], {"fr": "french", "en": "english"}).transform(d)


def typos_fuzzy(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.translate("p_type", "AEO", "aE0").alias("kind"))
    return O.CorrectTypo("kind", vocabulary=["STANDARD", "PROMO", "ECONOMY"], threshold=60).transform(p)


def values_mapped(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("size"), "p_brand")
    return O.CustomClean(rules=[
        {"col": "size", "lt": 5, "replace_with": 0}, {"col": "size", "ge": 40, "replace_with": 40},
        {"col": "size", "eq": 0}, {"col": "size", "ne": 40, "replace_with": -1},
        {"col": "p_brand", "in": ["Brand#1", "Brand#2"], "replace_with": "low"}]).transform(p)


def text_replaced(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    out = O.CustomClean("replace_text", ["text"], pattern=r"[0-9]+", replacement="#").transform(d)
    return O.CustomClean("replace_text", ["source"], pattern=".", replacement="-", regex=False).transform(out)


def deletion_spares_held_out(spark, sf):
    """Bounds from training rows only; held-out rows are never deleted."""
    from millrace.plans.recipe import apply_with_split
    o = with_split(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), "o_orderdate", "2000-01-01")
    return apply_with_split(O.HandleOutlier("o_totalprice", threshold=0.3), o)


def fill_linear(spark, sf):
    """A column that is an exact linear function of two others, with gaps: the rounds must find it."""
    price = F.col("l_quantity") * 3.0 - F.col("l_tax") * 200.0 + 11.0
    l = table(spark, sf, "lineitem").select(*LKEY, "l_quantity", "l_tax", F.when(F.col("l_linenumber") != 3, price).alias("price"))
    return rounded(O.HandleMV(["l_quantity", "l_tax", "price"], method="iterative", max_iter=4).transform(l), 2)


QUERIES = {
    "c1_delete_gaps": delete_gaps, "c2_mark_sentinels": mark_sentinels, "c3_fill_median": fill("median"),
    "c3_fill_mean": fill("mean"), "c3_fill_mode": fill("mode"),
    "c3_fill_constant": fill("constant", cols=["qty", "disc"], fill_value=-1),
    "c4_fill_knn": fill_knn, "c5_fill_iterative": fill_iterative, "c5_fill_linear": fill_linear,
    "c6_outliers_deleted": outliers_deleted, "c6_outliers_clipped": outliers_clipped,
    "c6_outliers_cleared": outliers_cleared, "c6_outliers_held_out": deletion_spares_held_out,
    "c7_rule_errors": rule_errors, "c8_non_iid_weights": non_iid, "c8_non_iid_deleted": non_iid_deleted,
    "c9_weighted_groups": weighted_groups, "c9_weighted_bins": weighted_bins,
    "c10_labels_flipped": flipped_labels, "c10_labels_flagged": flagged_labels,
    "c11_duplicates_first": duplicates_first, "c11_duplicates_last": duplicates_last,
    "c11_duplicates_none": duplicates_none, "c11_duplicates_rows": duplicates_rows,
    "c12_typos_mapped": typos_mapped, "c12_typos_fuzzy": typos_fuzzy,
    "c13_values_mapped": values_mapped, "c14_text_replaced": text_replaced,
}


def fill_sql(qty, disc, flag):
    return f"""WITH {GAPPY_SQL} SELECT {', '.join(r(c) + ' AS ' + c if c == 'l_extendedprice' else c for c in LKEY)},
        {r(f'coalesce(qty, ({qty}))')} AS qty, {r(f'coalesce(disc, ({disc}))')} AS disc,
        {flag} AS flag, {r('l_tax')} AS l_tax FROM gappy"""


MODE_FLAG = "coalesce(flag, (SELECT flag FROM gappy WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1))"


def mode_of(c):
    return f"SELECT {c} FROM gappy WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1"


SQL = {
    "c1_delete_gaps": f"WITH {GAPPY_SQL} SELECT * FROM gappy WHERE qty IS NOT NULL AND flag IS NOT NULL",
    "c2_mark_sentinels": """SELECT CASE WHEN l_orderkey NOT IN (1, 7) THEN l_orderkey END AS l_orderkey,
        CASE WHEN l_linenumber NOT IN (1, 7) THEN l_linenumber END AS l_linenumber,
        CASE WHEN l_partkey NOT IN (1, 7) THEN l_partkey END AS l_partkey,
        CASE WHEN l_suppkey NOT IN (1, 7) THEN l_suppkey END AS l_suppkey,
        CASE WHEN l_extendedprice NOT IN (1, 7) THEN l_extendedprice END AS l_extendedprice,
        CASE WHEN l_quantity NOT IN (1, 7) THEN l_quantity END AS l_quantity,
        nullif(l_returnflag, 'N') AS l_returnflag FROM lineitem""",
    "c3_fill_median": fill_sql("SELECT quantile_cont(qty, 0.5) FROM gappy", "SELECT quantile_cont(disc, 0.5) FROM gappy",
                               MODE_FLAG),
    "c3_fill_mean": fill_sql("SELECT avg(qty) FROM gappy", "SELECT avg(disc) FROM gappy", MODE_FLAG),
    "c3_fill_mode": fill_sql(mode_of("qty"), mode_of("disc"), MODE_FLAG),
    "c3_fill_constant": fill_sql("-1", "-1", "flag"),
    "c4_fill_knn": f"""WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nat,
          CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS bal, s_suppkey * 1.0 AS pos FROM supplier),
        near AS (SELECT q.s_suppkey, d.bal, row_number() OVER (PARTITION BY q.s_suppkey ORDER BY
          sqrt(((q.nat - d.nat) ** 2 + (q.pos - d.pos) ** 2) * 3 / 2), d.bal) AS k
          FROM s q JOIN s d ON q.bal IS NULL AND d.bal IS NOT NULL),
        f AS (SELECT s_suppkey, avg(bal) AS fill FROM near WHERE k <= 3 GROUP BY 1)
        SELECT s_suppkey, nat, {r('coalesce(bal, fill)', 4)} AS bal, CAST(pos AS DOUBLE) AS pos
        FROM s LEFT JOIN f USING (s_suppkey)""",
    "c6_outliers_deleted": """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
        SELECT events.* FROM events, b WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "c6_outliers_clipped": f"""WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s, avg(user_id) AS um,
          stddev_samp(user_id) AS us FROM events)
        SELECT event_id, {r('least(greatest(value, m - 2 * s), m + 2 * s)', 4)} AS value,
          {r('least(greatest(CAST(user_id AS DOUBLE), um - 2 * us), um + 2 * us)', 4)} AS user_id,
          CAST(value NOT BETWEEN m - 2 * s AND m + 2 * s OR user_id NOT BETWEEN um - 2 * us AND um + 2 * us AS INTEGER) AS odd
        FROM events, b""",
    "c6_outliers_cleared": """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
        SELECT event_id, CASE WHEN value BETWEEN q1 - (q3 - q1) AND q3 + (q3 - q1) THEN value END AS value FROM events, b""",
    "c6_outliers_held_out": """WITH o AS (SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderdate >=
          TIMESTAMP '2000-01-01' THEN 'std_test' ELSE 'train' END AS __split__ FROM orders),
        b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM o
          WHERE __split__ = 'train')
        SELECT o.* FROM o, b WHERE __split__ = 'std_test' OR o_totalprice BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1)""",
    "c7_rule_errors": """SELECT event_id, ts, event_type, least(greatest(value, 1.0), 100.0) AS value,
        CAST(user_id AS VARCHAR) AS uid FROM events WHERE event_type IN ('click', 'error') AND user_id > 0
        AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'""",
    "c8_non_iid_weights": """WITH a AS (SELECT *, nullif(l_quantity, 1.0) AS q, coalesce(nullif(l_quantity, 1.0), 0.0) AS x,
          l_discount * 10 AS p FROM lineitem),
        m AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(l_extendedprice) AS me, stddev_samp(l_extendedprice) AS se FROM a),
        s AS (SELECT a.*, ((abs((x - mx) / sx) + abs((l_extendedprice - me) / se)) / 2
          + 1.0 - greatest(1.0 - p, p)) / 2 AS score FROM a, m),
        c AS (SELECT quantile_cont(score, 0.9) AS cut FROM s)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, l_extendedprice, p,
          CASE WHEN score >= cut THEN CAST(0.2 AS DOUBLE) ELSE 1.0 END AS sample_weight FROM s, c""",
    "c8_non_iid_deleted": """WITH m AS (SELECT avg(l_quantity) AS mx, stddev_samp(l_quantity) AS sx,
          avg(l_extendedprice) AS me, stddev_samp(l_extendedprice) AS se FROM lineitem),
        s AS (SELECT lineitem.*, (abs((l_quantity - mx) / sx) + abs((l_extendedprice - me) / se)) / 2 AS score FROM lineitem, m),
        c AS (SELECT quantile_cont(score, 0.95) AS cut FROM s)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM s, c WHERE score < cut""",
    "c9_weighted_groups": f"""WITH {LABELLED_SQL},
        e AS (SELECT *, CAST(CAST(p > 1.0 - p AS INTEGER) <> quality AS INTEGER) AS err FROM labelled),
        g AS (SELECT source, avg(err) AS m FROM e GROUP BY 1),
        j AS (SELECT e.*, m FROM e JOIN g USING (source)), c AS (SELECT quantile_cont(m, 0.6) AS cut FROM j)
        SELECT doc_id, source, lang, quality, toxic, p, CASE WHEN m >= cut THEN CAST(2.0 AS DOUBLE) ELSE 1.0 END
          AS sample_weight FROM j, c""",
    "c9_weighted_bins": """WITH e AS (SELECT event_id, value, user_id, event_id % 100 / 100 AS p FROM events),
        q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS v, quantile_cont(user_id, [0.25, 0.5, 0.75]) AS u FROM e),
        b AS (SELECT e.*, (value > v[1])::INT + (value > v[2])::INT + (value > v[3])::INT AS bv,
          (user_id > u[1])::INT + (user_id > u[2])::INT + (user_id > u[3])::INT AS bu, 1.0 - greatest(1.0 - p, p) AS s FROM e, q),
        g AS (SELECT bv, bu, avg(s) AS m FROM b GROUP BY 1, 2),
        j AS (SELECT b.*, m FROM b JOIN g USING (bv, bu)), c AS (SELECT quantile_cont(m, 0.8) AS cut FROM j)
        SELECT event_id, value, user_id, p, CASE WHEN m >= cut THEN CAST(2.0 AS DOUBLE) ELSE 1.0 END AS sample_weight
        FROM j, c""",
    "c10_labels_flipped": f"""WITH {LABELLED_SQL}, w AS (SELECT *, greatest(p, 1.0 - p) >= 0.8
          AND CAST(p > 1.0 - p AS INTEGER) <> quality AS bad FROM labelled)
        SELECT doc_id, source, lang, CASE WHEN bad THEN 1 - quality ELSE quality END AS quality, toxic, {r('p')} AS p,
          CAST(bad AS INTEGER) AS quality_corrected FROM w""",
    "c10_labels_flagged": f"""WITH {LABELLED_SQL}, a AS (SELECT doc_id, toxic, p / 2 AS a, CAST(0.3 AS DOUBLE) AS b, 1 - p AS c
          FROM labelled), w AS (SELECT *, greatest(a, b, c) AS m FROM a)
        SELECT doc_id, toxic, {r('a')} AS a, {r('b')} AS b, {r('c')} AS c, CAST(m >= 0.4 AND
          CASE WHEN a = m THEN 0 WHEN b = m THEN 1 ELSE 2 END <> toxic AS INTEGER) AS toxic_corrected FROM w""",
    "c11_duplicates_first": f"""SELECT {LKEY_SQL}, l_quantity FROM lineitem QUALIFY row_number() OVER
        (PARTITION BY l_partkey, l_suppkey ORDER BY {LKEY_SQL}) = 1""",
    "c11_duplicates_last": f"""SELECT {LKEY_SQL}, nullif(l_returnflag, 'N') AS flag FROM lineitem QUALIFY row_number() OVER
        (PARTITION BY nullif(l_returnflag, 'N'), l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LKEY)}) = 1""",
    "c11_duplicates_none": """SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1""",
    "c11_duplicates_rows": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "c12_typos_mapped": """SELECT doc_id, CASE lang WHEN 'fr' THEN 'french' WHEN 'en' THEN 'english' ELSE lang END AS lang,
        source FROM documents""",
    "c5_fill_linear": f"""SELECT {', '.join(r(c, 2) + ' AS ' + c if c == 'l_extendedprice' else c for c in LKEY)}, {r('l_quantity', 2)} AS l_quantity,
        {r('l_tax', 2)} AS l_tax, {r('l_quantity * 3.0 - l_tax * 200.0 + 11.0', 2)} AS price FROM lineitem""",
    # Longest common subsequences, a row of the table for every character.
    "c12_typos_fuzzy": """WITH RECURSIVE v AS (SELECT DISTINCT translate(p_type, 'AEO', 'aE0') AS a FROM part),
        t AS (SELECT * FROM (VALUES (0, 'STANDARD'), (1, 'PROMO'), (2, 'ECONOMY')) AS x(no, b)),
        l(a, no, b, i, line) AS (SELECT a, no, b, 0, list_transform(range(0, length(b) + 1), lambda x: CAST(0 AS BIGINT)) FROM v, t
          UNION ALL SELECT a, no, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE
            list_max(list_transform(range(1, j + 1), lambda k: greatest(line[k + 1], CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1)
              THEN line[k] + 1 ELSE 0 END))) END) FROM l WHERE i < length(a)),
        s AS (SELECT a, b, no, 200.0 * line[length(b) + 1] / (length(a) + length(b)) AS score FROM l WHERE i = length(a)),
        f AS (SELECT a, b FROM s WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, no) = 1)
        SELECT p_partkey, coalesce(b, translate(p_type, 'AEO', 'aE0')) AS kind FROM part
        LEFT JOIN f ON a = translate(p_type, 'AEO', 'aE0')""",
    "c13_values_mapped": """WITH a AS (SELECT p_partkey, nullif(p_size, 7) AS s, p_brand FROM part),
        b AS (SELECT *, CASE WHEN s < 5 THEN 0 WHEN s >= 40 THEN 40 ELSE s END AS s1 FROM a),
        c AS (SELECT *, nullif(s1, 0) AS s2 FROM b)
        SELECT p_partkey, CAST(CASE WHEN s2 IS DISTINCT FROM 40 THEN -1 ELSE s2 END AS INTEGER) AS size,
          CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'low' ELSE p_brand END AS p_brand FROM c""",
    "c14_text_replaced": """SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS text,
        replace(source, '.', '-') AS source FROM documents""",
}
