"""Joins, unions, schema work, parsing, sorting, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import operators as O

from .common import INTERACTION_KEY, INTERACTIONS_SQL, interactions, r, rounded, table


def join_key(spark, sf):
    """Text-compared keys, missing keys match nothing, clashing names are filled from the right."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("k"),
                                            F.nullif("s_acctbal", F.col("s_acctbal") * 0).alias("bal"),
                                            F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("n_name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    return O.JoinTable(aux_df=n, key_col="k").transform(s)


def join_statistics(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return rounded(O.JoinTable(method="agg", aux_df=o, key_col="o_custkey", prefix="ord").transform(c), 4)


def join_statistics_median(spark, sf):
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"))
    l = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return rounded(O.JoinTable(method="agg", aux_df=l, key_col="l_partkey", agg_funcs=["median", "std", "count"],
                               max_cols=1).transform(c), 4)


def join_users_items(spark, sf):
    i = interactions(spark, sf).withColumn("name", F.lit("x")).withColumn(
        "item_id", F.nullif("item_id", F.lit(7))).select(*[c for c in INTERACTION_KEY], "user_id", "name", "rating")
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    p = table(spark, sf, "part").select(F.nullif("p_partkey", F.lit(9)).alias("item_id"), "p_brand")
    return O.JoinTable(method="rec", user_df=u, item_df=p).transform(i)


def join_side(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_tax")
    return O.JoinTable("key", o, "o_orderkey").transform(l)


def join_key_outer(spark, sf):
    """Rows of either table without a partner, missing keys among them."""
    o = table(spark, sf, "orders").select(F.nullif("o_orderkey", F.lit(7)).alias("k"), "o_totalprice")
    l = table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 5 > 0, F.col("l_orderkey")).alias("k"), "l_linenumber", "l_tax")
    return O.JoinTable("key", o, "k", "outer").transform(l)


def join_key_right(spark, sf):
    o = table(spark, sf, "orders").select(F.nullif("o_orderkey", F.lit(7)).alias("k"), "o_totalprice")
    l = table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 5 > 0, F.col("l_orderkey")).alias("k"), "l_linenumber", "l_tax")
    return O.JoinTable("key", o, "k", "right").transform(l)


def stacked(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), "c_mktsegment")
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), "s_name")
    return O.ConcatTable(b).transform(a)


def stacked_shared_columns(spark, sf):
    a = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_tax")
    b = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_discount")
    return O.ConcatTable([b], fill_missing=False, dedup=True).transform(a)


def side_by_side(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    b = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return O.ConcatTable(b, axis="horizontal", order_cols=[["p_partkey"], ["c_acctbal", "c_custkey"]]).transform(a)


def align_schema(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").cast("string").alias("v"), F.when(
        F.col("event_type") == "error", "bad").otherwise(F.col("user_id").cast("string")).alias("uid"))
    return rounded(O.AlignSchema({"v": "amount", "uid": "user"}, {"amount": "float64", "user": "int64"},
                                 ["amount", "level"], 0).transform(e))


def renamed(spark, sf):
    return O.RenameColumn({"r_name": "name", "absent": "x"}).transform(table(spark, sf, "region"))


def dropped(spark, sf):
    return O.DropColumns(["o_orderdate", "absent", "o_orderpriority"]).transform(table(spark, sf, "orders"))


def cast_types(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("size"),
        F.when(F.col("p_size") > 25, "true").when(F.col("p_size") > 10, "No").otherwise("maybe").alias("big"),
        F.when(F.col("p_size") % 2 == 0, "2024-02-30").otherwise("2024-02-29").alias("day"),
        F.col("p_retailprice").cast("string").alias("price"), F.col("p_size").alias("label"))
    return O.CastType({"size": "int", "big": "bool", "day": "datetime", "price": "float", "label": "str"}).transform(p)


def parse_number(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", F.concat(
        F.col("value").cast("string"), F.lit("d"))).when(F.col("event_type") == "click", "nan").when(
        F.col("event_type") == "error", F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("e1 "))).otherwise(
        F.col("value").cast("string")).alias("amount"))
    return rounded(O.ParseNumber("amount").transform(e), 4)


def parse_date_text(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "not a date").when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return O.ParseDate("d", target_format="%Y%m%d", formats=["%d/%m/%Y"], out_features=[
        "year", "month", "day", "days_since_epoch", "day_of_week"]).transform(o)


def parse_date_yymmdd(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, 991350).when(
        F.col("o_orderkey") % 11 == 0, -5).otherwise(
        F.date_format("o_orderdate", "yyMMdd").cast("int")).alias("d"))
    return O.ParseDate("d", mode="int_yymmdd").transform(o)


def parse_date_birth(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.date_format("o_orderdate", "yyMMdd").cast("int") + F.when(
        F.col("o_custkey") % 2 == 0, 5000).otherwise(0)).alias("d"))
    return O.ParseDate("d", mode="berka_birth", drop_original=True).transform(o)


def sorted_rows(spark, sf):
    """The operator's own order as positions: numbers by partition and place in it, ranked."""
    from millrace.functions.ordering import row_index
    from millrace.session import materialise
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("st"), "o_totalprice")
    out = O.SortRows(["st", "o_totalprice"], [False, True], ["o_orderkey"]).transform(o)
    place = materialise(out.withColumn("place", F.monotonically_increasing_id()).select("o_orderkey", "place"))
    return row_index(place, ["place"], "pos").select("o_orderkey", "pos")


def split_named(spark, sf):
    e = table(spark, sf, "customer").select("c_custkey", "c_name")
    return O.SplitColumn("c_name", ["kind", "no", "more"], sep="#").transform(e)


def split_unnamed(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("  ", "p_name", "p_type").alias("t"))
    return O.SplitColumn("t").transform(p)


def custom_callable(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(O.CustomTransform(lambda d: d.withColumn("half", F.col("o_totalprice") / 2)).transform(o), 3)


QUERIES = {
    "j1_join_key": join_key, "j2_join_statistics": join_statistics, "j2_join_statistics_median": join_statistics_median,
    "j3_join_users_items": join_users_items, "j4_join_side": join_side, "j1_join_key_outer": join_key_outer, "j1_join_key_right": join_key_right, "u1_stacked": stacked,
    "u1_stacked_shared": stacked_shared_columns, "u2_side_by_side": side_by_side, "s1_align_schema": align_schema,
    "s2_rename": renamed, "s3_drop": dropped, "s4_cast_types": cast_types, "s5_parse_number": parse_number,
    "s6_parse_date_text": parse_date_text, "s7_parse_date_yymmdd": parse_date_yymmdd,
    "s8_parse_date_birth": parse_date_birth, "s9_sort_rows": sorted_rows, "s10_split_named": split_named,
    "s10_split_unnamed": split_unnamed, "s11_custom_callable": custom_callable,
}

_SIDES = """WITH o AS (SELECT nullif(o_orderkey, 7) AS k, o_totalprice FROM orders),
  l AS (SELECT CASE WHEN l_orderkey % 5 > 0 THEN l_orderkey END AS k, l_linenumber, l_tax FROM lineitem) """

SQL = {
    "j1_join_key": """WITH s AS (SELECT s_suppkey, nullif(s_nationkey, 3) AS k, nullif(s_acctbal, s_acctbal * 0) AS bal,
          CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS own FROM supplier)
        SELECT s_suppkey, k, bal, coalesce(own, n_name) AS n_name, n_regionkey
        FROM s LEFT JOIN nation ON k = n_nationkey""",
    "j2_join_statistics": f"""SELECT c_custkey AS o_custkey, c_name,
          CAST(ord_o_orderkey_mean AS DOUBLE) AS ord_o_orderkey_mean, ord_o_orderkey_max, ord_o_orderkey_min,
          ord_o_totalprice_mean, ord_o_totalprice_max, ord_o_totalprice_min, ord_o_orderstatus_nunique,
          ord_o_orderpriority_nunique
        FROM customer LEFT JOIN (SELECT o_custkey AS k, {r('avg(o_orderkey)', 4)} AS ord_o_orderkey_mean,
          max(o_orderkey) AS ord_o_orderkey_max, min(o_orderkey) AS ord_o_orderkey_min,
          {r('avg(o_totalprice)', 4)} AS ord_o_totalprice_mean, max(o_totalprice) AS ord_o_totalprice_max,
          min(o_totalprice) AS ord_o_totalprice_min, count(DISTINCT o_orderstatus) AS ord_o_orderstatus_nunique,
          count(DISTINCT o_orderpriority) AS ord_o_orderpriority_nunique FROM orders GROUP BY 1) ON k = c_custkey""",
    "j2_join_statistics_median": f"""SELECT p_partkey AS l_partkey, m AS l_quantity_median, s AS l_quantity_std,
          c AS l_quantity_count, u AS l_returnflag_nunique
        FROM part LEFT JOIN (SELECT l_partkey AS k, {r('median(l_quantity)', 4)} AS m,
          {r('stddev_samp(l_quantity)', 4)} AS s, count(l_quantity) AS c, count(DISTINCT l_returnflag) AS u
          FROM lineitem GROUP BY 1) ON k = p_partkey""",
    "j3_join_users_items": f"""WITH {INTERACTIONS_SQL},
        i AS (SELECT l_orderkey, l_linenumber, nullif(item_id, 7) AS item_id, l_suppkey, l_extendedprice, user_id,
              'x' AS name_x, rating FROM interactions),
        p AS (SELECT nullif(p_partkey, 9) AS pk, p_brand FROM part)
        SELECT i.*, c_name AS name_y, p_brand FROM i LEFT JOIN customer ON user_id = c_custkey
        LEFT JOIN p ON item_id IS NOT DISTINCT FROM pk""",
    "j4_join_side": """SELECT l_orderkey AS o_orderkey, l_linenumber, l_tax, o_totalprice
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "j1_join_key_outer": _SIDES + "SELECT l.k, l_linenumber, l_tax, o_totalprice FROM l FULL JOIN o ON l.k = o.k",
    "j1_join_key_right": _SIDES + "SELECT l.k, l_linenumber, l_tax, o_totalprice FROM l RIGHT JOIN o ON l.k = o.k",
    "u1_stacked": """SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment, CAST(NULL AS VARCHAR) AS s_name FROM customer
        UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier""",
    "u1_stacked_shared": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "u2_side_by_side": """SELECT p_partkey, p_retailprice, c_custkey, c_acctbal FROM
        (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_partkey) AS r FROM part) a FULL JOIN
        (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer) b
        ON a.r = b.r""",
    "s1_align_schema": """SELECT event_id, round(value, 6) AS amount,
        CASE WHEN event_type <> 'error' THEN user_id END AS "user", CAST(0 AS INTEGER) AS level FROM events""",
    "s2_rename": "SELECT r_regionkey, r_name AS name FROM region",
    "s3_drop": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "s4_cast_types": """SELECT p_partkey, CAST(p_size AS BIGINT) AS size,
        CASE WHEN p_size > 25 THEN true WHEN p_size > 10 THEN false END AS big,
        CASE WHEN p_size % 2 = 1 THEN TIMESTAMP '2024-02-29' END AS day, p_retailprice AS price,
        CAST(p_size AS VARCHAR) AS label FROM part""",
    "s5_parse_number": """SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN NULL
        WHEN 'error' THEN round(value * 10, 4) ELSE round(value, 4) END AS amount FROM events""",
    "s6_parse_date_text": """SELECT o_orderkey, CASE WHEN k THEN strftime(o_orderdate, '%Y%m%d') END AS d,
        CAST(CASE WHEN k THEN year(o_orderdate) END AS INTEGER) AS d_year,
        CAST(CASE WHEN k THEN month(o_orderdate) END AS INTEGER) AS d_month,
        CAST(CASE WHEN k THEN day(o_orderdate) END AS INTEGER) AS d_day,
        CAST(CASE WHEN k THEN date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS INTEGER)
          AS d_days_since_epoch,
        CAST(CASE WHEN k THEN isodow(o_orderdate) - 1 END AS INTEGER) AS d_day_of_week
        FROM (SELECT *, o_orderstatus <> 'F' AS k FROM orders)""",
    "s7_parse_date_yymmdd": """WITH a AS (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 991350
          WHEN o_orderkey % 11 = 0 THEN -5 ELSE CAST(strftime(o_orderdate, '%y%m%d') AS INTEGER) END AS INTEGER) AS d,
          CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_orderdate END AS t FROM orders)
        SELECT o_orderkey, d, CAST(year(t) AS INTEGER) AS d_year, CAST(month(t) AS INTEGER) AS d_month,
          CAST(day(t) AS INTEGER) AS d_day,
          CAST(date_diff('day', DATE '1970-01-01', CAST(t AS DATE)) AS INTEGER) AS d_days_since_epoch FROM a""",
    "s8_parse_date_birth": """WITH a AS (SELECT o_orderkey, o_custkey % 2 = 0 AS f, try_cast('19' ||
          strftime(o_orderdate, '%y-%m-%d') AS DATE) AS t FROM orders)
        SELECT o_orderkey, CAST(year(t) AS INTEGER) AS d_year, CAST(month(t) AS INTEGER) AS d_month,
          CAST(day(t) AS INTEGER) AS d_day, CAST(date_diff('day', DATE '1970-01-01', t) AS INTEGER) AS d_days_since_epoch,
          CASE WHEN t IS NOT NULL THEN CASE WHEN f THEN 'F' ELSE 'M' END END AS d_gender FROM a""",
    "s9_sort_rows": """SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST,
        o_totalprice, o_orderkey) - 1 AS pos FROM orders""",
    "s10_split_named": """SELECT c_custkey, c_name, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS no,
        CAST(NULL AS VARCHAR) AS more FROM customer""",
    "s10_split_unnamed": """WITH a AS (SELECT p_partkey, p_name || '  ' || p_type AS t FROM part),
        b AS (SELECT *, string_split_regex(t, '\\s+') AS x FROM a)
        SELECT p_partkey, t, x[1] AS t_0, x[2] AS t_1, x[3] AS t_2 FROM b""",
    "s11_custom_callable": "SELECT o_orderkey, o_totalprice, round(o_totalprice / 2, 3) AS half FROM orders",
}
