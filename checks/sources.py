"""Readers and writers, driven by files that Spark first writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import sources as S

from .common import LKEY, LKEY_SQL, rounded, scratch, table


def parquet_columns(spark, sf):
    return S.parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity", "absent"])


def csv_declared(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "orders").write.option("header", True).csv(path)
    df = S.csv(spark, path, columns=["o_orderkey", "o_totalprice", "o_orderdate"], schema=(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"))
    return df


def csv_inferred(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "customer").write.option("header", True).csv(path)
    df = S.csv(spark, path)
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                     F.col("c_acctbal").cast("double").alias("c_acctbal"))


def csv_many_files(spark, sf):
    path = scratch(spark, "folder")
    table(spark, sf, "supplier").write.option("header", True).csv(f"{path}/a")
    table(spark, sf, "supplier").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000) \
        .write.option("header", True).csv(f"{path}/b")
    return S.csv_folder(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


def csv_without_header(spark, sf):
    path = scratch(spark, "bare")
    table(spark, sf, "lineitem").select(*LKEY, "l_quantity", "l_tax").write.csv(path)
    return S.headerless_csv(spark, path, ["txId", "time_step"], schema=(
        "a bigint, b int, c bigint, d bigint, e double, f double, g double"))


def two_character_delimiter(spark, sf):
    path = scratch(spark, "dat")
    table(spark, sf, "part").select(F.concat_ws("::", "p_partkey", "p_name", "p_type", "p_size").alias("value")) \
        .write.text(path)
    return S.delimited(spark, path, "part_id bigint, name string, kind string, size int")


def quoted_semicolons(spark, sf):
    path = scratch(spark, "asc")
    table(spark, sf, "nation").write.options(header=True, sep=";", quoteAll=True, encoding="ISO-8859-1").csv(path)
    return S.delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int", sep=";", header=True)


def csv_pruned(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "part").write.option("header", True).csv(path)
    return S.csv(spark, path, columns=["p_partkey", "p_retailprice"], schema=(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"))


def json_lines_renamed(spark, sf):
    path = scratch(spark, "json")
    table(spark, sf, "documents").write.option("compression", "gzip").json(path)
    return S.json_lines(spark, path, "doc_id bigint, lang string, n_chars bigint", {"n_chars": "length"})


def arff_file(spark, sf):
    path = scratch(spark, "arff")
    l = table(spark, sf, "lineitem")
    head = ["@relation items", "% a comment", "@attribute key numeric", "@attribute qty real",
            "@attribute flag {A,N,R}", "@data"]
    lines = l.select(F.concat_ws(",", "l_orderkey", F.when(F.col("l_quantity") == 1, "?").otherwise(
        F.col("l_quantity").cast("string")), F.concat(F.lit("b'"), "l_returnflag", F.lit("'"))).alias("value"))
    text = spark.createDataFrame([(h,) for h in head], "value string").coalesce(1)
    text.unionByName(lines).write.text(path)
    return S.arff(spark, path)


def split_table_round_trip(spark, sf):
    path = scratch(spark, "split")
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    S.split_tables(table(spark, sf, "orders").withColumn("__split__", F.when(late, "std_test").otherwise("train")), path)
    return spark.read.parquet(path).groupBy("__split__").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").cast("bigint").alias("keys"))


def split_summary(spark, sf):
    path = scratch(spark, "meta")
    o = table(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    late = F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")
    S.summary_json(S.split_summary(o.where(~late), o.where(late), "y", seed=42), path)
    return rounded(spark.read.schema("train_rows bigint, positive_ratio_train double, std_test_rows bigint, "
                                     "positive_ratio_std_test double, seed int").json(path))


def result_csv_round_trip(spark, sf):
    path = scratch(spark, "result")
    out = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    S.result_csv(out, path)
    return S.csv(spark, path, "o_orderpriority string, n bigint")


def list_parsing(spark, sf):
    c = table(spark, sf, "conversations")
    text = F.when(F.col("turn") % 3 == 0, "broken").otherwise(F.concat(F.lit("["), "conv_id", F.lit(", "), "turn", F.lit("]")))
    return c.select("conv_id", "turn", F.array_join(S.parse_list(text), ",").alias("items"),
                    F.size(S.parse_list(text)).cast("bigint").alias("n"))


def delimited_lists(spark, sf):
    d = table(spark, sf, "documents")
    joined = F.when(F.col("lang") != "fr", F.concat(F.col("lang"), F.lit(" , "), F.col("source"), F.lit(",x ")))
    return d.select("doc_id", F.array_join(S.list_from_text(joined, ",", trim=True), "|").alias("items"),
                    F.size(S.list_from_text(joined, ",", trim=True)).cast("bigint").alias("n"))


def epoch_seconds(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.when(F.col("event_type") != "error", F.col("ts")))
    out = S.epoch_column(S.epoch_column(e, "at", "seconds"), "at", "seconds_or_zero", missing=0.0)
    return rounded(out.select("event_id", "seconds", "seconds_or_zero"), 3)


QUERIES = {
    "io1_parquet_columns": parquet_columns, "io2_csv_inferred": csv_inferred, "io2_csv_declared": csv_declared,
    "io3_csv_many_files": csv_many_files, "io4_csv_without_header": csv_without_header,
    "io5_two_character_delimiter": two_character_delimiter, "io6_quoted_semicolons": quoted_semicolons,
    "io7_csv_pruned": csv_pruned, "io8_json_lines": json_lines_renamed, "io9_arff": arff_file,
    "io10_split_tables": split_table_round_trip, "io11_split_summary": split_summary,
    "io12_result_csv": result_csv_round_trip, "io13_list_parsing": list_parsing,
    "io14_delimited_lists": delimited_lists, "io15_epoch_seconds": epoch_seconds,
}

SQL = {
    "io1_parquet_columns": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "io2_csv_inferred": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "io2_csv_declared": "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders",
    "io3_csv_many_files": """SELECT * FROM supplier UNION ALL
        SELECT s_suppkey + 1000000 AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""",
    "io4_csv_without_header": """SELECT l_orderkey AS "txId", l_linenumber AS time_step, l_partkey AS feat_0,
        l_suppkey AS feat_1, l_extendedprice AS feat_2, l_quantity AS feat_3, l_tax AS feat_4 FROM lineitem""",
    "io5_two_character_delimiter": "SELECT p_partkey AS part_id, p_name AS name, p_type AS kind, p_size AS size FROM part",
    "io6_quoted_semicolons": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "io7_csv_pruned": "SELECT p_partkey, p_retailprice FROM part",
    "io8_json_lines": "SELECT doc_id, lang, n_chars AS length FROM documents",
    "io9_arff": """SELECT CAST(l_orderkey AS DOUBLE) AS "key", nullif(l_quantity, 1.0) AS qty,
        l_returnflag AS flag FROM lineitem""",
    "io10_split_tables": """SELECT CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'std_test' ELSE 'train' END
        AS __split__, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""",
    "io11_split_summary": """SELECT count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS train_rows,
        round(avg(CAST(o_orderstatus = 'F' AS INTEGER)) FILTER (o_orderdate < TIMESTAMP '2000-01-01'), 6)
          AS positive_ratio_train,
        count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') AS std_test_rows,
        round(avg(CAST(o_orderstatus = 'F' AS INTEGER)) FILTER (o_orderdate >= TIMESTAMP '2000-01-01'), 6)
          AS positive_ratio_std_test, CAST(42 AS INTEGER) AS seed FROM orders""",
    "io12_result_csv": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "io13_list_parsing": """SELECT conv_id, turn,
        CASE WHEN turn % 3 = 0 THEN '' ELSE conv_id || ',' || turn END AS items,
        CAST(CASE WHEN turn % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n FROM conversations""",
    "io14_delimited_lists": """SELECT doc_id, CASE WHEN lang <> 'fr' THEN lang || '|' || source || '|x' ELSE '' END AS items,
        CAST(CASE WHEN lang <> 'fr' THEN 3 ELSE 0 END AS BIGINT) AS n FROM documents""",
    "io15_epoch_seconds": """SELECT event_id,
        CASE WHEN event_type <> 'error' THEN round(epoch_us(ts) / 1e6, 3) END AS seconds,
        CASE WHEN event_type <> 'error' THEN round(epoch_us(ts) / 1e6, 3) ELSE 0.0 END AS seconds_or_zero FROM events""",
}
