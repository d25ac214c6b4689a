"""Tables and fixtures shared by the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import shared_folder

# Columns that identify a lineitem row.
LKEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LKEY_SQL = ", ".join(LKEY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Added before rounding, so values that lie exactly between two results round the same way everywhere.
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Floating columns rounded, negative zero made positive."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`").cast("double") + F.lit(NUDGE), per_column.get(f.name, digits))
         + F.lit(0.0)).alias(f.name)
        if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema.fields])


def r(sql: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round(CAST({sql} AS DOUBLE) + 1e-9, {digits}) + 0.0)"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to lineitem as user-item interactions."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        F.col("o_orderdate").alias("timestamp"), (F.col("l_quantity") > 25).cast("int").alias("rating"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


INTERACTION_KEY = ["l_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_extendedprice"]
INTERACTION_KEY_SQL = ", ".join(INTERACTION_KEY)

INTERACTIONS_SQL = """interactions AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderdate AS timestamp,
         CAST(l_quantity > 25 AS INTEGER) AS rating, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing values where quantity is 1, discount is 0 or the flag is 'N'."""
    return table(spark, sf_dir, "lineitem").select(
        *LKEY, F.nullif("l_quantity", F.lit(1.0)).alias("qty"), F.nullif("l_discount", F.lit(0.0)).alias("disc"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"), "l_tax")


GAPPY_SQL = f"""gappy AS (
  SELECT {LKEY_SQL}, nullif(l_quantity, 1.0) AS qty, nullif(l_discount, 0.0) AS disc,
         nullif(l_returnflag, 'N') AS flag, l_tax FROM lineitem)"""


def with_split(df: DataFrame, time_col: str, cut: str) -> DataFrame:
    """Held-out marker for rows at or after a date."""
    late = F.col(time_col) >= F.lit(cut).cast("timestamp_ntz")
    return df.withColumn("__split__", F.when(late, "std_test").otherwise("train"))


def draw_sql(keys: str, seed: int = 42) -> str:
    """The draw of samples in SQL: 60 bits of the MD5 of seed and keys."""
    parts = ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in keys.split(","))
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 15) AS BIGINT)"
