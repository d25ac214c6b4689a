"""Operators that search nearest neighbours, over all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import operators as O
from millrace.functions.neighbors import nearest

from .common import r, rounded, table

WIDTH = 64


def points(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(WIDTH)],
                    (F.col("label") < 3).cast("int").alias("y"))


def neighbour_list(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return rounded(nearest(e, e, 3, same_table=True))


def tomek(spark, sf):
    return O.Undersample("y", "tomek", key_cols=["vec_id"]).transform(features_only(spark, sf)).select("vec_id", "y")


def edited(spark, sf):
    return O.Undersample("y", "enn", 3, key_cols=["vec_id"]).transform(features_only(spark, sf)).select("vec_id", "y")


def features_only(spark, sf):
    """The id as text, so it does not count as a numeric feature."""
    return points(spark, sf).withColumn("vec_id", F.col("vec_id").cast("string"))


def synthetic(spark, sf):
    """All rows of the balanced table, the new ones with the exact place between two neighbours."""
    return rounded(O.Oversample("y", "smote", 5).transform(classes(spark, sf)), 5)


def adaptive(spark, sf):
    return rounded(O.Oversample("y", "adasyn", 5).transform(classes(spark, sf)), 5)


def classes(spark, sf):
    """Ten labels folded into four classes of different sizes."""
    return table(spark, sf, "embeddings").select(
        *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(WIDTH)],
        F.least("label", F.lit(3)).alias("y"))


QUERIES = {"p18_neighbour_list": neighbour_list, "p18_tomek": tomek, "p19_edited": edited,
           "p21_synthetic": synthetic, "p22_adaptive": adaptive}


def near(k):
    return f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, (label < 3)::INT AS y FROM embeddings),
      n AS (SELECT a.vec_id, b.vec_id AS nb, a.y, b.y AS ny, list_distance(a.v, b.v) AS d, row_number() OVER
        (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k FROM e a JOIN e b ON a.vec_id <> b.vec_id),
      t AS (SELECT * FROM n WHERE k <= {k}), m AS (SELECT y AS c FROM e GROUP BY 1 ORDER BY count(*), y LIMIT 1)"""


COLUMNS = ", ".join(r(f"v[{i + 1}]", 5) + f" AS x{i}" for i in range(WIDTH))
SMOTE_SLOTS = """s AS (SELECT y, y || ':' || k AS slot, first + draw('42|' || y || '|' || k) % n AS id
      FROM (SELECT y, n, first, unnest(range(0, most - n)) AS k FROM c WHERE n < most))"""
ADASYN_SLOTS = """o AS (SELECT a.id, a.y, a.y <> b.y AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS k
      FROM e a JOIN e b ON a.id <> b.id WHERE a.y IN (SELECT y FROM c WHERE n < most)),
    w AS (SELECT id, y, avg(other::INT) AS w FROM o WHERE k <= 5 GROUP BY ALL),
    q AS (SELECT id, y, CAST(round_even(w / sum(w) OVER (PARTITION BY y) * (most - n), 0) AS INTEGER) AS g FROM w JOIN c USING (y)),
    s AS (SELECT y, id || ':' || k AS slot, id FROM (SELECT y, id, unnest(range(1, g + 1)) AS k FROM q))"""


def synthetic_sql(slots):
    """New rows: a slot's start row, one of its five neighbours within the class, and a step, all named by MD5 draws."""
    draw = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    for name in ("'42|' || y || '|' || k",):
        slots = slots.replace(f"draw({name})", draw.format(name))
    return f"""WITH e AS (SELECT v, y, row_number() OVER (ORDER BY y, v) - 1 AS id FROM (SELECT CAST(embedding AS DOUBLE[]) AS v,
          least(label, 3) AS y FROM embeddings)),
        c AS (SELECT y, count(*) AS n, min(id) AS first, max(count(*)) OVER () AS most FROM e GROUP BY y),
        near AS (SELECT a.id, b.id AS nb, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS k
          FROM e a JOIN e b ON a.y = b.y AND a.id <> b.id QUALIFY k <= 5),
        m AS (SELECT id, max(k) AS k FROM near GROUP BY id), {slots},
        t AS (SELECT s.y, s.id, {draw.format("'42|rank|' || slot")} % m.k + 1 AS k,
          CAST({draw.format("'42|step|' || slot")} AS DOUBLE) / 1152921504606846976.0 AS t FROM s JOIN m USING (id))
        SELECT y, {COLUMNS} FROM e UNION ALL
        SELECT y, {COLUMNS} FROM (SELECT t.y, list_transform(list_zip(a.v, b.v), lambda z: z[1] + t.t * (z[2] - z[1])) AS v
          FROM t JOIN near ON near.id = t.id AND near.k = t.k JOIN e a ON a.id = t.id JOIN e b ON b.id = near.nb)"""


SQL = {
    "p18_neighbour_list": f"""WITH {near(3)} SELECT vec_id AS id, CAST(k AS INTEGER) AS rank, nb AS neighbor, {r('d')} AS distance
        FROM t""",
    "p18_tomek": f"""WITH {near(1)} SELECT CAST(vec_id AS VARCHAR) AS vec_id, y FROM e WHERE vec_id NOT IN (SELECT a.vec_id
        FROM t a JOIN t b ON a.nb = b.vec_id AND b.nb = a.vec_id WHERE a.y <> a.ny AND a.y <> (SELECT c FROM m))""",
    "p19_edited": f"""WITH {near(3)} SELECT CAST(vec_id AS VARCHAR) AS vec_id, y FROM e WHERE y = (SELECT c FROM m) OR vec_id IN
        (SELECT vec_id FROM t GROUP BY 1 HAVING min((y = ny)::INT) = 1)""",
    "p21_synthetic": synthetic_sql(SMOTE_SLOTS),
    "p22_adaptive": synthetic_sql(ADASYN_SLOTS),
}
