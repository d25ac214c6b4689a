"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ordering import row_index
from .common import WORD, col, materialise

# The draw of a document has 60 bits and is read in 12-bit digits, so a histogram has 4,096 bins a source.
DIGIT, DIGITS = 12, 5
DECISIONS = ("size", "source_size", "target", "taken", "copies")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str]) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    draw = F.concat_ws("|", F.coalesce(col(id_col).cast("string"), F.lit("")), text)
    return docs.select(*[col(c) for c in carry if c not in DECISIONS],
                       col(source_col).alias("_source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"),
                       F.conv(F.substring(F.md5(draw), 1, 15), 16, 10).cast("long").alias("_draw"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets of the table (_source, _total): shares of the grand total by weight, at most ``cap`` totals each.

    Sources count by code point, null last; their weights repeat.  What the cap cuts off is shared among
    the others by weight until none is above.  Each round is one aggregation over one row per source.
    """
    ranked = row_index(sizes.select("_source", "_total"), ["_source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]),
                          (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = ranked.select("_source", "_total", weight.alias("_weight"))
    total = ranked.agg(F.sum("_total"), F.sum("_weight")).first()
    if not total[0]:
        return ranked.select("_source", "_total", F.lit(0.0).alias("_target"))
    level, full_before = total[0] / total[1], -1
    while True:
        full = F.col("_total") * cap <= F.lit(level) * F.col("_weight")
        row = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("_total") * cap)), F.lit(0)).alias("used"),
                         F.sum(F.when(~full, F.col("_weight"))).alias("weight"),
                         F.count(F.when(full, 1)).alias("full")).first()
        if row["full"] == full_before or row["weight"] is None:
            break
        full_before, level = row["full"], (total[0] - row["used"]) / row["weight"]
    return ranked.select("_source", "_total", F.least(
        (F.col("_total") * cap).cast("double"), F.lit(level) * F.col("_weight")).alias("_target"))


def _cutoffs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(_source, _total, _target, _rounds, _cutoff): draws below the cut-off are taken once more than the others.

    Level by level, tokens are summed by source and digit of the draw; the digit in which the budget runs
    out is refined by its next digit, the rest of the table is not looked at again.  Budgets are nested:
    a larger one takes all that a smaller one takes.
    """
    rounds = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0)).cast("long")
    state = materialise(targets.select(
        "_source", "_total", "_target", rounds.alias("_rounds"),
        (F.col("_target") - rounds * F.col("_total")).alias("_rest"),
        F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"),
        F.lit(None).cast("long").alias("_cutoff")))
    decided = state.where((F.col("_rest") <= 0) | (F.col("_total") == 0)).withColumn("_cutoff", F.lit(0).cast("long"))
    open_ = state.where((F.col("_rest") > 0) & (F.col("_total") > 0))
    names = state.columns
    for level in range(DIGITS):
        done, left = DIGIT * level, DIGIT * (DIGITS - level - 1)
        inside = rows.join(open_.withColumnRenamed("_source", "_s"),
                           F.col("_source").eqNullSafe(F.col("_s")) &
                           (F.shiftright("_draw", DIGIT * DIGITS - done) == F.col("_prefix")))
        keep = [n for n in names if n not in ("_source", "_cutoff")]
        bins = inside.groupBy("_source", *keep, F.shiftright("_draw", left).alias("_bin")).agg(
            F.sum("_size").alias("_tokens"), F.min("_draw").alias("_low"), F.max("_draw").alias("_high"))
        # At most 4,096 bins a source.
        window = Window.partitionBy("_source").orderBy("_bin")
        run = bins.withColumn("_to", F.col("_before") + F.sum("_tokens").over(window)) \
            .withColumn("_last", F.lead("_bin").over(window).isNull())
        edge = run.where((F.col("_to") > F.col("_rest")) & (F.col("_to") - F.col("_tokens") <= F.col("_rest"))
                         | (F.col("_last") & (F.col("_to") <= F.col("_rest"))))
        from_ = F.col("_to") - F.col("_tokens")
        single = F.col("_low") == F.col("_high")
        # One draw cannot be divided; it is taken if that comes nearer to the budget.
        cut = F.when(F.col("_to") <= F.col("_rest"), F.col("_high") + 1) \
            .when(single & (F.col("_rest") - from_ >= F.col("_tokens") / 2), F.col("_high") + 1) \
            .when(single, F.col("_low"))
        step = materialise(edge.select(
            "_source", "_total", "_target", "_rounds", "_rest", F.col("_bin").alias("_prefix"),
            from_.alias("_before"), cut.alias("_cutoff")))
        decided = decided.unionByName(step.where(F.col("_cutoff").isNotNull()))
        open_ = step.where(F.col("_cutoff").isNull())
        if open_.isEmpty():
            break
    return materialise(decided.select("_source", "_total", "_target", "_rounds", "_cutoff"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Decide how often each document enters a mix in which the sources meet target weights.

    Returns the ``carry`` columns (default: all) with size (words), source_size, target, taken (words taken, repeats
    counted: 0 to ``cap`` times the size) and copies (how often the document is taken).  Whole documents are taken, so a source's sum differs
    from its target by at most half of the document at the boundary.

    Null and empty texts have size 0 and taken 0.  A null source is a source of its own, ranked last.  Rows that
    equal each other in id and text have one draw and are taken alike.  Input columns named like a
    result column are replaced.  An empty table gives an empty table.
    """
    carry = docs.columns if carry is None else carry
    measured = _measured(docs, id_col, text_col, source_col, carry)
    narrow = len(carry) <= 1
    if narrow:
        measured = materialise(measured)
    rows = measured if narrow else materialise(measured.select("_source", "_size", "_draw"))
    sizes = materialise(rows.groupBy("_source").agg(F.sum("_size").alias("_total")))
    plan = _cutoffs(rows, source_targets(sizes, weights, cap)).withColumnRenamed("_source", "_s")
    out = measured.join(plan, F.col("_source").eqNullSafe(F.col("_s")), "left")
    times = F.col("_rounds") + (F.col("_draw") < F.col("_cutoff")).cast("long")
    return out.select(*[col(c) for c in carry if c not in DECISIONS], F.col("_size").alias("size"),
                      F.col("_total").alias("source_size"), F.col("_target").alias("target"),
                      (times * F.col("_size")).alias("taken"), times.alias("copies"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source,
         CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'x', 'g'),
              '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source),
r AS (SELECT source, total, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM s),
g AS (SELECT CAST(sum(total) AS BIGINT) AS t, CAST(sum(weight) AS BIGINT) AS w FROM r),
lv AS (
  SELECT 0 AS step, CAST(t AS DOUBLE) / w AS level, -1 AS n FROM g
  UNION ALL
  SELECT step + 1, CAST((SELECT t FROM g) - (SELECT coalesce(sum(total * 3), 0) FROM r WHERE total * 3 <= level * weight) AS DOUBLE)
         / (SELECT sum(weight) FROM r WHERE total * 3 > level * weight),
         (SELECT count(*) FROM r WHERE total * 3 <= level * weight)
  FROM lv WHERE n <> (SELECT count(*) FROM r WHERE total * 3 <= level * weight)
    AND EXISTS (SELECT 1 FROM r WHERE total * 3 > level * weight)),
lam AS (SELECT level FROM lv ORDER BY step DESC LIMIT 1),
t AS (SELECT source, total, least(CAST(total * 3 AS DOUBLE), level * weight) AS target FROM r, lam),
c AS (SELECT source, total, target, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS rounds FROM t),
w AS (
  SELECT doc_id, size, total, target, rounds, target - rounds * total AS rest, draw,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, draw) AS own
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, total AS source_size, target,
       CAST((rounds + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND rest - (upto - own) >= own / 2.0)) THEN 1 ELSE 0 END)
            * size AS BIGINT) AS taken
FROM w
"""
