"""Degree and PageRank features of the two node columns of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.joins import hot_keys, keyed_join, split_join
from ..functions.values import as_list, col, value
from ..session import materialise
from .base import Operator

# PageRank defaults: damping, largest number of rounds, tolerance per node (fixed values).
DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6


def simple_edges(df: DataFrame, source: str, target: str, directed: bool) -> DataFrame:
    """Distinct (a, b) edges without missing ends; undirected edges have a <= b."""
    a, b = value(df, source), value(df, target)
    pairs = df.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    if not directed:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): both ends count, so a self-loop counts twice."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, directed: bool, rounds: int | None = None) -> DataFrame:
    """(node, pagerank).  ``rounds`` fixes the number of rounds; otherwise it runs to tolerance,
    and raises if that is not reached.

    A round is one join and one partially combined sum.  Links stay in memory as a list per source, dealt out by
    source, so a round only moves the ranks and the sums; ranks become a durable table, so lineage stays flat.
    """
    links = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if not directed:
        links = links.unionByName(edges.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst")))
    links = materialise(links)
    out = links.groupBy("src").agg(F.count("*").alias("links"))
    nodes = links.select(F.col("src").alias("node")).union(links.select(F.col("dst"))).distinct()
    nodes = materialise(nodes.join(out, F.col("node") == F.col("src"), "left").select("node", "links"))
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    hot = hot_keys(links, ["src"])
    if hot is None:
        # No list is longer than the limit of one task.
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        links = links.repartition(parts, "src").groupBy("src").agg(F.collect_list("dst").alias("dsts")).persist()
    try:
        return _rounds(links, hot, nodes.withColumn("p0", F.lit(1.0 / n)), n, nodes.where("links is null").count() / n, rounds)
    finally:
        if hot is None:
            links.unpersist()


def _rounds(links, hot, ranks, n, loose, rounds):
    for _ in range(ROUNDS if rounds is None else rounds):
        base = (1.0 - DAMPING) / n + DAMPING * loose / n
        ranks = materialise(_one_round(links, hot, ranks, base))
        row = ranks.agg(F.sum(F.abs(F.col("p1") - F.col("p0"))).alias("moved"),
                        F.sum(F.when(F.col("links").isNull(), F.col("p1")).otherwise(0.0)).alias("loose")).first()
        loose, ranks = row["loose"], ranks.select("node", "links", F.col("p1").alias("p0"))
        if rounds is None and row["moved"] < n * TOLERANCE:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks have not converged after {ROUNDS} rounds; pass rounds for a fixed number")
    return ranks.select("node", F.col("p0").alias("pagerank"))


def _one_round(links, hot, ranks, base):
    shares = ranks.where("links is not null").select(
        F.col("node").alias("from"), (F.col("p0") / F.col("links")).alias("share"))
    # Inflow is combined before its shuffle; the edges of a hub do not gather in one task.
    if hot is None:
        met = links.join(shares, F.col("src") == F.col("from")).select("share", F.explode("dsts").alias("dst"))
    else:
        met = split_join(links, shares.withColumnRenamed("from", "src"), ["src"], "inner", hot)
    flow = met.groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("inflow"))
    return ranks.join(flow, "node", "left").withColumn(
        "p1", F.lit(base) + F.lit(DAMPING) * F.coalesce("inflow", F.lit(0.0))).drop("inflow")


class ExtractGraphFeature(Operator):
    """Add ``graph_{column}_degree`` and ``graph_{column}_pagerank`` for both ends."""

    cross_row = True

    def __init__(self, source_col="src", target_col="dst", features=None, directed=False, rounds=None):
        super().__init__()
        self.source_col, self.target_col = source_col, target_col
        self.features = as_list(features) or ["degree", "pagerank"]
        self.directed, self.rounds = bool(directed), rounds

    def _apply(self, df):
        if self.source_col not in df.columns or self.target_col not in df.columns:
            return df
        columns, edges = list(df.columns), simple_edges(df, self.source_col, self.target_col, self.directed)
        edges = materialise(edges)
        made = [f for f in ("degree", "pagerank") if f in self.features]
        tables = {"degree": lambda: degrees(edges), "pagerank": lambda: pagerank(edges, self.directed, self.rounds)}
        zeros = {"degree": F.lit(0).cast("bigint"), "pagerank": F.lit(0.0)}
        nodes = None
        for f in made:
            nodes = tables[f]() if nodes is None else nodes.join(tables[f](), "node", "full")
        if nodes is None:
            return df
        nodes = materialise(nodes.withColumnRenamed("node", "__node__"))
        out = df
        for end in (self.source_col, self.target_col):
            held = keyed_join(out.withColumn("__node__", value(out, end)), nodes, ["__node__"], stored=True)
            out = held.select(*[col(n) for n in columns],
                              *[F.coalesce(f, zeros[f]).alias(f"graph_{end}_{f}") for f in made])
            columns += [f"graph_{end}_{f}" for f in made]
        return out
