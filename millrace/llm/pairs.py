"""Links, groups and blocks shared by the two pair operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import settings
from ..functions.joins import measured_bytes
from .common import materialise

# Members of a group that are compared inside one task; larger groups are compared block by block.
BLOCK_ROWS = 1_024


def small_or_shuffled(table: DataFrame) -> DataFrame:
    """The table marked for broadcast if its measured size is below the library's bound, else as it is."""
    size = measured_bytes(table)
    return F.broadcast(table) if size is not None and size <= settings.BROADCAST_BYTES // 4 else table


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the undirected edges (a, b); nodes without edges are absent.

    Labels take the smallest label of a neighbour and then the label of their label, until nothing changes; every
    round is written to the shared folder.  Sums and minima are combined before each shuffle.
    """
    both = materialise(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")) \
            .agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = materialise(step.join(jump, "via", "left").select(
            "node", "old", F.least("via", F.coalesce("far", "via")).alias("component")))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels


def deal_blocks(rows: DataFrame, group: str, size: str, node: str) -> DataFrame:
    """Copy every member of a group to the pairs of blocks its block takes part in: columns _i <= _j, _block.

    ``size`` names the number of members of the row's group.  A group of up to BLOCK_ROWS is one block.
    """
    blocks = F.ceil(F.col(size) / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    dealt = rows.withColumn("_blocks", blocks).withColumn("_block", own) \
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("_i", F.least("_block", "_k")).withColumn("_j", F.greatest("_block", "_k")).drop("_k", "_blocks")


def by_group(rows: DataFrame, keys: list[str], compare: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str,
             parts: int | None = None) -> DataFrame:
    """Call ``compare`` on the rows of each group.

    Rows are dealt by key and sorted within tasks; a task walks through its groups, so millions of small
    groups cost no call of the engine each.
    """
    dealt = rows.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)

    def walk(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            change = np.zeros(len(batch), bool)
            for k in keys:
                v = batch[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            cuts = np.flatnonzero(change)
            if held and any(held[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys):
                yield from compare(pd.concat(held) if len(held) > 1 else held[0])
                held = []
            at = 0
            for cut in cuts:
                part = batch.iloc[at:cut]
                if held:
                    part = pd.concat([*held, part])
                    held = []
                yield from compare(part)
                at = cut
            held.append(batch.iloc[at:])
        if held:
            yield from compare(pd.concat(held) if len(held) > 1 else held[0])

    def joined(batches):
        out, size = [], 0
        for frame in walk(batches):
            out.append(frame)
            size += len(frame)
            if size > 20_000:
                yield pd.concat(out)
                out, size = [], 0
        if out:
            yield pd.concat(out)

    return dealt.mapInPandas(joined, schema)


def spanning_edges(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Numbers of pairs (a[i], b[i]) that connect all that the pairs connect; at most n - 1."""
    root = np.arange(n)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return np.asarray(keep, np.int64)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning pairs of a symmetric boolean matrix by breadth-first search over its rows."""
    n = len(linked)
    seen, left, right = np.zeros(n, bool), [], []
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(linked[x] & ~seen)
            seen[new] = True
            left += [x] * len(new)
            right += new.tolist()
            queue += new.tolist()
    return np.asarray(left, np.int64), np.asarray(right, np.int64)
