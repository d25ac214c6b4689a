"""Exact k-nearest-neighbour join for Euclidean distance.

Equal vectors are searched once.  Donors are dealt to the leaves of a tree of reference points.  A query first meets
the donors of its own leaf, which gives it a distance that its neighbours cannot exceed; then it goes down the tree and
meets only the leaves that cut the ball of that distance.  Leaves are gathered into pools of bounded size: a query
travels once per pool with the list of leaves it meets there, and a task streams queries past the pool's donors.  Matrix
products with an error bound leave few pairs, whose distances are then summed exactly; a task returns only the k best
per query.
"""

from __future__ import annotations

import math
from typing import Iterator  # noqa: UP035  (the form Spark's inference reads)

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import settings
from ..session import materialise

PAIR_SCHEMA = "qid bigint, did bigint, distance double"


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed dimension by dimension so equal inputs tie exactly."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d][:, None] - b[:, d][None, :]) ** 2
    return out


def nearest(queries: DataFrame, donors: DataFrame, k: int, same_table: bool,
            block_rows: int | None = None) -> DataFrame:
    """The ``k`` donors closest to each query: (id, rank, neighbor, distance).

    Both inputs have ``id bigint`` and ``vec array<double>``.  Ties go to the lower
    id.  With ``same_table`` a row is not its own neighbour.
    """
    block = settings.NEIGHBOR_BLOCK_ROWS if block_rows is None else block_rows
    depth = k + 1 if same_table else k
    # A vector's neighbours among equal donors are the lowest ids: depth of them suffice.
    copies = Window.partitionBy("vec").orderBy("id")
    kept = donors.withColumn("__copy__", F.row_number().over(copies)).where(F.col("__copy__") <= depth)
    unique_donors = materialise(kept.groupBy("vec").agg(
        F.min("id").alias("did"), F.sort_array(F.collect_list("id")).alias("ids")))
    unique_queries = unique_donors.select("vec", F.col("did").alias("qid")) if queries is donors else \
        materialise(queries.groupBy("vec").agg(F.min("id").alias("qid")))
    if unique_donors.isEmpty() or unique_queries.isEmpty():
        return queries.sparkSession.createDataFrame([], "id bigint, rank int, neighbor bigint, distance double")
    pairs = closest_pairs(unique_queries, unique_donors.select("did", "vec"), depth, block)
    ids = unique_donors.select("did", F.explode("ids").alias("neighbor"))
    ranked = pairs.join(ids, "did")
    best = Window.partitionBy("qid").orderBy("distance", "neighbor")
    ranked = ranked.withColumn("__r__", F.row_number().over(best)).where(F.col("__r__") <= depth)
    # At most ``depth`` candidates per distinct query vector.
    lists = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor"))).alias("found"))
    per_vector = unique_queries.join(lists, "qid").select("vec", "found")
    joined = queries.select("id", "vec").join(per_vector, "vec")
    found = F.filter("found", lambda x: x["neighbor"] != F.col("id")) if same_table else F.col("found")
    return joined.select("id", F.posexplode(F.slice(found, 1, k)).alias("rank", "e")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("e.neighbor").alias("neighbor"),
        F.col("e.distance").alias("distance"))


def closest_pairs(queries: DataFrame, donors: DataFrame, depth: int, block: int) -> DataFrame:
    """Candidates (qid, did, distance) that hold the ``depth`` closest donors (did, vec) of every query (qid, vec)."""
    tree, placed = PivotTree.grow(donors, block)
    if tree.leaves == 1:
        return compare_leaves(queries.withColumn("leaf", F.lit(0).cast("bigint")).withColumn("bound", F.lit(math.inf)),
                              placed, depth, block)
    located = materialise(tree.locate(queries, "qid"))
    pools = Pools(placed, block)
    own = materialise(compare_leaves(located.withColumn("bound", F.lit(math.inf)), placed, depth, block, pools))
    # The farthest of ``depth`` donors met so far; a leaf with fewer gives no bound yet.
    bounds = own.groupBy("qid").agg(F.count("*").alias("met"), F.max("distance").alias("far")).where(F.col("met") >= depth)
    bounded = located.join(bounds.select("qid", F.col("far").alias("bound")), "qid", "left") \
        .select("qid", "vec", "leaf", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    further = compare_pools(materialise(tree.visits(bounded, depth, pools)), placed, pools, depth, block)
    return own.unionByName(further)


class Pools:
    """Which pool holds each leaf: leaves of about ``settings.NEIGHBOR_POOL_BYTES`` together; a larger leaf has several pools.

    Leaves are a bounded table; neighbouring numbers are children of one node, so a pool holds leaves that lie together.
    """

    def __init__(self, placed: DataFrame, block: int):
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).collect()
        width = max((r["width"] for r in sizes), default=1)
        self.rows = max(block, settings.NEIGHBOR_POOL_BYTES // (8 * max(width, 1)))
        self.first: dict[int, int] = {}
        self.parts: dict[int, int] = {}
        pool, held = 0, 0
        for leaf, n in sorted((r["leaf"], r["n"]) for r in sizes):
            if held and held + n > self.rows:
                pool, held = pool + 1, 0
            self.first[leaf], self.parts[leaf] = pool, math.ceil(n / self.rows)
            pool, held = pool + self.parts[leaf] - 1, held + n
            if self.parts[leaf] > 1:
                pool, held = pool + 1, 0

    def table(self, rows: DataFrame) -> DataFrame:
        return rows.sparkSession.createDataFrame(
            [(leaf, pool, self.parts[leaf]) for leaf, pool in self.first.items()], "leaf bigint, first int, parts int")


class PivotTree:
    """Reference points in levels: a cell of too many donors is cut by the nearest of up to FAN of its own donors.

    The points, radii and counts are a bounded table that tasks carry: the tree grows until every leaf fits a block or
    the points reach ``settings.NEIGHBOR_TREE_BYTES``.  Larger leaves are compared in several blocks.
    """

    def __init__(self):
        # node -> (children, their points, radii and numbers of donors); the root is 0.
        self.children: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.leaves = 1

    @classmethod
    def grow(cls, donors: DataFrame, block: int) -> tuple[PivotTree, DataFrame]:
        """The tree of the donors, and the donors with their leaf."""
        tree, fan = cls(), settings.NEIGHBOR_FAN
        placed = donors.withColumn("leaf", F.lit(0).cast("bigint"))
        full, held, made = ([0] if placed.count() > block else []), 0, 1
        while full:
            rank = Window.partitionBy("leaf").orderBy(F.xxhash64("vec"), "did")
            inside = placed.where(F.col("leaf").isin(full)) if len(full) <= fan else placed.join(F.broadcast(
                placed.sparkSession.createDataFrame([(n,) for n in full], "leaf bigint")), "leaf")
            picked = inside.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= fan).select("leaf", "vec").collect()
            points: dict[int, list] = {}
            for r in picked:
                points.setdefault(r["leaf"], []).append(r["vec"])
            for node, vectors in points.items():
                ids = np.arange(made, made + len(vectors))
                tree.children[node] = ids, np.array(vectors, float), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
                made += len(ids)
                held += tree.children[node][1].nbytes
            placed = materialise(tree._descend(placed, "did", set(points)))
            # One row per node of this level.
            rows = {r["leaf"]: r for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("reach").alias("far")).collect()}
            full = []
            for node in points:
                ids, _, radii, sizes = tree.children[node]
                for i, child in enumerate(ids.tolist()):
                    if child in rows:
                        radii[i], sizes[i] = rows[child]["far"], rows[child]["n"]
                        if rows[child]["n"] > block:
                            full.append(child)
            width = len(picked[0]["vec"]) * 8
            if held + len(full) * fan * width > settings.NEIGHBOR_TREE_BYTES:
                break
            placed = placed.drop("reach")
        tree.leaves = made - len(tree.children)
        return tree, placed.select("did", "vec", "leaf")

    def _descend(self, rows: DataFrame, key: str, through: set[int] | None = None) -> DataFrame:
        """Move rows from their ``leaf`` to the nearest child, as long as it has children (of the nodes in ``through``)."""
        children = self.children if through is None else {n: self.children[n] for n in through}

        def move(batches):
            for batch in batches:
                if not len(batch):
                    continue
                at, vec, reach = batch["leaf"].to_numpy(np.int64).copy(), np.stack(batch["vec"].to_numpy()).astype(float), np.zeros(len(batch))
                waiting = np.arange(len(batch))
                while len(waiting):
                    inner = np.array([n in children for n in at[waiting].tolist()], bool)
                    waiting = waiting[inner]
                    for node in np.unique(at[waiting]).tolist():
                        mine = waiting[at[waiting] == node]
                        ids, points, _, _ = children[node]
                        d = squared_distances(vec[mine], points)
                        best = d.argmin(axis=1)
                        at[mine], reach[mine] = ids[best], np.sqrt(d[np.arange(len(mine)), best])
                    if through is not None:
                        break
                yield pd.DataFrame({key: batch[key], "vec": batch["vec"], "leaf": at, "reach": reach})

        return rows.select(key, "vec", "leaf").mapInPandas(move, f"{key} bigint, vec array<double>, leaf bigint, reach double")

    def locate(self, queries: DataFrame, key: str) -> DataFrame:
        """(key, vec, leaf): the leaf whose points are nearest on the way down."""
        return self._descend(queries.withColumn("leaf", F.lit(0).cast("bigint")), key).drop("reach")

    def visits(self, queries: DataFrame, depth: int, pools: Pools | None = None) -> DataFrame:
        """(qid, vec, leaf, bound) for every further leaf that may hold a donor within a query's ``bound``.

        ``leaf`` names the leaf already met.  Where it gave no bound, counts and radii of the nodes on the way give one.
        With ``pools`` a row per pool: (qid, vec, pool, leaves, bound).
        """
        schema = "qid bigint, vec array<double>, leaf bigint, bound double" if pools is None else \
            "qid bigint, vec array<double>, pool int, leaves array<bigint>, bound double"

        def go(batches):
            for batch in batches:
                # Few queries at once: each may meet every leaf.
                for start in range(0, len(batch), VISIT_ROWS):
                    few = batch.iloc[start:start + VISIT_ROWS]
                    row, leaf, bound = self._reached(few, depth)
                    if pools is None:
                        at, out = row, {"leaf": leaf}
                    else:
                        at, out = _by_pool(row, leaf, pools)
                    out = pd.DataFrame({"qid": few["qid"].to_numpy()[at], "row": at, **out, "bound": bound[at]})
                    vectors = few["vec"].to_numpy()
                    for first in range(0, len(out), VISIT_ROWS):
                        part = out.iloc[first:first + VISIT_ROWS]
                        yield part.assign(vec=vectors[part["row"].to_numpy()]).drop(columns="row")

        return queries.mapInPandas(go, schema).select(*[c.split()[0] for c in schema.split(", ")])

    def _reached(self, batch: pd.DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, leaves, bound): pairs of a row of the batch and a leaf to meet, and the bound of every row."""
        children = self.children
        vec, own = np.stack(batch["vec"].to_numpy()).astype(float), batch["leaf"].to_numpy(np.int64)
        bound = batch["bound"].to_numpy(float).copy()
        found_row, found_leaf = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        level = {0: np.arange(len(batch))}
        while level:
            below: dict[int, list[np.ndarray]] = {}
            for node, rows in level.items():
                ids, points, radii, sizes = children[node]
                held = sizes > 0
                ids, points, radii, sizes = ids[held], points[held], radii[held], sizes[held]
                d = np.sqrt(squared_distances(vec[rows], points))
                order = np.argsort(d + radii, axis=1)
                reached = np.cumsum(sizes[order], axis=1) >= depth
                first = reached.argmax(axis=1)
                far = np.take_along_axis(d + radii, order, axis=1)[np.arange(len(rows)), first]
                far[~reached.any(axis=1)] = np.inf
                bound[rows] = np.minimum(bound[rows], far * (1 + 1e-9))
                slack = 1e-9 * (1.0 + d + radii)
                near = d - radii - slack <= bound[rows][:, None]
                for i, child in enumerate(ids.tolist()):
                    mine = rows[near[:, i]]
                    if child in children:
                        below.setdefault(child, []).append(mine)
                    else:
                        mine = mine[own[mine] != child]
                        found_row.append(mine)
                        found_leaf.append(np.full(len(mine), child))
            level = {n: np.concatenate(v) for n, v in below.items() if sum(map(len, v))}
        return np.concatenate(found_row), np.concatenate(found_leaf), bound


# Queries that look for their leaves, and rows handed on, at once.
VISIT_ROWS = 1_024


def _by_pool(row: np.ndarray, leaf: np.ndarray, pools: Pools) -> tuple[np.ndarray, dict]:
    """(rows, {pool, leaves}): one entry for each pool that a row meets."""
    if not len(row):
        return row, {"pool": row.astype(np.int32), "leaves": np.empty(0, object)}
    parts = np.array([pools.parts[n] for n in leaf.tolist()], np.int64)
    first = np.array([pools.first[n] for n in leaf.tolist()], np.int64)
    pool = np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    row, leaf = np.repeat(row, parts), np.repeat(leaf, parts)
    order = np.lexsort((leaf, pool, row))
    row, leaf, pool = row[order], leaf[order], pool[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(pool) != 0)])
    lists = np.empty(len(starts), object)
    lists[:] = np.split(leaf, starts[1:])
    return row[starts], {"pool": pool[starts].astype(np.int32), "leaves": lists}


def deal_leaves(queries: DataFrame, placed: DataFrame, block: int) -> DataFrame:
    """Rows of both tables for every (leaf, qb, db) they take part in: columns bound (null for donors), key, vec."""
    # Both tables have a row per leaf of the tree, whose size is bounded.
    q_sizes = queries.groupBy("leaf").agg(F.count("*").alias("nq"))
    d_sizes = placed.groupBy("leaf").agg(F.count("*").alias("nd"))
    some = max(1, block // 8)
    splits = F.broadcast(q_sizes.join(F.broadcast(d_sizes), "leaf").select(
        "leaf", F.ceil(F.col("nq") / some).cast("int").alias("q_blocks"), F.ceil(F.col("nd") / block).cast("int").alias("d_blocks")))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    q = queries.join(splits, "leaf").select(
        "leaf", F.pmod(F.xxhash64("qid"), "q_blocks").cast("int").alias("qb"), every("d_blocks").alias("db"),
        F.col("bound"), F.col("qid").alias("key"), "vec")
    d = placed.join(splits, "leaf").select(
        "leaf", every("q_blocks").alias("qb"), F.pmod(F.xxhash64("did"), "d_blocks").cast("int").alias("db"),
        F.lit(None).cast("double").alias("bound"), F.col("did").alias("key"), "vec")
    return q.unionByName(d)


def compare_leaves(queries: DataFrame, placed: DataFrame, depth: int, block: int, pools: Pools | None = None) -> DataFrame:
    """The ``depth`` closest donors within ``bound`` of every query, for each of its leaves (qid, vec, leaf, bound)."""
    pools = Pools(placed, block) if pools is None else pools
    met = queries.join(F.broadcast(pools.table(queries)), "leaf")
    return compare_pools(met.select("qid", "vec", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("pool"),
                                    F.array("leaf").alias("leaves"), "bound"), placed, pools, depth, block)


def compare_pools(queries: DataFrame, placed: DataFrame, pools: Pools, depth: int, block: int) -> DataFrame:
    """As above, for queries (qid, vec, pool, leaves, bound) that name the leaves they meet in a pool.

    A task holds one pool's donors and streams at most about as many queries past them.
    """
    # One row per pool.
    loads = {r["pool"]: math.ceil(r["n"] / pools.rows) for r in queries.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    few = F.broadcast(queries.sparkSession.createDataFrame(list(loads.items()), "pool int, splits int"))
    asked = queries.join(few, "pool").select(
        "pool", F.pmod(F.xxhash64("qid"), "splits").cast("int").alias("part"), F.lit(1).alias("asks"), F.col("qid").alias("key"),
        "vec", "leaves", "bound")
    at = placed.join(F.broadcast(pools.table(placed)), "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("did"), "parts")).cast("int").alias("pool"), "did", "vec", "leaf")
    donors = at.join(few, "pool").select(
        "pool", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("part"), F.lit(0).alias("asks"), F.col("did").alias("key"),
        "vec", F.array("leaf").alias("leaves"), F.lit(None).cast("double").alias("bound"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, pool = [], None
        for batch in batches:
            asks = batch["asks"].to_numpy() == 1
            if not asks.all():
                mine = batch[~asks]
                held.append((mine["key"].to_numpy(), np.stack(mine["vec"].to_numpy()).astype(float),
                             np.array([x[0] for x in mine["leaves"]], np.int64)))
            if not asks.any() or not held:
                continue
            if pool is None:
                pool = _Pool(held, block)
            mine = batch[asks]
            for start in range(0, len(mine), ASKED_ROWS):
                yield pool.closest(mine.iloc[start:start + ASKED_ROWS], depth)

    tasks = max(1, min(4 * sum(loads.values()), 8_192))
    dealt = asked.unionByName(donors).repartition(tasks, "pool", "part").sortWithinPartitions("pool", "part", "asks")
    return dealt.groupBy("pool", "part").applyInPandas(run, PAIR_SCHEMA)


# Queries compared with a block of donors by one matrix product.
ASKED_ROWS = 512


class _Pool:
    """Donors of one pool by leaf, in blocks of bounded size, moved to the block's middle."""

    def __init__(self, held: list, block: int):
        keys, vectors, leaves = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((keys, leaves))
        keys, vectors, leaves = keys[order], vectors[order], leaves[order]
        self.blocks: dict[int, list[tuple[np.ndarray, ...]]] = {}
        starts = np.flatnonzero(np.r_[True, np.diff(leaves) != 0]).tolist()
        for a, b in zip(starts, [*starts[1:], len(leaves)], strict=True):
            for first in range(a, b, block):
                part = vectors[first:min(first + block, b)]
                with np.errstate(all="ignore"):
                    middle = part.mean(axis=0)
                    moved = part - middle
                    square = (moved ** 2).sum(axis=1)
                    side = np.hstack([-2.0 * moved, square[:, None], np.ones((len(part), 1))]).T.copy()
                self.blocks.setdefault(int(leaves[a]), []).append((keys[first:first + len(part)], part, middle, side, square.max()))

    def closest(self, asked: pd.DataFrame, depth: int) -> pd.DataFrame:
        """The ``depth`` closest donors of each query within its bound, ties to the lower key."""
        vec = np.stack(asked["vec"].to_numpy()).astype(float)
        limit = (asked["bound"].to_numpy(float) * (1 + 1e-9)) ** 2
        best = np.full((len(asked), depth), np.inf)
        lists = asked["leaves"].to_numpy()
        row = np.repeat(np.arange(len(asked)), [len(x) for x in lists])
        leaf = np.concatenate(lists)
        order = np.argsort(leaf, kind="stable")
        row, leaf = row[order], leaf[order]
        starts = np.flatnonzero(np.r_[True, np.diff(leaf) != 0]).tolist()
        found = []
        for a, b in zip(starts, [*starts[1:], len(leaf)], strict=True):
            rows = row[a:b]
            for keys, donors, middle, side, largest in self.blocks.get(int(leaf[a]), ()):
                r, c = _candidates(vec[rows], middle, side, largest, limit[rows], depth)
                if not len(r):
                    continue
                r = rows[r]
                exact = _pair_squares(vec, donors, r, c)
                # The nearest ``depth`` of this block, merged into the nearest met so far.
                order = np.lexsort((keys[c], exact, r))
                r, c, exact = r[order], c[order], exact[order]
                fresh = np.flatnonzero(np.r_[True, np.diff(r) != 0])
                place = np.arange(len(r)) - np.repeat(fresh, np.diff(np.r_[fresh, len(r)]))
                keep = place < depth
                r, c, exact, place = r[keep], c[keep], exact[keep], place[keep]
                new = np.full_like(best, np.inf)
                new[r, place] = exact
                best = np.sort(np.hstack([best, new]), axis=1)[:, :depth]
                limit = np.minimum(limit, best[:, -1] * (1 + 1e-9))
                found.append((r, keys[c], exact))
        if not found:
            return pd.DataFrame({"qid": np.empty(0, np.int64), "did": np.empty(0, np.int64), "distance": np.empty(0)})
        r, key, exact = (np.concatenate([f[i] for f in found]) for i in range(3))
        distance = np.sqrt(exact)
        order = np.lexsort((key, distance, r))
        r, key, distance, exact = r[order], key[order], distance[order], exact[order]
        fresh = np.flatnonzero(np.r_[True, np.diff(r) != 0])
        place = np.arange(len(r)) - np.repeat(fresh, np.diff(np.r_[fresh, len(r)]))
        keep = (place < depth) & (exact <= limit[r])
        return pd.DataFrame({"qid": asked["key"].to_numpy()[r[keep]], "did": key[keep], "distance": distance[keep]})


def _candidates(vec: np.ndarray, middle: np.ndarray, side: np.ndarray, largest: float, limit: np.ndarray,
                depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, donor) that may be among the ``depth`` closest within the ``limit`` on squared distances.

    One matrix product gives all squared distances; its rounding error is bounded by the lengths, and the limit is
    loosened by it.  What overflows is kept for the exact sum.
    """
    with np.errstate(all="ignore"):
        moved = vec - middle
        square = (moved ** 2).sum(axis=1)
        near = np.hstack([moved, np.ones((len(vec), 1)), square[:, None]]) @ side
        error = 8.0 * (len(middle) + 8) * np.finfo(float).eps * (square + largest)
        if near.shape[1] > depth and not np.isfinite(limit).all():
            limit = np.minimum(limit, np.partition(near, depth - 1, axis=1)[:, depth - 1] * (1 + 1e-9) + error)
        return np.nonzero(~(near > (limit + error)[:, None]))


def _pair_squares(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 65_536) -> np.ndarray:
    """Squared distances of pairs, summed dimension by dimension as in :func:`squared_distances`."""
    out = np.zeros(len(i))
    for start in range(0, len(i), at_once):
        part = slice(start, start + at_once)
        gaps = ((a[i[part]] - b[j[part]]) ** 2).T.copy()
        for d in gaps:
            out[part] += d
    return out
