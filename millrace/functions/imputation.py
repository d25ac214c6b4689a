"""Filling gaps from similar rows, or by regressing each column on the others."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .. import settings
from ..session import materialise
from .joins import keyed_join
from .moments import cross_products
from .neighbors import PivotTree, deal_leaves
from .values import col, number


def knn_fill(df: DataFrame, donors: DataFrame, names: list[str], k: int,
             block_rows: int | None = None) -> DataFrame:
    """Fill gaps with the mean of the ``k`` closest donors that know the column.

    Distance counts the columns both rows know, scaled up to all columns; ties go to the lower value.  Rows without
    gaps only pass through.  Equal rows with gaps are solved once.
    """
    block = settings.NEIGHBOR_BLOCK_ROWS if block_rows is None else block_rows
    held = df.withColumns({f"__v{i}__": number(df, n) for i, n in enumerate(names)})
    values = [F.col(f"__v{i}__") for i in range(len(names))]
    # A row's key: which columns it lacks, and its values with 0 there.
    held = held.withColumn("__gaps__", F.array(*[v.isNull() for v in values])) \
        .withColumn("__known__", F.array(*[F.coalesce(v, F.lit(0.0)) for v in values]))
    gappy = held.where(F.exists("__gaps__", lambda x: x))
    queries = materialise(gappy.select("__gaps__", "__known__").distinct().withColumn("qid", F.monotonically_increasing_id()))
    vector = F.zip_with("__gaps__", "__known__", lambda gap, v: F.when(~gap, v))
    # More than k equal donors never matter.
    copies = Window.partitionBy("vec").orderBy(F.lit(0))
    pool = donors.select(F.array(*[col(n) for n in names]).alias("vec")).where(F.exists("vec", lambda x: x.isNotNull()))
    pool = materialise(pool.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k)
                       .select(F.monotonically_increasing_id().alias("did"), "vec"))
    means = donors.agg(*[F.avg(col(n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    if queries.isEmpty() or pool.isEmpty():
        joined = held.withColumn("fills", F.lit(None).cast("map<int,double>"))
    else:
        best = gap_neighbours(queries.select("qid", vector.alias("vec")), pool, [means[f"m{i}"] or 0.0 for i in range(len(names))], k, block)
        order = Window.partitionBy("qid", "gap").orderBy("distance", "known")
        fills = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k) \
            .groupBy("qid", "gap").agg(F.avg("known").alias("fill"))
        # At most one entry per column of one row.
        solved = queries.join(fills.groupBy("qid").agg(
            F.map_from_entries(F.collect_list(F.struct("gap", "fill"))).alias("fills")), "qid").drop("qid")
        joined = held.where(~F.exists("__gaps__", lambda x: x)).withColumn("fills", F.lit(None).cast("map<int,double>")) \
            .unionByName(keyed_join(gappy, solved, ["__gaps__", "__known__"]))
    filled = {n: F.coalesce(values[i], F.try_element_at("fills", F.lit(i)), F.lit(means[f"m{i}"])) for i, n in enumerate(names)}
    return joined.select(*[filled[n].alias(n) if n in filled else col(n) for n in df.columns])


GAP_SCHEMA = "qid bigint, gap int, distance double, known double"
# Numbers held at once while blocks are sifted for some queries.
SIFT_AT_ONCE = 4_000_000


def gap_neighbours(queries: DataFrame, pool: DataFrame, means: list[float], k: int, block: int) -> DataFrame:
    """Rows (qid, gap, distance, known) that hold the ``k`` closest donors of every gap of every query.

    Donors are dealt to blocks of like rows (by a pivot tree over their values, gaps taken as means).  A query meets
    its own block first, which gives it a distance for every gap; the least distance to the box of another block, over the
    columns that query and donors share, decides whether that block is met at all.
    """
    filled = F.transform("vec", lambda x, i: F.coalesce(x, F.element_at(F.array(*[F.lit(float(m)) for m in means]), i + 1)))
    tree, leaves = PivotTree.grow(pool.select("did", filled.alias("vec")), block)
    if tree.leaves == 1:
        one = F.lit(0).cast("bigint")
        return _compare_gaps(queries.withColumn("leaf", one), pool.withColumn("leaf", one), k, block)
    placed = materialise(pool.join(leaves.select("did", "leaf"), "did"))
    own = tree.locate(queries.select("qid", filled.alias("vec")), "qid").select("qid", "leaf")
    located = materialise(queries.join(own, "qid"))
    first = materialise(_compare_gaps(located, placed, k, block))
    reached = first.groupBy("qid", "gap").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where(F.col("n") >= k) \
        .groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("gap", "far"))).alias("reached"))
    blocks = DonorBlocks.of(placed, len(means))
    further = materialise(blocks.sift(located.join(reached, "qid", "left"), k))
    return first.unionByName(_compare_gaps(further, placed, k, block))


def _compare_gaps(queries: DataFrame, placed: DataFrame, k: int, block: int) -> DataFrame:
    dealt = deal_leaves(queries.withColumn("bound", F.lit(0.0)), placed, block)
    return dealt.groupBy("leaf", "qb", "db").applyInPandas(_gap_kernel(k), GAP_SCHEMA)


class DonorBlocks:
    """Box, gap patterns and known values per column of every block of donors: a row per leaf of a bounded tree."""

    PATTERNS = 256

    def __init__(self, leaves, low, high, patterns, holds, known):
        self.leaves, self.low, self.high, self.known = leaves, low, high, known
        #: Which columns each pattern knows; which patterns each block holds (None where there are too many of them).
        self.patterns, self.holds = patterns, holds

    @classmethod
    def of(cls, placed: DataFrame, width: int) -> DonorBlocks:
        at = [F.element_at("vec", i + 1) for i in range(width)]
        rows = placed.groupBy("leaf").agg(
            *[F.min(v).alias(f"l{i}") for i, v in enumerate(at)], *[F.max(v).alias(f"h{i}") for i, v in enumerate(at)],
            *[F.count(v).alias(f"n{i}") for i, v in enumerate(at)]).collect()
        leaves = np.array([r["leaf"] for r in rows], np.int64)
        low, high = (np.array([[np.nan if r[f"{c}{i}"] is None else r[f"{c}{i}"] for i in range(width)] for r in rows], float)
                     for c in "lh")
        known = np.array([[r[f"n{i}"] for i in range(width)] for r in rows], np.int64)
        pattern = F.transform("vec", lambda x: x.isNotNull()).alias("pattern")
        kinds = placed.select(pattern).distinct().limit(cls.PATTERNS + 1).collect()
        if len(kinds) > cls.PATTERNS:
            return cls(leaves, low, high, None, None, known)
        number_of = {tuple(r["pattern"]): i for i, r in enumerate(kinds)}
        row_of = {leaf: i for i, leaf in enumerate(leaves.tolist())}
        holds = np.zeros((len(leaves), len(kinds)), bool)
        for r in placed.select("leaf", pattern).distinct().collect():
            holds[row_of[r["leaf"]], number_of[tuple(r["pattern"])]] = True
        return cls(leaves, low, high, np.array(list(number_of), bool).reshape(-1, width), holds, known)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of each query to any donor of each block (columns both know, scaled up)."""
        width = q.shape[1]
        with np.errstate(invalid="ignore"):
            below = np.nan_to_num(np.maximum(0.0, np.maximum(self.low - q[:, None], q[:, None] - self.high))) ** 2
            above = np.nan_to_num(np.maximum(np.abs(q[:, None] - self.low), np.abs(self.high - q[:, None]))) ** 2
        has = ~np.isnan(q)
        if self.patterns is None:
            # Any mean of squares is at least the smallest; a donor may share any of the columns.
            shared = has[:, None] & (self.known > 0)
            least = np.where(shared, below, np.inf).min(axis=2)
            return np.sqrt(width * least), np.full(least.shape, np.inf)
        least, most = np.full(below.shape[:2], np.inf), np.zeros(below.shape[:2])
        for p, knows in enumerate(self.patterns):
            both = has & knows
            n = both.sum(axis=1)[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.where(n > 0, (below * both[:, None]).sum(axis=2) * width / n, np.inf)
                far = np.where(n > 0, (above * both[:, None]).sum(axis=2) * width / n, np.inf)
            held = self.holds[:, p][None, :]
            least = np.where(held, np.minimum(least, near), least)
            most = np.where(held, np.maximum(most, far), most)
        return np.sqrt(least), np.sqrt(most)

    def sift(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, vec, leaf) for every further block that may hold one of the ``k`` closest donors of a gap.

        ``reached`` maps gaps to a distance within which ``k`` donors were met; without one, boxes give it.
        """
        blocks = self

        def go(batches):
            for batch in batches:
                step = max(1, SIFT_AT_ONCE // max(1, blocks.low.size))
                for start in range(0, len(batch), step):
                    part = batch.iloc[start:start + step]
                    q = _matrix(part["vec"])
                    least, most = blocks.distances(q)
                    order = np.argsort(most, axis=1)
                    wanted = np.zeros(least.shape, bool)
                    for c in range(q.shape[1]):
                        rows = np.flatnonzero(np.isnan(q[:, c]))
                        if not len(rows):
                            continue
                        limit = np.array([(dict(m) if m is not None else {}).get(c, np.inf) for m in part["reached"].iloc[rows]], float)
                        enough = np.cumsum(blocks.known[:, c][order[rows]], axis=1) >= k
                        far = np.take_along_axis(most[rows], order[rows], axis=1)[np.arange(len(rows)), enough.argmax(axis=1)]
                        limit = np.minimum(limit, np.where(enough.any(axis=1), far, np.inf))
                        near = least[rows] <= limit[:, None] * (1 + 1e-9)
                        wanted[rows] |= near & (blocks.known[:, c] > 0) & np.isfinite(least[rows])
                    wanted &= blocks.leaves[None, :] != part["leaf"].to_numpy()[:, None]
                    at, which = np.nonzero(wanted)
                    out = part.iloc[at][["qid", "vec"]].copy()
                    out["leaf"] = blocks.leaves[which]
                    yield out

        return queries.select("qid", "vec", "leaf", "reached").mapInPandas(go, "qid bigint, vec array<double>, leaf bigint")


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows, gaps as NaN."""
    return np.array([[np.nan if x is None else x for x in v] for v in vectors], dtype=float)


def _gap_kernel(k: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["bound"].notna().to_numpy()
        out = []
        if is_query.any() and (~is_query).any():
            qs, ds = _matrix(pdf.loc[is_query, "vec"]), _matrix(pdf.loc[~is_query, "vec"])
            ids = pdf.loc[is_query, "key"].to_numpy().astype("int64")
            for start in range(0, len(qs), 512):
                q = qs[start:start + 512]
                total = np.zeros((len(q), len(ds)))
                shared = np.zeros((len(q), len(ds)))
                for d in range(q.shape[1]):
                    gap = q[:, d][:, None] - ds[:, d][None, :]
                    both = ~np.isnan(gap)
                    total += np.where(both, gap, 0.0) ** 2
                    shared += both
                with np.errstate(divide="ignore", invalid="ignore"):
                    dist = np.sqrt(total * q.shape[1] / shared)
                for d in range(q.shape[1]):
                    rows = np.flatnonzero(np.isnan(q[:, d]))
                    known = np.flatnonzero(~np.isnan(ds[:, d]))
                    if len(rows) == 0 or len(known) == 0:
                        continue
                    values = ds[known, d]
                    by_value = np.argsort(values, kind="stable")
                    known, values = known[by_value], values[by_value]
                    part = np.where(shared[np.ix_(rows, known)] > 0, dist[np.ix_(rows, known)], np.inf)
                    order = np.argsort(part, axis=1, kind="stable")[:, :k]
                    near = np.take_along_axis(part, order, axis=1)
                    frame = pd.DataFrame({
                        "qid": np.repeat(ids[start + rows], order.shape[1]), "gap": d,
                        "distance": near.ravel(), "known": values[order].ravel()})
                    out.append(frame[np.isfinite(frame["distance"])])
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "gap": [], "distance": [], "known": []})
    return solve


class ImputationRounds:
    """Mean fill, then a fixed sequence of per-column linear predictions."""

    def __init__(self, names, means, steps):
        self.names, self.means, self.steps = names, means, steps

    def apply(self, df: DataFrame) -> DataFrame:
        held = df.withColumns({f"__raw{i}__": number(df, n) for i, n in enumerate(self.names)})
        held = held.withColumns({f"__now{i}__": F.coalesce(F.col(f"__raw{i}__"), F.lit(m))
                                 for i, m in enumerate(self.means)})
        for target, weights, intercept in self.steps:
            held = held.withColumn(f"__now{target}__", _prediction(target, weights, intercept))
        return held.select(*[F.col(f"__now{self.names.index(n)}__").alias(n) if n in self.names else col(n)
                             for n in df.columns])


def _prediction(target, weights, intercept):
    terms = [F.col(f"__now{i}__") * F.lit(float(w)) for i, w in enumerate(weights) if i != target]
    line = sum(terms, F.lit(float(intercept)))
    return F.coalesce(F.col(f"__raw{target}__"), line)


def iterative_rounds(df: DataFrame, names: list[str], max_iter: int, tolerance: float = 1e-3) -> ImputationRounds:
    """Learn the rounds: each column with gaps, fewest gaps first, on all the others.

    Every regression needs only cross products, summed in one distributed pass;
    rounds are cut by a durable copy of the narrow numeric table.
    """
    values = df.select(*[number(df, n).alias(f"__raw{i}__") for i, n in enumerate(names)])
    stats = values.agg(*[F.avg(F.col(f"__raw{i}__")).alias(f"m{i}") for i in range(len(names))],
                       *[F.count(F.when(F.col(f"__raw{i}__").isNull(), 1)).alias(f"g{i}") for i in range(len(names))],
                       *[F.max(F.abs(F.col(f"__raw{i}__"))).alias(f"a{i}") for i in range(len(names))]).first()
    means = [stats[f"m{i}"] for i in range(len(names))]
    order = sorted(range(len(names)), key=lambda i: (stats[f"g{i}"], i))
    limit = tolerance * max(stats[f"a{i}"] for i in range(len(names)))
    now = [f"__now{i}__" for i in range(len(names))]
    table = materialise(values.withColumns({c: F.coalesce(F.col(f"__raw{i}__"), F.lit(means[i]))
                                            for i, c in enumerate(now)}))
    steps = []
    if len(names) < 2:
        return ImputationRounds(names, means, steps)
    for _ in range(max_iter):
        before = {i: F.col(f"__now{i}__").alias(f"__old{i}__") for i in range(len(names))}
        table = table.select(*[F.col(f"__raw{i}__") for i in range(len(names))], *[F.col(c) for c in now],
                             *before.values())
        complete = None
        for target in order:
            if stats[f"g{target}"] == 0:
                if complete is None:
                    complete = cross_products(table, now, means)
                moments = complete
            else:
                moments = cross_products(table.where(F.col(f"__raw{target}__").isNotNull()), now, means)
            weights, intercept = ridge_from_moments(moments, target, means)
            steps.append((target, weights, intercept))
            if stats[f"g{target}"]:
                table = table.withColumn(now[target], _prediction(target, weights, intercept))
        table = materialise(table)
        moved = table.agg(F.max(F.greatest(*[F.abs(F.col(f"__now{i}__") - F.col(f"__old{i}__"))
                                             for i in range(len(names))])).alias("d")).first()["d"]
        table = table.drop(*[f"__old{i}__" for i in range(len(names))])
        if moved is None or moved < limit:
            break
    return ImputationRounds(names, means, steps)


def ridge_from_moments(moments, target: int, shift: list[float], rounds: int = 300) -> tuple[list[float], float]:
    """Bayesian ridge (evidence maximisation) from centred cross products.

    ``moments`` holds n, sums and cross products of values shifted by ``shift``.
    """
    n, sums, cross = moments
    others = [i for i in range(len(sums)) if i != target]
    mean = sums / max(n, 1)
    centred = cross - n * np.outer(mean, mean)
    xx, xy = centred[np.ix_(others, others)], centred[others, target]
    yy = centred[target, target]
    eigen, basis = np.linalg.eigh(xx)
    eigen = np.clip(eigen, 0.0, None)
    projected = basis.T @ xy
    tiny = 1e-6
    alpha, lam = 1.0 / (yy / max(n, 1) + np.finfo(float).eps), 1.0
    weights = np.zeros(len(others))
    for turn in range(rounds):
        new = basis @ (projected / (eigen + lam / alpha))
        residual = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        effective = float(np.sum(alpha * eigen / (lam + alpha * eigen)))
        lam = (effective + 2 * tiny) / (float(new @ new) + 2 * tiny)
        alpha = (n - effective + 2 * tiny) / (residual + 2 * tiny)
        moved = float(np.abs(new - weights).sum())
        weights = new
        if turn and moved < 1e-3:
            break
    weights = basis @ (projected / (eigen + lam / alpha))
    full = np.zeros(len(sums))
    full[others] = weights
    middle = mean + np.asarray(shift)
    return list(full), float(middle[target] - full @ middle)
