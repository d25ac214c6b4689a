"""Embedding near-dedup with randomly rotated binary codes, their correction factors and exact recomputation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import col, materialise
from .pairs import BLOCK_ROWS, by_group, components, forest

SIMILARITY, RECALL = 0.9, 0.995
# Vectors that meet by chance in a bucket; the number of code bits of a bucket key follows from it.
CHANCE_ROWS = 64
SEED = 97
# Distance of the confidence bound in standard errors; a pair outside it is settled without recomputation.
SIGMAS = 5.0


def rotation(dim: int, number: int) -> np.ndarray:
    """A random rotation (Haar distributed), fixed by its number."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def code(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of unit vectors as +-1, and the stored factor: inner product of each vector with its normed code."""
    signs = np.where(rotated >= 0, 1.0, -1.0).astype(np.float32)
    return signs, np.abs(rotated).sum(1) / math.sqrt(rotated.shape[1])


def estimates(signs: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of inner products (rows: queries, columns: codes), and their standard errors by code."""
    dim = signs.shape[1]
    raw = queries.astype(np.float32) @ signs.T / math.sqrt(dim)
    return raw / factors[None, :], np.sqrt(np.maximum(1 - factors ** 2, 0)) / factors / math.sqrt(max(dim - 1, 1))


def plan(rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a bucket key, number of tables): a pair at the threshold shares a key with probability ``recall``."""
    bits = max(6, math.ceil(math.log2(max(rows, 2) / CHANCE_ROWS)))
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def bucket_keys(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables): code bits of independent rotations, ``bits`` to a key."""
    dim, keys = units.shape[1], np.zeros((len(units), tables), np.int64)
    for t in range(tables):
        for b in range(bits):
            number, place = divmod(t * bits + b, dim)
            if place == 0 or b == 0:
                signs = units @ rotation(dim, number + 1) >= 0
            keys[:, t] = (keys[:, t] << 1) | signs[:, place]
    return keys


LINKS = "node long, links long, other long"


def _compare(dim: int, bits: int, tables: int, similarity: float):
    turn = rotation(dim, 0)

    def compare(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(group) < 2:
            return
        table, i, j = int(group["t"].iloc[0]), int(group["_i"].iloc[0]), int(group["_j"].iloc[0])
        block = group["_block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return
        units = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(group), dim)
        rotated = units @ turn
        signs, factors = code(rotated)
        guess, error = estimates(signs[right], factors[right], rotated[left])
        # Below the upper bound the pair cannot reach the threshold with confidence; the others are recomputed.
        a, b = np.nonzero(guess + SIGMAS * error[None, :] >= similarity)
        if i == j:
            keep = a < b
            a, b = a[keep], b[keep]
        a, b = left[a], right[b]
        if not len(a):
            return
        exact = np.einsum("ij,ij->i", units[a], units[b])
        a, b = a[exact >= similarity], b[exact >= similarity]
        if table and len(a):
            # A pair counts in the first table whose key it shares.
            used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = bucket_keys(units[used], bits, table)
            new = ~(keys[back[:len(a)]] == keys[back[len(a):]]).any(1)
            a, b = a[new], b[new]
        if not len(a):
            return
        nodes, weights = group["node"].to_numpy(), group["weight"].to_numpy()
        counts = np.bincount(a, weights[b], len(group)) + np.bincount(b, weights[a], len(group))
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"node": nodes[some], "links": counts[some].astype(np.int64), "other": nodes[some]})
        place = np.full(len(group), -1)
        place[some] = np.arange(len(some))
        linked = np.zeros((len(some), len(some)), bool)
        linked[place[a], place[b]] = linked[place[b], place[a]] = True
        x, y = forest(linked)
        yield pd.DataFrame({"node": nodes[some[x]], "links": 0, "other": nodes[some[y]]})

    return compare


def dedup_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are pairs with a cosine of at least ``similarity`` in double precision.  Candidates share the code bits of some
    bucket key; inside a bucket binary codes and correction factors give unbiased estimates, and pairs whose upper
    confidence bound reaches the threshold are recomputed exactly, so no link below it is reported.  A pair at the
    threshold is met with probability ``recall``, closer ones almost surely.  Equal vectors are one node of the search.
    Buckets that hold many close vectors are compared block by block.

    A vector that is null, zero or has null or non-finite components links with nothing.  Between vectors of different
    lengths no cosine is defined, so each length is searched by itself.  Rows that share an id are one vector, listed once;
    a null id gives a row of nulls, kept, per row.  Other columns are ignored.  An empty table gives an empty table.
    """
    array = col(vector_col).cast("array<double>")
    scale = F.reduce(array, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), array.alias("v"), scale.alias("m"))
    bad = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.col("m") > 0))
    lengths = sorted(r["d"] for r in good.select(F.size("v").alias("d")).distinct().collect())
    known = vectors.sparkSession.createDataFrame([], "vec_id long, n_links long, component_id long")
    for dim in lengths:
        known = known.unionAll(_search_length(good.where(F.size("v") == dim), dim, similarity, recall))
    if len(lengths) > 1:
        known = known.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return _listed(rows.groupBy("vec_id").agg(F.count("*").alias("_n")), known)


def _search_length(good: DataFrame, dim: int, similarity: float, recall: float) -> DataFrame:
    """(vec_id, n_links, component_id) of the usable vectors of one length."""

    def unit(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(np.float64) / batch["m"].to_numpy()[:, None]
            x /= np.linalg.norm(x, axis=1)[:, None]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "unit": [r.tobytes() for r in x]})

    units = materialise(good.mapInPandas(unit, "vec_id long, unit binary"))
    # Equal vectors are counted before the shuffle; a class of any size is one row.
    nodes = materialise(units.groupBy("unit").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("weight")))
    bits, tables = plan(nodes.count(), similarity, recall)

    def keys(batches):
        for batch in batches:
            for at in range(0, len(batch), 2_048):
                part = batch.iloc[at:at + 2_048]
                x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), dim)
                k = bucket_keys(x, bits, tables)
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), tables), "t": np.tile(np.arange(tables), len(part)),
                                    "key": k.ravel()})

    buckets = nodes.select("node", "unit").mapInPandas(keys, "node long, t int, key long")
    sizes = buckets.groupBy("t", "key").agg(F.count("*").alias("_size")).where("_size > 1")
    sized = buckets.join(sizes, ["t", "key"])
    blocks = F.ceil(F.col("_size") / BLOCK_ROWS).cast("int")
    dealt = sized.withColumn("_block", F.pmod(F.xxhash64("node"), blocks).cast("int")) \
        .withColumn("_k", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select("node", "t", "key", "_block", F.least("_block", "_k").alias("_i"), F.greatest("_block", "_k").alias("_j"))
    dealt = dealt.join(nodes, "node")
    links = materialise(by_group(dealt, ["t", "key", "_i", "_j"], _compare(dim, bits, tables, similarity), LINKS))
    counts = links.groupBy("node").agg(F.sum("links").alias("_links"))
    linked = components(links.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    facts = nodes.join(counts, "node", "left").join(linked, "node", "left").select(
        "unit", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    return units.join(facts, "unit").groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))


def _listed(every: DataFrame, known: DataFrame) -> DataFrame:
    """Every id once; null ids once per row."""
    rows = every.join(known, "vec_id", "left")
    times = F.when(F.col("vec_id").isNull(), F.col("_n")).otherwise(1)
    rows = rows.withColumn("_row", F.explode(F.sequence(F.lit(1), times)))
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.col("vec_id").eqNullSafe(component).alias("kept"))
