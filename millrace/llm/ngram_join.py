"""N-gram Jaccard join with a MinHash LSH forest: prefix trees of signatures, then exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import col, materialise
from .pairs import by_group, components, deal_blocks, forest, small_or_shuffled, spanning_edges

SHINGLE, SIMILARITY = 5, 0.8
# Trees and labels of a full signature path; a prefix is shortened until pairs at the threshold meet in some tree.
TREES, DEPTH, RECALL = 24, 8, 0.999
# Estimated similarity from which a text goes into one group with the first text (head) of its prefix group, and
# from which two other texts of the prefix group go into one group; the latter is 5 standard errors below the threshold.
RELATED, NEAR = 0.35, 0.65
# Two texts that agree in a share NEAR of their labels differ by at most 1 - NEAR in their agreement with the head: where
# one agrees with it from SETTLED on, both are in its group. All others of the prefix group are compared with each other.
SETTLED = RELATED + 1 - NEAR
WORD_CACHE, ROWS_AT_ONCE = 150_000, 512

_rng = np.random.default_rng(20_240_501)
_FACTORS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XORS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_ODDS = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


class _WordNumbers(dict):
    """64-bit number of a word, remembered; started afresh when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word)
        return n


_NUMBERS = _WordNumbers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of five neighbouring words, lower-cased by A-Z; fewer words are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    numbers = np.fromiter(map(_NUMBERS.__getitem__, words), np.uint64, len(words))
    if len(numbers) < SHINGLE:
        numbers = np.concatenate([numbers, np.zeros(SHINGLE - len(numbers), np.uint64)])
    n = len(numbers) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for i, factor in enumerate(_FACTORS):
        total += _mix(numbers[i:i + n] + np.uint64(i)) * factor
    return np.unique(_mix(total))


def signature(grams: np.ndarray) -> np.ndarray:
    """TREES x DEPTH smallest values under seeded permutations of 32 bits."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_XORS), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), ROWS_AT_ONCE):
        values = (low[i:i + ROWS_AT_ONCE, None] ^ _XORS) * _ODDS
        np.minimum(best, values.min(0), out=best)
    return best


def recall_at(depth: int, trees: int = TREES, similarity: float = SIMILARITY) -> float:
    """Share of pairs of that similarity that agree on a prefix of ``depth`` labels in at least one tree."""
    return 1 - (1 - similarity ** depth) ** trees


SIGNED = "doc_id long, cls binary, sig binary"


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest of the shingle set (null without words) and signature."""

    def run(batches):
        for batch in batches:
            classes, signatures = [], []
            for text in batch["text"]:
                grams = shingles(text)
                classes.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                signatures.append(signature(grams).tobytes() if len(grams) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "cls": classes, "sig": signatures})

    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")) \
        .mapInPandas(run, SIGNED)


def _prefixes(reps: DataFrame, depth: int) -> DataFrame:
    """(tree and prefix as one number, node) for every tree."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"]), np.uint32).reshape(len(batch), TREES, DEPTH)
            key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (len(batch), TREES)).copy()
            for level in range(depth):
                key = _mix((key + np.uint64(level + 1)) * _FACTORS[0] + sig[:, :, level])
            yield pd.DataFrame({"prefix": key.view(np.int64).ravel(), "node": np.repeat(batch["node"].to_numpy(), TREES)})

    return reps.select("node", "sig").mapInPandas(run, "prefix long, node long")


def _near(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Spanning pairs of the texts of two blocks whose signatures agree in a share of at least NEAR."""
    i, j = int(group["_i"].iloc[0]), int(group["_j"].iloc[0])
    node, block = group["node"].to_numpy(), group["_block"].to_numpy()
    sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), -1)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return
    x, y = np.ascontiguousarray(sig[left].T), np.ascontiguousarray(sig[right].T)
    same = np.zeros((len(left), len(right)), np.uint16)
    for one, other in zip(x, y, strict=True):
        same += one[:, None] == other
    a, b = np.nonzero(same >= NEAR * len(x))
    a, b = left[a], right[b]
    a, b = a[a != b], b[a != b]
    keep = spanning_edges(a, b, len(group))
    if len(keep):
        yield pd.DataFrame({"a": np.minimum(node[a[keep]], node[b[keep]]), "b": np.maximum(node[a[keep]], node[b[keep]])})


def related_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): pairs that connect all texts that share a prefix and agree in a share of at least NEAR of their labels.

    From the full paths on, prefixes are shortened label by label until the target recall is reached.  At each depth
    every text of a prefix group is paired with the group's first text only, so a group of any size gives
    fewer pairs than members, found by combined minima.  Under the shortest prefixes, which hold the groups of all
    longer ones, the texts that the first text does not settle are then compared with each other, block by block.
    """
    found, depth = None, DEPTH
    while True:
        rows = materialise(_prefixes(reps, depth))
        heads = rows.groupBy("prefix").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        members = rows.join(heads, "prefix").where("node <> a").select("prefix", "a", F.col("node").alias("b"))
        pairs = members.select("a", "b").distinct()
        found = pairs if found is None else found.union(pairs)
        if depth == 1 or recall_at(depth) >= RECALL:
            break
        depth -= 1
    found = materialise(found.distinct())
    nodes = small_or_shuffled(found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct())
    sigs = materialise(reps.select("node", "sig").join(nodes, "node"))
    both = found.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a") \
        .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")

    def close(batches):
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint32).reshape(len(batch), -1) for c in ("x", "y"))
                yield batch[["a", "b"]].assign(share=(x == y).mean(1))

    guess = materialise(both.mapInPandas(close, "a long, b long, share double"))
    star = guess.where(F.col("share") >= RELATED).select("a", "b")
    loose = guess.where(F.col("share") < SETTLED).select("a", "b")
    left = materialise(members.join(small_or_shuffled(loose), ["a", "b"]).select("prefix", F.col("b").alias("node")))
    sizes = materialise(left.groupBy("prefix").agg(F.count("*").alias("_size")).where("_size > 1"))
    if sizes.isEmpty():
        return star
    left = left.join(small_or_shuffled(sizes), "prefix").join(sigs, "node")
    dealt = deal_blocks(left, "prefix", "_size", "node")
    return star.union(by_group(dealt, ["prefix", "_i", "_j"], _near, "a long, b long")).distinct()


def exact_links(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Boolean matrix (left x right): Jaccard similarity of the sets at least ``similarity``."""
    sizes = np.asarray([len(g) for g in grams], np.int64)
    owner = np.repeat(np.arange(len(grams)), sizes)
    values, column, often = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    # A shingle of one text alone is in no intersection.
    shared = np.flatnonzero(often > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    keep = column >= 0
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    step = 4_096
    for at in range(0, len(shared), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        has = np.zeros((len(grams), min(step, len(shared) - at)), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        common += has[left] @ has[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= similarity * union - 1e-6


LINKS = "node long, links long, other long"


def _compare(similarity: float):
    def compare(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(group) < 2:
            return
        i, j = int(group["_i"].iloc[0]), int(group["_j"].iloc[0])
        nodes, weights = group["node"].to_numpy(), group["weight"].to_numpy()
        block = group["_block"].to_numpy()
        grams = [np.frombuffer(g, np.uint64) for g in group["grams"]]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return
        linked = exact_links(grams, left, right, similarity)
        if i == j:
            np.fill_diagonal(linked, False)
            counts, pair = linked @ weights[right], forest(linked)
            where = [(left, counts)]
            pairs = (left[pair[0]], right[pair[1]])
        else:
            where = [(left, linked @ weights[right]), (right, weights[left] @ linked)]
            n = len(left) + len(right)
            whole = np.zeros((n, n), bool)
            whole[:len(left), len(left):] = linked
            whole[len(left):, :len(left)] = linked.T
            pair = forest(whole)
            ends = np.concatenate([left, right])
            pairs = (ends[pair[0]], ends[pair[1]])
        for rows, counts in where:
            some = counts > 0
            if some.any():
                yield pd.DataFrame({"node": nodes[rows[some]], "links": counts[some].astype(np.int64), "other": nodes[rows[some]]})
        if len(pairs[0]):
            yield pd.DataFrame({"node": nodes[pairs[0]], "links": 0, "other": nodes[pairs[1]]})

    return compare


def join_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept.

    Texts with equal shingle sets form a class, named by its smallest id.  ``n_links`` counts the other documents whose
    sets have a Jaccard similarity of at least ``similarity`` (members of the same class included), component_id is the
    smallest id reachable over links, and kept marks that one document.

    Texts of one to four words have one shingle; null texts and texts without words link with nothing.  Rows that
    share an id are one document, listed once.  A null id gives a row of nulls, kept, per row.  Other columns
    are ignored.  An empty table gives an empty table.
    """
    signed = materialise(sign(docs, id_col, text_col))
    named = signed.where("doc_id is not null")
    # Copies are counted before the shuffle; a class of any size is one short row.
    classes = materialise(named.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("weight")))
    reps = named.join(classes.select("cls", F.col("node").alias("_n")), "cls").where("doc_id = _n") \
        .select(F.col("doc_id").alias("node"), "sig").dropDuplicates(["node"])
    pairs = materialise(related_pairs(materialise(reps)))
    groups = components(pairs)
    sizes = groups.groupBy("component").agg(F.count("*").alias("_size"))
    weights = classes.groupBy("node").agg(F.sum("weight").alias("weight"))
    members = materialise(groups.join(sizes, "component").join(weights, "node"))

    def grams(batches):
        for batch in batches:
            batch["grams"] = [shingles(t).tobytes() for t in batch.pop("text")]
            yield batch

    texts = docs.select(col(id_col).cast("long").alias("node"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    sets = texts.join(small_or_shuffled(members), "node").select("component", "_size", "node", "weight", "text") \
        .mapInPandas(grams, "component long, _size long, node long, weight long, grams binary")
    dealt = deal_blocks(sets, "component", "_size", "node")
    links = materialise(by_group(dealt, ["component", "_i", "_j"], _compare(similarity), LINKS))
    counts = links.groupBy("node").agg(F.sum("links").alias("_links"))
    linked = components(links.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    facts = classes.join(counts, "node", "left").join(linked, "node", "left").select(
        "cls", F.col("node").alias("class_id"), (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    out = named.select("doc_id", "cls").join(facts, "cls", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"),
                                    F.min("component_id").alias("component_id"))
    lost = signed.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"),
                                                 F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.union(lost).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
